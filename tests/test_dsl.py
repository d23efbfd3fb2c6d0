"""The builders say what the SQL says."""

from dataclasses import dataclass

import pytest

from millrace import TypedTable, errors


@dataclass
class User:
    id: int
    name: str | None
    age: int
    active: bool = True


@dataclass
class Order:
    oid: int
    user_id: int
    amount: int


USERS, ORDERS = TypedTable("users", User), TypedTable("orders", Order)
U, O = USERS.c, ORDERS.c


@pytest.fixture
def filled(db):
    db.create_table(USERS, primary_key=U.id)
    db.create_table(ORDERS, primary_key="oid", foreign_keys=[("user_id", USERS, "id", "cascade")])
    db.from_(USERS).insert([{"id": 1, "name": "Alice", "age": 30, "active": True}, {"id": 2, "name": "  Bob ", "age": 17, "active": False}, {"id": 3, "name": None, "age": 42, "active": True}])
    db.from_(ORDERS).insert([Order(10, 1, 25).__dict__, Order(11, 1, 75).__dict__, Order(12, 2, 10).__dict__])
    return db


def ids(query):
    return sorted(r[0] for r in query.select("id").to_df().collect())


def test_filters(filled):
    q = filled.from_(USERS)
    for condition, sql in [
        (U.age.ge(18), "age >= 18"),
        (U.age.between(17, 30), "age BETWEEN 17 AND 30"),
        (U.name.like("a%"), "name LIKE 'a%'"),
        (U.name.not_like("a%"), "name NOT LIKE 'a%'"),
        (U.name.glob("*B*"), "name GLOB '*B*'"),
        (U.name.is_null(), "name IS NULL"),
        (U.name.is_("Alice"), "name IS 'Alice'"),
        (U.name.is_not("Alice"), "name IS NOT 'Alice'"),
        (U.age.not_between(17, 30), "NOT (age BETWEEN 17 AND 30)"),
        (U.age.lt(20) | U.name.is_null(), "age < 20 OR name IS NULL"),
    ]:
        assert ids(q.where(condition)) == sorted(r[0] for r in filled.exec(f"SELECT id FROM users WHERE {sql}").rows()), sql
    assert ids(q.and_where(U.age.gt(17)).and_where(U.name.contains("LIC"))) == [1]
    assert ids(q.where_trim(U.name, "Bob")) == [2]
    assert ids(q.where_lower(U.name, "alice")) == [1]
    assert ids(q.where_function("length", U.name, ">", 5)) == [2]
    assert ids(q.where_function2("instr", U.name, "ob", ">", 0)) == [2]
    assert ids(q.where_in_values(U.id, [1, 3])) == [1, 3]
    assert ids(q.where_not_in_values(U.name, ["Alice", None])) == [2, 3]
    assert ids(q.where_in_column(U.id, ORDERS, O.user_id)) == [1, 2]
    assert ids(q.where_not_exists_key(ORDERS, O.user_id, U.id)) == [3]
    assert ids(q.where_exists(ORDERS)) == [1, 2, 3]
    assert ids(q.where_not_exists(ORDERS)) == []
    with pytest.raises(errors.UnknownColumn):
        q.group_by("nothing")


def test_groups_joins_pages(filled):
    q = filled.from_(ORDERS)
    assert sorted(map(tuple, q.group_by(O.user_id).count().sum(O.amount).to_df().collect())) == [(1, 2, 100), (2, 1, 10)]
    assert q.group_by(O.user_id).having_count(">", 1).to_df().collect()[0][0] == 1
    assert q.average(O.amount).to_df().first()[0] == pytest.approx(110 / 3)
    users = filled.from_(USERS)
    for kind, n in (("inner_join", 3), ("left_join", 4), ("right_join", 3), ("full_join", 4)):
        assert getattr(users, kind)(ORDERS, U.id, O.user_id).row_count() == n
    assert users.cross_join(ORDERS).row_count() == 9
    assert users.inner_join(ORDERS, U.id, O.user_id).select("name").distinct().row_count() == 2
    assert [r[0] for r in users.order_by(U.age.desc()).limit(1).offset(1).select("id").to_df().collect()] == [1]
    raw = filled.from_("users")
    assert ids(raw.where(raw.col("age").gte(18))) == [1, 3]
    assert raw.count().to_df().first()[0] == 3


def test_scalar_projections(filled):
    q = filled.from_(USERS).where(U.id.eq(2))
    row = q.lower_column(U.name).trim_column(U.name).length_column(U.name).cast_column(U.age, "TEXT").typeof_column(U.age).coalesce_column(U.name, "?").replace_column(U.name, "o", "0").to_df().first()
    assert tuple(row) == ("  bob ", "Bob", 6, "17", "integer", "  Bob ", "  B0b ")


def test_typed_rows(filled):
    q = filled.from_(USERS)
    assert q.where(U.id.eq(3)).fetch_one_typed() == User(3, None, 42, True)
    assert q.where(U.id.eq(9)).fetch_one_typed() is None
    assert [u.active for u in sorted(q.fetch_typed(), key=lambda u: u.id)] == [True, False, True]
    with pytest.raises(errors.TypeMismatch):
        q.select_fields([U.id]).fetch_typed()


def test_writes(filled):
    q = filled.from_(USERS)
    assert q.update({"age": U.age.column + 1}).where(U.id.eq(1)).execute().changes == 1
    assert q.where(U.id.eq(1)).fetch_one_typed().age == 31
    assert q.insert_ignore({"id": 1, "name": "x", "age": 1}).changes == 0
    q.insert_replace({"id": 2, "name": "new", "age": 2, "active": True})
    assert filled.from_(ORDERS).row_count() == 2  # the replaced row's orders went with it
    assert q.delete().where(U.id.eq(1)).execute().changes == 1
    assert filled.from_(ORDERS).row_count() == 0
    with pytest.raises(errors.ConstraintViolation):
        filled.from_(ORDERS).insert({"oid": 1, "user_id": 77, "amount": 1})


def test_schema_calls(filled):
    filled.add_column(USERS, "extra", str)
    filled.rename_column(USERS, "extra", "more")
    filled.create_index(USERS, "by_age", [U.age])
    filled.create_view("adults", "SELECT id FROM users WHERE age >= 18")
    assert filled.from_("adults").row_count() == 2
    filled.drop_view("adults")
    filled.drop_index("by_age")
    filled.drop_column(USERS, "more")
    filled.truncate(ORDERS)
    assert filled.from_(ORDERS).row_count() == 0
    filled.drop_table(ORDERS)
    filled.rename_table(USERS, "people")
    assert filled.table_exists("people") and not filled.table_exists(USERS)
