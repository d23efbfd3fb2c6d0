"""One query for each operator of the engine, over the driver's tables, with SQL for DuckDB that gives the same rows."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database
from .dsl import TypedTable
from .errors import DatabaseError
from .functions.patterns import LOWER, UPPER
from .migrate import Migration, Migrator
from .sources.db_file import export_file, import_file
from .sources.store import scratch_root

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def open_db(spark: SparkSession, sf_dir: str, texts: str) -> Database:
    """A database that has those of the driver's tables that the texts name."""
    db, named = Database(spark), set(re.findall(r"\w+", texts))
    for name in TABLES:
        if name in named:
            db.load(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return db


def _sql(name: str, text: str, oracle: str | None = None, params: list | dict | None = None, before: str = "") -> None:
    """A query in the dialect; oracle: for DuckDB, the same text if not given. before: statements that come first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = open_db(spark, sf_dir, f"{before} {text}")
        if before:
            db.exec(before)
        return db.query(text, params)

    QUERIES[name] = run
    if oracle != "":
        ORACLES[name] = oracle or text


def _dsl(name: str, build: Callable[[Database], DataFrame], oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(open_db(spark, sf_dir, oracle))
    ORACLES[name] = oracle


@dataclass
class Order:
    o_orderkey: int
    o_custkey: int
    o_orderstatus: str
    o_totalprice: float
    o_orderpriority: str


@dataclass
class Customer:
    c_custkey: int
    c_name: str
    c_nationkey: int
    c_acctbal: float
    c_mktsegment: str


@dataclass
class Event:
    event_id: int
    user_id: int
    event_type: str
    value: float
    props: str


ORDERS, CUSTOMERS, EVENTS = TypedTable("orders", Order), TypedTable("customer", Customer), TypedTable("events", Event)
_O, _C, _E = ORDERS.c, CUSTOMERS.c, EVENTS.c

# Flagship: join, filter, groups, having, order and limit through the typed builder
_dsl(
    "flagship_segments",
    lambda db: db.from_(ORDERS)
    .inner_join(CUSTOMERS, _O.o_custkey, _C.c_custkey)
    .where(_O.o_totalprice.gt(1000))
    .to_df()
    .groupBy("c_mktsegment")
    .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    .where("n > 1")
    .orderBy(F.col("c_mktsegment"))
    .limit(10),
    "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 10",
)

# Scans and projections
_sql("scan_all", "SELECT * FROM nation")
_sql("project_cols", "SELECT o_orderkey, o_orderstatus FROM orders")
_sql("project_alias", "SELECT c_custkey AS id, c_name AS name FROM customer")
_sql("expr_add_sub", "SELECT l_orderkey, l_quantity + l_linenumber - 1 AS x FROM lineitem")
_sql("constant_select", "SELECT 1 AS one, 'a' AS a, -2 AS minus_two", "SELECT 1::BIGINT AS one, 'a' AS a, (-2)::BIGINT AS minus_two")
_sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")

# Predicates
for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _sql(f"filter_{_name}", f"SELECT p_partkey FROM part WHERE p_size {_op} 25")
_sql("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
_sql("filter_in_list", "SELECT p_partkey FROM part WHERE p_size IN (1, 7, 31)")
_sql("filter_not_in_list", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 7, 31)")
_sql("filter_not_in_list_null", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') NOT IN ('F', NULL)", "SELECT o_orderkey FROM orders WHERE coalesce(nullif(o_orderstatus, 'P') <> 'F', true)")
_sql("filter_and_or", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice > 100000")
_NULLED = "nullif(o_orderstatus, 'P')"
_sql("filter_is_null", f"SELECT o_orderkey FROM orders WHERE {_NULLED} IS NULL")
_sql("filter_is_not_null", f"SELECT o_orderkey FROM orders WHERE {_NULLED} IS NOT NULL")
_sql("filter_is_value", f"SELECT o_orderkey FROM orders WHERE {_NULLED} IS 'F'", f"SELECT o_orderkey FROM orders WHERE {_NULLED} IS NOT DISTINCT FROM 'F'")
_sql("filter_is_not_value", f"SELECT o_orderkey FROM orders WHERE {_NULLED} IS NOT 'F'", f"SELECT o_orderkey FROM orders WHERE {_NULLED} IS DISTINCT FROM 'F'")
_sql("filter_is_distinct", f"SELECT o_orderkey FROM orders WHERE {_NULLED} IS DISTINCT FROM 'O'")
_sql("filter_is_not_distinct", f"SELECT o_orderkey FROM orders WHERE {_NULLED} IS NOT DISTINCT FROM 'O'")
_sql("like_ci", "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'b_I%'", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b_i%'")
_sql("not_like", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT LIKE '%U%'", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT ILIKE '%u%'")
_sql("glob", "SELECT c_custkey FROM customer WHERE c_name GLOB '*[0-3]?[!5]'")
_sql("not_glob", "SELECT c_custkey FROM customer WHERE c_name NOT GLOB '*[0-3]?'", "SELECT c_custkey FROM customer WHERE NOT c_name GLOB '*[0-3]?'")
_dsl("contains", lambda db: db.from_(CUSTOMERS).where(_C.c_mktsegment.contains("Ui")).select("c_custkey").to_df(), "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%ui%'")
_dsl("not_contains", lambda db: db.from_(CUSTOMERS).where(_C.c_mktsegment.not_contains("Ui")).select("c_custkey").to_df(), "SELECT c_custkey FROM customer WHERE c_mktsegment NOT ILIKE '%ui%'")
_dsl("starts_with", lambda db: db.from_(CUSTOMERS).where(_C.c_mktsegment.starts_with("bU")).select("c_custkey").to_df(), "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'bu%'")
_dsl("ends_with", lambda db: db.from_(CUSTOMERS).where(_C.c_mktsegment.ends_with("Y")).select("c_custkey").to_df(), "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%y'")
_sql("pred_lower", "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) = '1-urgent'", f"SELECT o_orderkey FROM orders WHERE translate(o_orderpriority, '{UPPER}', '{LOWER}') = '1-urgent'")
_sql("pred_trim", "SELECT n_nationkey FROM nation WHERE trim(n_name) = n_name")
_sql("pred_instr", "SELECT p_partkey FROM part WHERE instr(p_type, 'S') > 0")
_sql("pred_length", "SELECT doc_id FROM documents WHERE length(text) > 2000", "SELECT doc_id FROM documents WHERE strlen(text) > 2000")
_sql("pred_json", "SELECT event_id FROM events WHERE json_extract(props, '$.k') = '7'", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")

# Joins
_TOP = "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000"
_BIG = f"CREATE VIEW big AS {_TOP}"
for _kind in ("INNER", "LEFT", "RIGHT", "FULL"):
    _sql(f"join_{_kind.lower()}", f"SELECT c_custkey, o_orderkey FROM customer {_kind} JOIN big ON c_custkey = o_custkey", f"SELECT c_custkey, o_orderkey FROM customer {_kind} JOIN ({_TOP}) ON c_custkey = o_custkey", before=_BIG)
_sql("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
_sql("join_distinct", "SELECT DISTINCT c_mktsegment, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey")
_sql("join_multi", "SELECT r_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c.c_acctbal > 0 GROUP BY r_name HAVING count(*) > 1 ORDER BY r_name")
_dsl("join_typed_cross", lambda db: db.from_("nation").inner_join("region", db.col("n_regionkey"), db.col("r_regionkey")).select("n_name", "r_name").to_df(), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_sql("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
_sql("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
_sql(
    "anti_not_in_null",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 5) FROM orders WHERE o_totalprice > 400000)",
    "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 400000 AND nullif(o_custkey, 5) = c_custkey)",
)
_sql("exists_uncorrelated", "SELECT r_regionkey FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 1)")
_sql("exists_key", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE orders.o_custkey = customer.c_custkey AND o_totalprice > 350000)")
_sql("not_exists_key", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE orders.o_custkey = customer.c_custkey AND o_totalprice > 350000)")
_dsl("dsl_exists_key", lambda db: db.from_(CUSTOMERS).where_exists_key(ORDERS, _O.o_custkey, _C.c_custkey).select("c_custkey").to_df(), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
_dsl("dsl_not_in_column", lambda db: db.from_(CUSTOMERS).where_not_in_column(_C.c_custkey, ORDERS, _O.o_custkey).select("c_custkey").to_df(), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_dsl("dsl_exists_any", lambda db: db.from_(CUSTOMERS).where_exists(ORDERS).select("c_custkey").to_df(), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders)")

# Aggregates
_sql("agg_count", "SELECT count(*) AS n FROM orders")
_sql("agg_count_col", f"SELECT count({_NULLED}) AS n FROM orders")
_sql("agg_sum", "SELECT sum(l_linenumber) AS s FROM lineitem", "SELECT sum(l_linenumber)::BIGINT AS s FROM lineitem")
_sql("agg_avg", "SELECT round(average(o_totalprice), 4) AS a FROM orders", "SELECT round(avg(o_totalprice), 4) AS a FROM orders")
_sql("agg_min", "SELECT min(o_totalprice) AS m FROM orders")
_sql("agg_max", "SELECT max(o_orderpriority) AS m FROM orders")
_sql("agg_multi", "SELECT count(*) AS n, min(l_tax) AS a, max(l_tax) AS b, round(sum(l_extendedprice), 2) AS s FROM lineitem")
_sql("agg_empty", "SELECT sum(o_custkey) AS s, count(*) AS n FROM orders WHERE o_totalprice < 0", "SELECT sum(o_custkey)::BIGINT AS s, count(*) AS n FROM orders WHERE o_totalprice < 0")
_sql(
    "group_count_sum_avg_min_max",
    "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_discount), 6) AS a, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem WHERE l_quantity > 5 GROUP BY l_returnflag",
)
_sql("group_sum_int", "SELECT o_orderstatus, sum(o_custkey) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, sum(o_custkey)::BIGINT AS s FROM orders GROUP BY o_orderstatus")
_sql("group_null_key", f"SELECT {_NULLED} AS k, count(*) AS n FROM orders GROUP BY {_NULLED}")
_sql("having_count", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_sql("having_sum", "SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 3000000")
_sql("having_key", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING n_regionkey >= 2")
_dsl("dsl_group_having", lambda db: db.from_(ORDERS).group_by(_O.o_custkey).count().having_count(">", 12).to_df().toDF("o_custkey", "n"), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
_dsl(
    "dsl_aggregates",
    lambda db: db.from_(ORDERS).sum(_O.o_custkey).minimum(_O.o_totalprice).maximum(_O.o_totalprice).to_df().toDF("s", "lo", "hi"),
    "SELECT sum(o_custkey)::BIGINT AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders",
)

# Order and page
_sql("order_asc", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50", "SELECT o_orderkey FROM orders ORDER BY o_totalprice NULLS FIRST, o_orderkey LIMIT 50")
_sql("order_desc", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50")
_sql("order_nulls", f"SELECT o_orderkey, {_NULLED} AS k FROM orders ORDER BY {_NULLED}, o_orderkey LIMIT 40", f"SELECT o_orderkey, {_NULLED} AS k FROM orders ORDER BY {_NULLED} NULLS FIRST, o_orderkey LIMIT 40")
_sql("topk_offset", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 5")
_sql("limit_zero", "SELECT p_partkey FROM part LIMIT 0")
_sql("offset_alone", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")

# CTEs, views, series
_sql("cte_single", "WITH rich AS (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) SELECT count(*) AS n FROM rich")
_sql("cte_multi", "WITH a AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1), b AS (SELECT c_custkey, c_nationkey FROM customer) SELECT c_custkey FROM b JOIN a ON c_nationkey = n_nationkey")
_sql("cte_dependent", "WITH a(k, p) AS (SELECT p_partkey, p_size FROM part), b AS (SELECT k FROM a WHERE p < 5) SELECT k FROM b")
_sql("rec_numbers", "WITH RECURSIVE n(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM n WHERE x < 25) SELECT x FROM n", "SELECT unnest(range(1, 26)) AS x")
_sql(
    "rec_hierarchy",
    "WITH RECURSIVE t(k, d) AS (SELECT r_regionkey, 0 FROM region WHERE r_regionkey = 0 UNION ALL SELECT n_nationkey, d + 1 FROM nation JOIN t ON n_regionkey = k WHERE d < 2) SELECT k, d FROM t",
    "WITH RECURSIVE t(k, d) AS (SELECT r_regionkey, 0::BIGINT FROM region WHERE r_regionkey = 0 UNION SELECT n_nationkey, d + 1 FROM nation JOIN t ON n_regionkey = k WHERE d < 2) SELECT k, d FROM t",
)
_sql(
    "rec_dedup_cycle",
    "WITH RECURSIVE t(x) AS (SELECT 0 UNION SELECT (x + 3) % 7 FROM t) SELECT x FROM t",
    "SELECT unnest(range(0, 7)) AS x",
)
_sql("series_up", "SELECT value FROM s", "SELECT unnest(generate_series(1, 5)) AS value", before="CREATE VIRTUAL TABLE s USING generate_series(1, 5)")
_sql("series_down", "SELECT value FROM s", "SELECT unnest(generate_series(5, -5, -1)) AS value", before="CREATE VIRTUAL TABLE s USING generate_series(5, -5)")
_sql("series_step", "SELECT value FROM s WHERE value > 10", "SELECT * FROM (SELECT unnest(generate_series(1, 40, 7)) AS value) WHERE value > 10", before="CREATE VIRTUAL TABLE s USING generate_series(1, 40, 7)")
_sql("view_read", "SELECT v.o_orderkey FROM big v WHERE v.o_custkey > 100", f"SELECT o_orderkey FROM ({_TOP}) WHERE o_custkey > 100", before=_BIG)
_sql("view_over_view", "SELECT count(*) AS n FROM v2", f"SELECT count(*) AS n FROM ({_TOP}) WHERE o_custkey < 700", before=f"{_BIG}; CREATE VIEW v2 AS SELECT o_orderkey FROM big WHERE o_custkey < 700")

# Scalars
_sql("fn_abs", "SELECT c_custkey, abs(c_acctbal) AS x FROM customer")
_sql("fn_round", "SELECT o_orderkey, round(o_totalprice) AS x FROM orders")
_sql("fn_round_digits", "SELECT l_orderkey, round(l_quantity + 1, 2) AS x FROM lineitem")
_sql("fn_round_negative", "SELECT p_partkey, round(p_partkey, -1) AS x FROM part", "SELECT p_partkey, (CASE WHEN p_partkey % 10 >= 5 THEN p_partkey - p_partkey % 10 + 10 ELSE p_partkey - p_partkey % 10 END)::DOUBLE AS x FROM part")
_sql("fn_cast_int", "SELECT c_custkey, cast(c_acctbal AS INTEGER) AS x FROM customer", "SELECT c_custkey, trunc(c_acctbal)::BIGINT AS x FROM customer")
_sql("fn_cast_int_text", "SELECT n_nationkey, cast(n_name AS INTEGER) AS x FROM nation", "SELECT n_nationkey, 0::BIGINT AS x FROM nation")
_sql("fn_cast_real", "SELECT p_partkey, cast(p_size AS REAL) AS x FROM part", "SELECT p_partkey, p_size::DOUBLE AS x FROM part")
_sql("fn_cast_text", "SELECT p_partkey, cast(p_size AS TEXT) AS x FROM part", "SELECT p_partkey, p_size::VARCHAR AS x FROM part")
_sql("fn_typeof", f"SELECT o_orderkey, typeof({_NULLED}) AS a, typeof(o_custkey) AS b, typeof(o_totalprice) AS c FROM orders", f"SELECT o_orderkey, CASE WHEN {_NULLED} IS NULL THEN 'null' ELSE 'text' END AS a, 'integer' AS b, 'real' AS c FROM orders")
_sql("fn_length_bytes", "SELECT doc_id, length(text) AS x FROM documents", "SELECT doc_id, strlen(text) AS x FROM documents")
_sql("fn_lower_ascii", "SELECT doc_id, md5(lower(text)) AS x FROM documents", f"SELECT doc_id, md5(translate(text, '{UPPER}', '{LOWER}')) AS x FROM documents")
_sql("fn_upper_ascii", "SELECT doc_id, md5(upper(text)) AS x FROM documents", f"SELECT doc_id, md5(translate(text, '{LOWER}', '{UPPER}')) AS x FROM documents")
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
for _fn in ("trim", "ltrim", "rtrim"):
    _sql(f"fn_{_fn}", f"SELECT n_nationkey, {_fn}('  ' || n_name || ' ') AS x FROM nation", f"SELECT n_nationkey, {_fn}('  ' || n_name || ' ', {_WS}) AS x FROM nation")
_DIRTY = "chr(9) || ' ' || n_name || chr(13) || chr(10) || chr(11) || chr(12)"
for _fn in ("trim", "ltrim", "rtrim"):
    _sql(f"fn_{_fn}_space", f"SELECT n_nationkey, {_fn}({_DIRTY}) AS x FROM nation", f"SELECT n_nationkey, {_fn}({_DIRTY}, {_WS}) AS x FROM nation")
_sql("pred_trim_some", f"SELECT n_nationkey FROM nation WHERE trim(CASE WHEN n_nationkey < 9 THEN {_DIRTY} ELSE n_name || '.' END) = n_name", "SELECT n_nationkey FROM nation WHERE n_nationkey < 9")
_sql("fn_substr_text", "SELECT doc_id, substr(text, 5, 40) AS a, substr(text, -3, 6) AS b FROM documents", "SELECT doc_id, substr(text, 5, 40) AS a, substr(text, 1, 6) AS b FROM documents")
_sql("fn_instr_text", "SELECT doc_id, instr(text, 'é') AS a, instr(text, 'the') AS b FROM documents")
_sql("fn_substr", "SELECT n_nationkey, substr(n_name, 0, 3) AS a, substr(n_name, 2) AS b, substr(n_name, 1, -1) AS c FROM nation", "SELECT n_nationkey, substr(n_name, 1, 3) AS a, substr(n_name, 2) AS b, '' AS c FROM nation")
_sql("fn_instr", "SELECT n_nationkey, instr(n_name, 'A') AS x FROM nation")
_sql("fn_replace", "SELECT n_nationkey, replace(n_name, 'A', '**') AS x FROM nation")
_sql("fn_nullif", "SELECT n_nationkey, nullif(n_regionkey, 2) AS x FROM nation")
_sql("fn_coalesce", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 2), nullif(n_nationkey, 3), -1) AS x FROM nation", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 2), nullif(n_nationkey, 3), -1)::BIGINT AS x FROM nation")
_sql("fn_ifnull", "SELECT n_nationkey, ifnull(nullif(n_name, 'FRANCE'), '?') AS x FROM nation")
_sql("fn_json_extract", "SELECT event_id, json_extract(props, '$.k') AS x FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS x FROM events")
_sql("fn_json_set", "SELECT event_id, json_set(props, '$.city', 'Paris') AS x FROM events", """SELECT event_id, regexp_replace(props, '\\s*\\}\\s*$', '') || ',"city":"Paris"}' AS x FROM events""")
_dsl(
    "dsl_scalars",
    lambda db: db.from_(CUSTOMERS)
    .select("c_custkey")
    .lower_column(_C.c_name)
    .length_column(_C.c_mktsegment)
    .substr_column(_C.c_mktsegment, 1, 3)
    .instr_column(_C.c_mktsegment, "I")
    .typeof_column(_C.c_acctbal)
    .to_df(),
    f"SELECT c_custkey, translate(c_name, '{UPPER}', '{LOWER}') AS lower, strlen(c_mktsegment) AS length, substr(c_mktsegment, 1, 3) AS substr, instr(c_mktsegment, 'I') AS instr, 'real' AS typeof FROM customer",
)
_dsl("dsl_where_lower", lambda db: db.from_(CUSTOMERS).where_lower(_C.c_mktsegment, "building").select("c_custkey").to_df(), "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
_dsl("dsl_where_json", lambda db: db.from_(EVENTS).where_json_extract(_E.props, "$.k", "=", "3").select("event_id").to_df(), "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '3'")
_dsl("dsl_not_in_values", lambda db: db.from_(ORDERS).where_not_in_values(_O.o_orderstatus, ["F", None]).select("o_orderkey").to_df(), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
_dsl("dsl_paged", lambda db: db.from_(ORDERS).where(_O.o_totalprice.between(1000, 50000)).order_by(_O.o_orderkey.desc()).limit(20).offset(3).select("o_orderkey").to_df(), "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 ORDER BY o_orderkey DESC LIMIT 20 OFFSET 3")

# Writing, over a copy of a table that has a key
_MAKE = "CREATE TABLE n (id INTEGER PRIMARY KEY, name TEXT, region INTEGER DEFAULT 9); INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM nation; "
_ROWS = "SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region FROM nation"
_GET = "SELECT id, name, region FROM n"
_sql("dml_insert_values", _GET, f"{_ROWS} UNION ALL VALUES (100, 'a', 1), (101, NULL, 2)", before=_MAKE + "INSERT INTO n VALUES (100, 'a', 1), (101, NULL, 2)")
_sql("dml_insert_select", _GET, f"{_ROWS} UNION ALL SELECT r_regionkey + 200, r_name, 9 FROM region", before=_MAKE + "INSERT INTO n (id, name) SELECT r_regionkey + 200, r_name FROM region")
_sql("dml_insert_defaults", "SELECT a, b FROM d", "SELECT NULL::VARCHAR AS a, 7::BIGINT AS b", before="CREATE TABLE d (a TEXT, b INTEGER DEFAULT 7); INSERT INTO d DEFAULT VALUES")
_sql("dml_insert_ignore", _GET, f"{_ROWS} UNION ALL VALUES (50, 'new', 1)", before=_MAKE + "INSERT OR IGNORE INTO n VALUES (3, 'x', 1), (50, 'new', 1), (50, 'newer', 1), (NULL, 'z', 1)")
_sql("dml_do_nothing", _GET, f"{_ROWS} UNION ALL VALUES (51, 'new', 1)", before=_MAKE + "INSERT INTO n VALUES (3, 'x', 1), (51, 'new', 1) ON CONFLICT (id) DO NOTHING")
_sql("dml_replace", _GET, f"SELECT * FROM ({_ROWS}) WHERE id <> 3 UNION ALL VALUES (3, 'x', 1), (52, 'new', 2)", before=_MAKE + "INSERT OR REPLACE INTO n VALUES (3, 'w', 1), (3, 'x', 1), (52, 'new', 2)")
_sql(
    "dml_do_update",
    _GET,
    f"SELECT id, CASE WHEN id < 5 THEN name || '!' ELSE name END AS name, CASE WHEN id < 5 THEN region + 100 ELSE region END AS region FROM ({_ROWS}) UNION ALL VALUES (77, 'y', 5)",
    before=_MAKE + "INSERT INTO n SELECT n_nationkey, n_name || '!', 100 FROM nation WHERE n_nationkey < 5 ON CONFLICT (id) DO UPDATE SET name = excluded.name, region = region + excluded.region; INSERT INTO n VALUES (77, 'y', 5) ON CONFLICT (id) DO UPDATE SET name = 'never'",
)
_sql("dml_do_update_where", _GET, f"SELECT id, CASE WHEN region = 1 AND id < 10 THEN 'hit' ELSE name END AS name, region FROM ({_ROWS})", before=_MAKE + "INSERT INTO n SELECT n_nationkey, 'hit', 0 FROM nation WHERE n_nationkey < 10 ON CONFLICT (id) DO UPDATE SET name = excluded.name WHERE n.region = 1")
_sql("dml_update", _GET, f"SELECT id, CASE WHEN region = 2 THEN 'two' ELSE name END AS name, region FROM ({_ROWS})", before=_MAKE + "UPDATE n SET name = 'two' WHERE region = 2")
_sql("dml_update_expr", _GET, f"SELECT id, name, CASE WHEN id > 20 THEN id + region ELSE region END AS region FROM ({_ROWS})", before=_MAKE + "UPDATE n SET region = id + region WHERE id > 20")
_sql("dml_update_from", _GET, f"SELECT id, coalesce(r_name, name) AS name, region FROM ({_ROWS}) LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON region = r_regionkey", before=_MAKE + "UPDATE n SET name = region.r_name FROM region WHERE n.region = region.r_regionkey AND region.r_regionkey < 3")
_sql("dml_delete", _GET, f"SELECT * FROM ({_ROWS}) WHERE NOT region = 2", before=_MAKE + "DELETE FROM n WHERE region = 2")
_sql("dml_delete_in", _GET, f"SELECT * FROM ({_ROWS}) WHERE region NOT IN (0, 1)", before=_MAKE + "DELETE FROM n WHERE region IN (SELECT r_regionkey FROM region WHERE r_regionkey < 2)")

# Foreign keys, triggers, transactions, schema changes
_FK = "CREATE TABLE p (k INTEGER PRIMARY KEY); INSERT INTO p SELECT r_regionkey FROM region; CREATE TABLE c (id INTEGER PRIMARY KEY, k INTEGER REFERENCES p(k) {}); INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; "
_KIDS = "SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS k FROM nation"
_sql("fk_cascade_delete", "SELECT id, k FROM c", f"SELECT * FROM ({_KIDS}) WHERE k <> 1", before=_FK.format("ON DELETE CASCADE") + "DELETE FROM p WHERE k = 1")
_sql("fk_set_null", "SELECT id, k FROM c", f"SELECT id, nullif(k, 1) AS k FROM ({_KIDS})", before=_FK.format("ON DELETE SET NULL") + "DELETE FROM p WHERE k = 1")
_sql("fk_cascade_update", "SELECT id, k FROM c", f"SELECT id, CASE WHEN k = 1 THEN 77 ELSE k END AS k FROM ({_KIDS})", before=_FK.format("ON UPDATE CASCADE") + "UPDATE p SET k = 77 WHERE k = 1")
_sql("fk_update_set_null", "SELECT id, k FROM c", f"SELECT id, nullif(k, 1) AS k FROM ({_KIDS})", before=_FK.format("ON UPDATE SET NULL") + "UPDATE p SET k = 77 WHERE k = 1")
_sql(
    "fk_composite_cascade",
    "SELECT id, a, b FROM c2",
    "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_regionkey = 3 THEN 30 ELSE n_regionkey END::BIGINT AS a, (CASE WHEN n_regionkey = 3 THEN 31 ELSE n_regionkey + 1 END)::BIGINT AS b FROM nation",
    before="CREATE TABLE p2 (a INTEGER, b INTEGER, PRIMARY KEY (a, b)); INSERT INTO p2 SELECT r_regionkey, r_regionkey + 1 FROM region; CREATE TABLE c2 (id INTEGER PRIMARY KEY, a INTEGER, b INTEGER, FOREIGN KEY (a, b) REFERENCES p2 (a, b) ON UPDATE CASCADE ON DELETE CASCADE); INSERT INTO c2 SELECT n_nationkey, n_regionkey, n_regionkey + 1 FROM nation; UPDATE p2 SET a = 30, b = 31 WHERE a = 3",
)
_AUDIT = _MAKE + "CREATE TABLE audit (kind TEXT, a TEXT, b TEXT); "
_sql("trigger_after_insert", "SELECT kind, a, b FROM audit", "SELECT 'insert' AS kind, r_name AS a, (r_regionkey + 300)::VARCHAR AS b FROM region", before=_AUDIT + "CREATE TRIGGER t AFTER INSERT ON n BEGIN INSERT INTO audit VALUES ('insert', NEW.name, NEW.id); END; INSERT INTO n SELECT r_regionkey + 300, r_name, 1 FROM region")
_sql("trigger_after_update", "SELECT kind, a, b FROM audit", "SELECT 'update' AS kind, n_name AS a, 'x' AS b FROM nation WHERE n_regionkey = 4", before=_AUDIT + "CREATE TRIGGER t AFTER UPDATE ON n FOR EACH ROW BEGIN INSERT INTO audit VALUES ('update', OLD.name, NEW.name); END; UPDATE n SET name = 'x' WHERE region = 4")
_sql("trigger_after_delete", "SELECT kind, a, b FROM audit", "SELECT 'delete' AS kind, n_name AS a, NULL::VARCHAR AS b FROM nation WHERE n_regionkey = 4", before=_AUDIT + "CREATE TRIGGER t AFTER DELETE ON n BEGIN INSERT INTO audit VALUES ('delete', OLD.name, NULL); END; DELETE FROM n WHERE region = 4")
_sql("txn_rollback", _GET, _ROWS, before=_MAKE + "BEGIN; DELETE FROM n; ROLLBACK")
_sql("txn_savepoint", _GET, f"SELECT * FROM ({_ROWS}) WHERE id > 3", before=_MAKE + "BEGIN IMMEDIATE; DELETE FROM n WHERE id <= 3; SAVEPOINT s; DELETE FROM n; ROLLBACK TO s; RELEASE s; COMMIT")
_sql("alter_add_column", "SELECT id, name, extra FROM n", "SELECT n_nationkey::BIGINT AS id, n_name AS name, NULL::VARCHAR AS extra FROM nation", before=_MAKE + "ALTER TABLE n ADD COLUMN extra TEXT")
_sql("alter_rename_column", "SELECT id, title FROM m", "SELECT n_nationkey::BIGINT AS id, n_name AS title FROM nation", before=_MAKE + "ALTER TABLE n RENAME COLUMN name TO title; ALTER TABLE n RENAME TO m")
_sql("alter_drop_column", "SELECT * FROM n", "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation", before=_MAKE + "ALTER TABLE n DROP COLUMN region")
_sql("params_positional", "SELECT o_orderkey FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?2", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000", params=["F", 250000])
_sql("params_named", "SELECT o_orderkey FROM orders WHERE o_orderstatus = :s AND o_totalprice > @p", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000", params={"s": "F", "p": 250000})
_sql("explain_scan", "EXPLAIN QUERY PLAN SELECT * FROM orders ORDER BY o_orderkey", "SELECT 'SCAN orders USE TEMP B-TREE FOR ORDER BY' AS detail")
_sql("explain_index", "EXPLAIN QUERY PLAN SELECT * FROM orders WHERE o_orderkey = 7", "SELECT 'SEARCH orders USING INDEX o_key (o_orderkey=?)' AS detail", before="CREATE INDEX o_key ON orders (o_orderkey)")
_sql("pragma_user_version", "PRAGMA user_version", "SELECT 42::BIGINT AS user_version", before="PRAGMA user_version = 42")
_sql("pragma_foreign_keys", "PRAGMA foreign_keys", "SELECT 0::BIGINT AS foreign_keys", before="PRAGMA foreign_keys = OFF")
_sql("pragma_journal_mode", "PRAGMA journal_mode", "SELECT 'wal' AS journal_mode", before="PRAGMA journal_mode = WAL")

# What the dialect's guide promises beyond that
_sql("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
_sql("derived_table", "SELECT s.k, s.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) s WHERE s.n > 14")
_sql("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
_sql("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
_sql("intersect", "SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region")
_sql("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region")
_sql("count_distinct", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
_sql("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
_sql("window_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders", "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INTEGER AS r FROM orders")
_sql("multi_key_group", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
_sql("join_outer_keyword", "SELECT r_name, n_name FROM region LEFT OUTER JOIN nation ON r_regionkey = n_regionkey AND n_nationkey != 3")


# What statements are refused for, and what they leave


def _tried(name: str, before: str, attempts: list[tuple[str, str]], after: str = "") -> None:
    """Statements in turn, each with what comes of it: a number of changes, or the name of an error."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db, out = open_db(spark, sf_dir, before), []
        db.exec(before)
        for i, (text, _) in enumerate(attempts):
            try:
                outcome = str(db.exec(text).changes)
            except DatabaseError as e:
                outcome = type(e).__name__
            out.append((i, outcome))
        return spark.createDataFrame(out, "i int, outcome string")

    QUERIES[name] = run
    ORACLES[name] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, (_, x) in enumerate(attempts)) + ") AS t(i, outcome)"


_BROKEN = "ConstraintViolation"
_tried(
    "keys_refuse",
    _MAKE + "CREATE TABLE m (a INTEGER, b INTEGER, c TEXT UNIQUE, d INTEGER NOT NULL, PRIMARY KEY (a, b)); INSERT INTO m VALUES (1, 1, 'x', 0), (1, 2, NULL, 0)",
    [
        ("INSERT INTO n VALUES (3, 'again', 1)", _BROKEN),
        ("INSERT INTO n VALUES (NULL, 'none', 1)", _BROKEN),
        ("INSERT INTO n VALUES (800, 'a', 1), (800, 'b', 1)", _BROKEN),
        ("UPDATE n SET id = 4 WHERE id = 5", _BROKEN),
        ("INSERT INTO n SELECT n_nationkey + 20, n_name, 1 FROM nation", _BROKEN),
        ("INSERT INTO m VALUES (1, 2, 'y', 0)", _BROKEN),
        ("INSERT INTO m VALUES (2, 2, 'x', 0)", _BROKEN),
        ("INSERT INTO m VALUES (2, 2, NULL, 0), (2, 3, NULL, 0)", "2"),
        ("INSERT INTO m VALUES (3, 3, 'z', NULL)", _BROKEN),
        ("UPDATE m SET d = NULL", _BROKEN),
        ("UPDATE m SET c = 'w' WHERE b = 3", "1"),
    ],
)
_tried(
    "unique_index_refuses",
    _MAKE + "CREATE UNIQUE INDEX by_name ON n (name)",
    [
        ("INSERT INTO n SELECT 900, n_name, 1 FROM nation WHERE n_nationkey = 3", _BROKEN),
        ("INSERT INTO n VALUES (900, NULL, 1), (901, NULL, 1)", "2"),
        ("CREATE UNIQUE INDEX by_region ON n (region)", _BROKEN),
        ("DROP INDEX by_name", "0"),
        ("INSERT INTO n SELECT 902, n_name, 1 FROM nation WHERE n_nationkey = 3", "1"),
        ("CREATE INDEX by_name ON n (name)", "0"),
        ("CREATE INDEX by_name ON n (name)", "IndexExists"),
    ],
)
_tried(
    "fk_refuses",
    _FK.format("ON DELETE RESTRICT ON UPDATE NO ACTION"),
    [
        ("INSERT INTO c VALUES (100, 99)", _BROKEN),
        ("INSERT INTO c VALUES (100, NULL), (101, 4)", "2"),
        ("DELETE FROM p WHERE k = 1", _BROKEN),
        ("UPDATE p SET k = 70 WHERE k = 1", _BROKEN),
        ("UPDATE c SET k = 55 WHERE id = 3", _BROKEN),
        ("DELETE FROM c WHERE k = 1", "5"),
        ("DELETE FROM p WHERE k = 1", "1"),
        ("PRAGMA foreign_keys = OFF", "0"),
        ("DELETE FROM p WHERE k = 2", "1"),
    ],
)
_tried(
    "check_refuses",
    "CREATE TABLE t (id INTEGER PRIMARY KEY CHECK (id > 0), n INTEGER, CHECK (n < 10)); INSERT INTO t VALUES (1, 5)",
    [("INSERT INTO t VALUES (0, 1)", _BROKEN), ("INSERT INTO t VALUES (2, NULL)", "1"), ("UPDATE t SET n = n + 5", _BROKEN), ("UPDATE t SET n = n + 4", "2")],
)
_tried(
    "drops",
    _MAKE + "CREATE VIEW v AS SELECT id FROM n; CREATE INDEX i ON n (region); CREATE TRIGGER g AFTER DELETE ON n BEGIN DELETE FROM n; END",
    [
        ("DROP VIEW v", "0"),
        ("SELECT * FROM v", "UnknownTable"),
        ("DROP VIEW v", "UnknownView"),
        ("DROP INDEX i", "0"),
        ("DROP INDEX i", "UnknownIndex"),
        ("DROP TRIGGER g", "0"),
        ("DROP TRIGGER g", "UnknownTrigger"),
        ("DELETE FROM n WHERE id = 1", "1"),
        ("DROP TABLE n", "0"),
        ("SELECT * FROM n", "UnknownTable"),
        ("DROP TABLE IF EXISTS n", "0"),
        ("DROP TABLE n", "UnknownTable"),
    ],
)
_tried(
    "changes",
    _MAKE,
    [
        ("INSERT INTO n SELECT r_regionkey + 100, r_name, 1 FROM region", "5"),
        ("INSERT OR IGNORE INTO n VALUES (1, 'x', 1), (200, 'y', 1)", "1"),
        ("UPDATE n SET name = 'z' WHERE region = 3", "5"),
        ("UPDATE n SET name = 'z' WHERE region = 77", "0"),
        ("DELETE FROM n WHERE id >= 100", "6"),
        ("DELETE FROM n", "25"),
    ],
)

_sql("rollback_to_savepoint", _GET, f"SELECT * FROM ({_ROWS}) WHERE id > 3", before=_MAKE + "BEGIN TRANSACTION; DELETE FROM n WHERE id <= 3; SAVEPOINT s; DELETE FROM n; ROLLBACK TRANSACTION TO SAVEPOINT s; END TRANSACTION")
_sql("pragma_application_id", "PRAGMA application_id", "SELECT 4711::BIGINT AS application_id", before="PRAGMA application_id = 4711")
_sql("fk_set_default", "SELECT id, k FROM c", f"SELECT id, CASE WHEN k = 1 THEN 4 ELSE k END AS k FROM ({_KIDS})", before=_FK.replace("k INTEGER REF", "k INTEGER DEFAULT 4 REF").format("ON DELETE SET DEFAULT") + "DELETE FROM p WHERE k = 1")
_sql("datetime_text", "SELECT event_id, datetime('2024-01-31 10:20:30') AS a, datetime('2024-01-31') AS b, datetime('none') AS c FROM events", "SELECT event_id, '2024-01-31 10:20:30' AS a, '2024-01-31 00:00:00' AS b, NULL::VARCHAR AS c FROM events")
_sql(
    "trigger_before_insert",
    "SELECT kind, a, b FROM audit",
    "SELECT 'x' AS kind, r_name AS a, NULL::VARCHAR AS b FROM region UNION ALL SELECT 'y', (r_regionkey + 300)::VARCHAR, r_name FROM region",
    before=_AUDIT + "CREATE TRIGGER t BEFORE INSERT ON n BEGIN INSERT INTO audit VALUES ('x', NEW.name, NULL); INSERT INTO audit VALUES ('y', NEW.id, NEW.name); END; INSERT INTO n SELECT r_regionkey + 300, r_name, 1 FROM region",
)
_sql(
    "trigger_update_body",
    "SELECT k, n FROM counts",
    "SELECT r_regionkey::BIGINT AS k, CASE WHEN r_regionkey = 2 THEN 1 ELSE 0 END::BIGINT AS n FROM region",
    before=_MAKE + "CREATE TABLE counts (k INTEGER PRIMARY KEY, n INTEGER); INSERT INTO counts SELECT r_regionkey, 0 FROM region; CREATE TRIGGER t AFTER INSERT ON n BEGIN UPDATE counts SET n = n + 1 WHERE k = NEW.region; END; INSERT INTO n VALUES (400, 'a', 2)",
)
_sql(
    "trigger_insert_select",
    "SELECT kind, a, b FROM audit",
    "SELECT 'gone' AS kind, r_name AS a, n_name AS b FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey = 4",
    before=_AUDIT + "CREATE TABLE r (k INTEGER, name TEXT); INSERT INTO r SELECT r_regionkey, r_name FROM region; CREATE TRIGGER t AFTER DELETE ON n BEGIN INSERT INTO audit SELECT 'gone', name, OLD.name FROM r WHERE k = OLD.region; END; DELETE FROM n WHERE region = 4",
)
_sql(
    "trigger_delete_body",
    "SELECT id, k FROM kids",
    f"SELECT * FROM ({_KIDS}) WHERE k <> 1",
    before="CREATE TABLE p (k INTEGER PRIMARY KEY); INSERT INTO p SELECT r_regionkey FROM region; CREATE TABLE kids (id INTEGER, k INTEGER); INSERT INTO kids SELECT n_nationkey, n_regionkey FROM nation; CREATE TRIGGER t AFTER DELETE ON p BEGIN DELETE FROM kids WHERE k = OLD.k; END; DELETE FROM p WHERE k = 1",
)
_sql(
    "upsert_repeated",
    "SELECT id, name, region FROM n",
    f"SELECT * FROM ({_ROWS}) WHERE id > 1 UNION ALL SELECT id, 'v' || (2998 + id), 2998 + id FROM (VALUES (0), (1)) AS t(id) UNION ALL SELECT 500, 'v3000', 3000",
    before=_MAKE + "CREATE VIRTUAL TABLE s USING generate_series(1, 3000); INSERT INTO n SELECT CASE WHEN value % 3 = 0 THEN 500 WHEN value % 3 = 1 THEN 0 ELSE 1 END, 'v' || value, value FROM s ON CONFLICT (id) DO UPDATE SET name = excluded.name, region = excluded.region",
)


@dataclass
class Nation:
    id: int
    name: str | None
    region: int | None


_NATIONS = TypedTable("typed", Nation)


def _typed_nations(db: Database) -> None:
    db.create_table(_NATIONS, primary_key=_NATIONS.c.id)
    db.exec("INSERT INTO typed SELECT n_nationkey, n_name, n_regionkey FROM nation")


def _mutated(db: Database) -> DataFrame:
    _typed_nations(db)
    c, q = _NATIONS.c, db.from_(_NATIONS)
    q.insert([Nation(700, "new", 1), Nation(701, None, None)])
    q.insert_ignore(Nation(700, "other", 2))
    q.insert_replace(Nation(3, "three", 3))
    q.update({"name": "one"}).where(c.region.eq(1)).execute()
    q.delete().where(c.id.gt(700)).execute()
    return db.table_df("typed")


_dsl("typed_mutations", _mutated, "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey = 3 THEN 'three' WHEN n_regionkey = 1 THEN 'one' ELSE n_name END AS name, CASE WHEN n_nationkey = 3 THEN 3 ELSE n_regionkey END::BIGINT AS region FROM nation UNION ALL SELECT 700, 'one', 1")


def _fetched(db: Database) -> DataFrame:
    _typed_nations(db)
    found = db.from_(_NATIONS).where(_NATIONS.c.region.eq(2)).fetch_typed()
    one = db.from_(_NATIONS).where(_NATIONS.c.id.eq(7)).fetch_one_typed()
    return db.spark.createDataFrame([(x.id, x.name) for x in [*found, one]], "id long, name string")


_dsl("typed_fetch", _fetched, "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")


def _catalog_calls(db: Database) -> DataFrame:
    _typed_nations(db)
    db.rename_table(_NATIONS, "kept")
    db.add_column("kept", "extra", int)
    db.rename_column("kept", "name", "title")
    db.drop_column("kept", "region")
    db.create_view("few", "SELECT id, title, extra FROM kept WHERE id < 5")
    db.exec("CREATE TABLE gone (id INTEGER); INSERT INTO gone VALUES (1), (2)")
    db.truncate("gone")
    return db.query("SELECT id, title, extra FROM few UNION ALL SELECT id, 'left', 0 FROM gone")


_dsl("catalog_calls", _catalog_calls, "SELECT n_nationkey::BIGINT AS id, n_name AS title, NULL::BIGINT AS extra FROM nation WHERE n_nationkey < 5")


def _migrated(db: Database) -> DataFrame:
    m = Migrator([Migration(2, "INSERT INTO log VALUES (2)", "DELETE FROM log WHERE v = 2"), Migration(3, "INSERT INTO log VALUES (3)", "DELETE FROM log WHERE v = 3")])
    m.add(Migration(1, "CREATE TABLE log (v INTEGER); INSERT INTO log SELECT r_regionkey + 100 FROM region", "DROP TABLE log"))
    seen = [m.apply(db), m.rollback(db), m.apply(db), m.rollback(db)]
    return db.query("SELECT v FROM log").union(db.spark.createDataFrame([(x + 1000,) for x in seen], "v long"))


_dsl("migrations", _migrated, "SELECT r_regionkey::BIGINT + 100 AS v FROM region UNION ALL VALUES (2), (1003), (1003), (1003), (1003)")


def _prepared(db: Database) -> DataFrame:
    p = db.prepare("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = ? AND n_nationkey > ?")
    first = p.bind(1, 1).bind(2, 2).step().df
    p.reset()
    return first.union(p.bind(1, 4).bind(2, 10).step().df)


_dsl("prepared_steps", _prepared, "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2 OR n_regionkey = 4 AND n_nationkey > 10")


def _transactions(db: Database) -> DataFrame:
    db.exec(_MAKE)
    with db.transaction():
        db.exec("DELETE FROM n WHERE region = 0")
    try:
        with db.transaction():
            db.exec("DELETE FROM n")
            raise RuntimeError
    except RuntimeError:
        pass
    return db.query(_GET)


_dsl("transaction_callback", _transactions, f"SELECT * FROM ({_ROWS}) WHERE region <> 0")


def _round_trip(db: Database) -> DataFrame:
    """Through a .db file, in the shared scratch folder."""
    path = f"{scratch_root(db.spark).removeprefix('file://')}/trip-{uuid.uuid4().hex}.db"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    db.exec(_MAKE + "CREATE VIEW v AS SELECT id, name, region FROM n WHERE region = 3; PRAGMA user_version = 5")
    own = Database(db.spark)
    own.state = replace(db.state, tables={"n": db.state.table("n")})
    export_file(own, path)
    back = Database(db.spark)
    import_file(back, path)
    return back.query(f"SELECT id, name, region FROM v UNION ALL SELECT {back.state.user_version}, 'version', count(*) FROM n")


_dsl("db_file_round_trip", _round_trip, f"SELECT * FROM ({_ROWS}) WHERE region = 3 UNION ALL SELECT 5, 'version', count(*) FROM nation")
