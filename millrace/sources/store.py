"""Storage: Parquet parts for each table, and a manifest that names those that count."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import errors
from ..catalog import Column, ForeignKey, Index, Key, Snapshot, Table, Trigger, View


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that setting is unset, a folder of our own if driver and executors
    are one process; on a cluster, whose machines share no such folder, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise errors.DatabaseError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def keep(df: DataFrame, folder: str) -> tuple[DataFrame, str]:
    """Write df to a new part in folder; the part read back, and its path."""
    path = f"{folder}/part-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: What a statement may hold in the driver: frames that Catalyst puts at so many bytes at most, and that have so many rows.
LOCAL_BYTES, LOCAL_ROWS = 8 << 20, 50_000


def scratch(df: DataFrame) -> DataFrame:
    """df without the plan behind it: a local relation if it is small by Catalyst's estimate, else written and read back."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= LOCAL_BYTES:
        rows = df.limit(LOCAL_ROWS + 1).toArrow()
        if rows.num_rows <= LOCAL_ROWS:
            return df.sparkSession.createDataFrame(rows, df.schema)
    return keep(df, f"{scratch_root(df.sparkSession)}/millrace")[0]


def files_of(parts: Sequence[str], found: Sequence[str]) -> dict[str, str]:
    """Path of each file by its name. parts: folders and files as a manifest names them; found: what Spark found there."""
    known, out = {p.rsplit("/", 1)[1]: p for p in parts}, {}
    for f in found:
        folder, name = f.rsplit("/", 2)[-2:]
        out[name] = known[name] if name in known else f"{known[folder]}/{name}"
    return out


class Store:
    """A folder that any Hadoop file system holds. A commit writes parts, then a manifest of the next number; manifests
    and parts are written once, so a commit that is broken off changes nothing. Readers take the highest manifest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def last(self) -> int:
        p, fs = self._fs(f"{self.path}/_manifests")
        if not fs.exists(p):
            return 0
        return max((int(x.getPath().getName().split(".")[0]) for x in fs.listStatus(p) if x.getPath().getName().endswith(".json")), default=0)

    def load(self) -> Snapshot | None:
        n = self.last()
        if not n:
            return None
        try:
            text = self.spark.read.text(f"{self.path}/_manifests/{n}.json", wholetext=True).first()[0]
            return _decode(self.spark, json.loads(text))
        except (ValueError, KeyError, TypeError) as e:
            raise errors.Corrupt(f"{self.path}: {e}") from e

    def save(self, state: Snapshot) -> Snapshot:
        """Write what isn't stored yet: added rows as further parts, changed tables anew."""
        for table in state.tables.values():
            if table.series or (table.parts is not None and not table.added):
                continue
            folder, parts = f"{self.path}/{table.name.lower()}", list(table.parts or ())
            # an index orders the rows of each file, so that their statistics say where its values are
            index = next((i.columns for i in state.indexes.values() if i.table.lower() == table.name.lower()), ())
            for df in table.added if table.parts is not None else (table.df,):
                parts.append(keep(df.sortWithinPartitions(*index) if index else df, folder)[1])
            df = self.spark.read.schema(table.schema).parquet(*parts)
            state = state.put_table(_with(table, df, tuple(parts)))
        p, fs = self._fs(f"{self.path}/_manifests/{self.last() + 1}.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(_encode(state)).encode()))
        out.close()
        return state

    def vacuum(self, state: Snapshot) -> int:
        """Delete the parts and manifests that the newest manifest doesn't need; how many parts went."""
        n, gone = self.last(), 0
        # a part is needed whole, or some of its files are
        whole = {p.rsplit("/", 1)[1] for t in state.tables.values() for p in t.parts or ()}
        some = {p.rsplit("/", 2)[1] for t in state.tables.values() for p in t.parts or ()}
        root, fs = self._fs(self.path)
        for folder in fs.listStatus(root):
            for x in fs.listStatus(folder.getPath()):
                name = x.getPath().getName()
                if name.startswith("part-") and name not in whole | some:
                    gone += fs.delete(x.getPath(), True)
                elif name in some and name not in whole:
                    for y in fs.listStatus(x.getPath()):
                        if y.getPath().getName().endswith(".parquet") and y.getPath().getName() not in whole:
                            fs.delete(y.getPath(), False)
                elif name.endswith(".json") and name != f"{n}.json":
                    fs.delete(x.getPath(), False)
        return gone


def _with(table: Table, df: DataFrame, parts: tuple[str, ...]) -> Table:
    from dataclasses import replace

    return replace(table, df=df, parts=parts, added=(), steps=0)


def _encode(state: Snapshot) -> dict:
    def table(t: Table) -> dict:
        return {
            "name": t.name,
            "columns": [[c.name, c.declared, c.type.json(), c.not_null, c.default] for c in t.columns],
            "keys": [[list(k.columns), k.primary, k.index] for k in t.keys],
            "checks": list(t.checks),
            "foreign": [[list(f.columns), f.parent, list(f.parent_columns), f.on_delete, f.on_update] for f in t.foreign],
            "parts": list(t.parts or ()),
            "next_rid": t.next_rid,
            "series": t.series,
        }

    return {
        "tables": [table(t) for t in state.tables.values()],
        "indexes": [[i.name, i.table, list(i.columns), i.unique] for i in state.indexes.values()],
        "views": [[v.name, v.sql] for v in state.views.values()],
        "triggers": [[t.name, t.table, t.timing, t.event, t.body, t.when, list(t.of)] for t in state.triggers.values()],
        "settings": [state.foreign_keys, state.user_version, state.application_id, state.journal_mode],
    }


def _decode(spark: SparkSession, x: dict) -> Snapshot:
    tables = {}
    for t in x["tables"]:
        columns = tuple(Column(a, b, T._parse_datatype_json_string(c), d, e) for a, b, c, d, e in t["columns"])
        own = Table(
            t["name"],
            columns,
            tuple(Key(tuple(a), b, c) for a, b, c in t["keys"]),
            tuple(ForeignKey(tuple(a), b, tuple(c), d, e) for a, b, c, d, e in t["foreign"]),
            checks=tuple(t.get("checks", ())),
            next_rid=t["next_rid"],
            parts=tuple(t["parts"]),
            series=tuple(t["series"]) if t["series"] else None,
        )
        if own.series:
            df = series(spark, *own.series)
        else:
            df = spark.read.schema(own.schema).parquet(*own.parts) if own.parts else spark.createDataFrame([], own.schema)
        tables[own.name.lower()] = _with(own, df, own.parts)
    return Snapshot(
        tables,
        {i[0].lower(): Index(i[0], i[1], tuple(i[2]), i[3]) for i in x["indexes"]},
        {v[0].lower(): View(*v) for v in x["views"]},
        {t[0].lower(): Trigger(*t[:6], tuple(t[6])) for t in x["triggers"]},
        *x["settings"],
    )


SERIES_ROWS = 1_000_000


def series(spark: SparkSession, start: int, stop: int, step: int) -> DataFrame:
    """start, start + step, ... up to stop: a range that executors make up themselves."""
    from pyspark.sql import functions as F

    if step == 0:
        raise errors.InvalidSql("a step of 0")
    if (stop - start) // step + 1 > SERIES_ROWS:
        raise errors.VirtualTableTooLarge(f"over {SERIES_ROWS} rows")
    df = spark.range(start, stop + (1 if step > 0 else -1), step).toDF("value")
    return df.select(((F.col("value") - start) / step + 1).cast("long").alias("_rid"), "value")
