"""The dialect over streams: queries of streaming DataFrames, and sinks that write to a database's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..database import Database
from ..operators import dml
from ..sources.store import scratch
from ..sql.select import Params
from ..sql.tokens import tokenize


def stream_query(db: Database, sql: str, streams: dict[str, DataFrame], params: list | dict | None = None) -> DataFrame:
    """A query of the dialect in which some names are streams; the others are the database's tables as they are now (those
    with unstored changes are stored first, since a stream's plan may hold no pending ones). Windows and watermarks are
    Spark's own functions."""
    tokens, views = tokenize(sql), {}
    for name in {t.text.lower() for t in tokens if t.named} & set(db.state.tables):
        own = db.state.table(name)
        df = db.table_df(name)
        views[name] = db._temp(f"static {name}", df if own.parts is not None and not own.added else scratch(df))
    for name, df in streams.items():
        views[name.lower()] = view = f"mr_stream_{db._id}_{name.lower()}"
        df.createOrReplaceTempView(view)
    return db._select(tokens, Params(params), None, views)


def stream_into(db: Database, table: str, df: DataFrame, key: tuple[str, ...] = ()) -> DataStreamWriter:
    """A writer that puts each batch into a table: by inserting, or with ``key`` by replacing the rows of equal keys, which
    makes a batch that comes twice harmless. Options such as the checkpoint folder and the trigger are the caller's."""

    def put(batch: DataFrame, _: int) -> None:
        own = db.state.table(table)
        rows = db._incoming(own, batch.columns, batch)
        if not key:
            db._change(lambda: db._write(lambda s: dml.insert(s, table, rows)))
            return
        others = [c for c in own.names if c.lower() not in {k.lower() for k in key}]

        def build(_joined: DataFrame):
            return {c: F.col(f"n_{c}") for c in others}, None

        build.of_new = True
        db._change(lambda: db._write(lambda s: dml.upsert(s, table, rows, key, build)))

    return df.writeStream.foreachBatch(put)
