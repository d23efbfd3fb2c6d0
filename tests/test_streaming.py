from pyspark.sql import functions as F

from millrace.streaming import stream_into, stream_query

from .conftest import DATA


def test_stream_query_and_upsert(spark, db, tmp_path):
    source = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", "event_type", "value")
    source.where("event_id % 2 = 0").write.parquet(f"{tmp_path}/in/a.parquet")
    source.where("event_id % 2 = 1").write.parquet(f"{tmp_path}/in/b.parquet")
    db.exec("CREATE TABLE last (user_id INTEGER PRIMARY KEY, n INTEGER, total REAL); CREATE TABLE kinds (name TEXT)")
    db.from_("kinds")
    first = source.select("event_type").first()[0]
    db.exec("INSERT INTO kinds VALUES (?)", [first])
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    df = stream_query(db, "SELECT user_id, count(*) AS n, sum(value) AS total FROM events JOIN kinds ON event_type = name GROUP BY user_id", {"events": stream})
    query = stream_into(db, "last", df, ("user_id",)).outputMode("update").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination()
    want = {r[0]: (r[1], round(r[2], 6)) for r in source.where(F.col("event_type") == first).groupBy("user_id").agg(F.count("*"), F.sum("value")).collect()}
    assert {r[0]: (r[1], round(r[2], 6)) for r in db.exec("SELECT * FROM last").rows()} == want
