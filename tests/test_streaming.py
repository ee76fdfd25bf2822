"""Streams give what the batch forms give."""

import datetime as dt

from pyspark.sql import functions as F

from imaging_engine.streaming import ingest

ROWS = "path string, n long, at timestamp"


def test_upsert_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    t = dt.datetime(2025, 1, 1)
    handle = ingest.upsert_to(str(tmp_path / "out"), "path", "n")
    for rows in ([("a", 1, t), ("b", 1, t), ("a", 2, t)], [("b", 3, t), ("c", 1, t)]):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(src)
        q = ingest.debounced(spark.readStream.schema(ROWS).parquet(src), handle, str(tmp_path / "cp"), once=True)
        q.awaitTermination(120)
        assert q.exception() is None
    last = spark.read.parquet(str(tmp_path / "out/v=1"))
    assert sorted((r.path, r.n) for r in last.collect()) == [("a", 2), ("b", 3), ("c", 1)]
    handle(spark.createDataFrame([("b", 3, t), ("c", 1, t)], ROWS), 1)  # a batch that runs again changes nothing
    assert sorted((r.path, r.n) for r in spark.read.parquet(str(tmp_path / "out/v=1")).collect()) == [("a", 2), ("b", 3), ("c", 1)]


def test_closed_windows_equal_batch(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows = [(k % 3, "x", float(k), t + dt.timedelta(minutes=7 * k)) for k in range(60)]
    schema = "user_id long, event_type string, value double, ts timestamp"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "10 minutes")
    q = ingest.tumbling(stream).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = max(r[3] for r in rows) - dt.timedelta(minutes=10)
    batch = {tuple(r) for r in ingest.tumbling(df).collect() if r.start + dt.timedelta(hours=1) <= last}
    assert {tuple(r) for r in spark.table("closed").collect()} == batch and len(batch) > 3


def test_study_lists(spark, tmp_path):
    schema = "session long, seq long, cmd string, study string"
    parts = [[(1, 1, "set_studies", " CT  Head "), (1, 2, "add_studies", "ct head"), (1, 3, "add_studies", "MR Knee"), (2, 1, "add_studies", "US")], [(1, 4, "clear_studies", None), (1, 5, "add_studies", "XR"), (2, 2, "add_studies", "CT")]]
    seen = {}
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.study_lists(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.foreachBatch(lambda b, _: seen.update({r.session: r.studies for r in b.collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert seen == {1: "XR", 2: "US, CT"}


def test_lookup_keeps_misses(spark):
    df = spark.createDataFrame([("h1", 1), ("h2", 2)], "hash string, n int")
    reg = spark.createDataFrame([("h1", "/u")], "hash string, url string")
    assert sorted(ingest.looked_up(df, reg).select("n", F.coalesce("url", F.lit("-"))).collect()) == [(1, "/u"), (2, "-")]
