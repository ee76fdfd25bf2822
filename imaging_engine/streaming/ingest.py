"""Streams: debounced ingest, upserts, lookup cache, study lists, appended text, expiring items.

A streaming query is single-flight: what arrives while a batch runs is taken by the next one, as a coalesced request would be. State that hangs on
time is kept by watermarks. The batch forms of the same operators run over the events table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from imaging_engine.operators.ready_files import upsert
from imaging_engine.shared import table

DEBOUNCE = "2 seconds"


def debounced(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """What arrives within the debounce is one batch for the handler; once: all that is there, then end."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=DEBOUNCE)).start()


def upsert_to(folder: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A handler that keeps the last row of each key in a table of versions; a batch that runs again writes its version again, so nothing is doubled."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        if batch_id > 0:
            new = upsert(spark.read.schema(batch.schema).parquet(f"{folder}/v={batch_id - 1}"), new, key)
        new.write.mode("overwrite").parquet(f"{folder}/v={batch_id}")

    return handle


def bursts(events: DataFrame, by: str, gap: str = "10 minutes") -> DataFrame:
    """(by, start, end, n): runs of events that are no further apart than the gap; for streams, events need a watermark on ts."""
    w = F.session_window("ts", gap)
    return events.groupBy(by, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(events: DataFrame, length: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def looked_up(stream: DataFrame, registry: DataFrame, key: str = "hash") -> DataFrame:
    """Stream rows with what the registry table knows of them; a miss keeps the row."""
    return stream.join(registry, key, "left")


def study_lists(commands: DataFrame) -> DataFrame:
    """(session, studies): the list after each batch of set, add and clear commands (session, seq, cmd, study), in any letter case each study once.
    The list of a session is its state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        studies = list(state.get[0].split("\n")) if state.exists and state.get[0] else []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            if row.cmd in ("clear_studies", "set_studies"):
                studies = []
            name = " ".join((row.study or "").split())
            if row.cmd in ("set_studies", "add_studies") and name and name.lower() not in {s.lower() for s in studies}:
                studies.append(name)
        state.update(("\n".join(studies),))
        yield pd.DataFrame({"session": [key[0]], "studies": [", ".join(studies)]})

    return commands.groupBy("session").applyInPandasWithState(step, "session bigint, studies string", "studies string", "update", GroupStateTimeout.NoTimeout)


def appended(messages: DataFrame, by: str, order: str, text: Column) -> DataFrame:
    """Messages of a key as one text in order, each on a line of its own."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return messages.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))


def unexpired(items: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Items that have not outlived their time."""
    return items.where(F.unix_micros(F.col("ts").cast("timestamp")) > F.unix_micros(now.cast("timestamp")) - seconds * 1_000_000)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ts as a timestamp, which watermarks need."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stm01_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bursts(events(spark, sf_dir), "user_id")
    return b.select("user_id", F.date_format("start", "yyyyMMddHHmmss").alias("start"), "n")


def stm02_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(events(spark, sf_dir)).select(F.date_format("start", "yyyyMMddHH").alias("start"), "event_type", "n", "total")


def stm04_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events ask something new: the first of each value; the others are answered by the cache."""
    e = events(spark, sf_dir).withColumn("asked", F.round("value", 1))
    firsts = e.groupBy("event_type", "asked").agg(F.min("event_id").alias("event_id"))
    return firsts.groupBy("event_type").agg(F.count(F.lit(1)).alias("asked"))


def stm07_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's messages of an hour as one text (an hour bounds the text)."""
    e = events(spark, sf_dir).withColumn("k", F.concat_ws("/", "user_id", F.date_format("ts", "yyyyMMddHH")))
    return appended(e, "k", "event_id", F.col("event_type"))


def stm08_unexpired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unexpired(events(spark, sf_dir), F.lit("2024-01-20 00:00:00"), 3600).select("event_id")


_H = "strftime(ts, '%Y%m%d%H')"
SQL = {
    "stm01_bursts": "WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT user_id, strftime(min(ts), '%Y%m%d%H%M%S') AS start, count(*) AS n FROM b GROUP BY user_id, g",
    "stm02_tumbling": f"SELECT {_H} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stm04_cached": "SELECT event_type, count(*) AS asked FROM (SELECT DISTINCT event_type, round(value, 1) FROM events) GROUP BY 1",
    "stm07_appended": f"SELECT user_id || '/' || {_H} AS k, string_agg(event_type, chr(10) ORDER BY event_id) AS text FROM events GROUP BY 1",
    "stm08_unexpired": "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3600 SECOND",
}
QUERIES = {name: globals()[name] for name in SQL}
