"""Change feeds, capture envelopes and expiry, in batches and streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

EVENT = "resume_token string, timestamp timestamp, collection string, operation_type string, document_id string, full_document string, updated_fields string"


def events(before: DataFrame, after: DataFrame, collection: str, key: str = "_id") -> DataFrame:
    """What changed between two versions of a collection, as change events without tokens or times."""
    body = lambda df, n: df.select(F.col(key).cast("string").alias("document_id"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias(n))
    both = body(before, "b").join(body(after, "a"), "document_id", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    kind = F.when(F.col("b").isNull(), "insert").when(F.col("a").isNull(), "delete").otherwise("update")
    return both.select(F.lit(collection).alias("collection"), kind.alias("operation_type"), "document_id", F.col("a").alias("full_document"), F.col("b").alias("before"))


def stamped(changes: DataFrame, at: Column, first: int = 0) -> DataFrame:
    """Change events with a time and a resume token; tokens are in order, and later calls go on from a greater first."""
    token = F.lpad((F.monotonically_increasing_id() + F.lit(first)).cast("string"), 20, "0")
    return changes.withColumns({"timestamp": at, "resume_token": token})


def resumed(feed: DataFrame, token: str | None) -> DataFrame:
    """The events after a token; all for None."""
    return feed if token is None else feed.where(F.col("resume_token") > token)


def subscribe(feed: DataFrame, collection: str | None = None) -> DataFrame:
    """The events of one collection; of all for None, an empty name or *."""
    return feed if collection in (None, "", "*") else feed.where(F.col("collection") == collection)


def read_feed(spark: SparkSession, path: str, files: int = 50) -> DataFrame:
    """A stream of change events from JSON files; unlike a bus it can be read again from the start."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).json(path)


def envelope(before: Column, after: Column, op: Column, collection: Column, ts_ms: Column, lsn: Column, name: str = "tessera") -> Column:
    """A capture envelope as JSON: before, after, source, op (c, u or d) and time."""
    source = F.struct(F.lit("1.0").alias("version"), F.lit(name).alias("connector"), F.lit(name).alias("name"), ts_ms.alias("ts_ms"), F.lit("false").alias("snapshot"), F.lit("default").alias("db"), collection.alias("collection"), lsn.alias("lsn"))
    return F.to_json(F.struct(F.struct(before.alias("before"), after.alias("after"), source.alias("source"), op.alias("op"), ts_ms.alias("ts_ms")).alias("payload")))


@dataclass
class Deliveries:
    """What a dispatcher has done: batches and events delivered, and tries that failed."""

    batches: int = 0
    delivered: int = 0
    failed: int = 0


def dispatch(stream: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, retries: int = 3, interval: str | None = "100 milliseconds", counts: Deliveries | None = None) -> DataStreamWriter:
    """Hands each micro-batch to deliver, again on failure and then an error, so that nothing is dropped: the batch comes
    once more after a restart. counts: where to count what happened."""
    import time

    counts = counts or Deliveries()

    def run(batch: DataFrame, number: int) -> None:
        for attempt in range(retries + 1):
            try:
                deliver(batch, number)
                counts.batches += 1
                counts.delivered += batch.count()
                return
            except Exception:
                counts.failed += 1
                if attempt == retries:
                    raise
                time.sleep(0.05 * 2**attempt)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)


def metrics(query) -> dict[str, int]:
    """Batches and rows that a running or ended query has taken."""
    done = query.recentProgress
    return {"batches": len(done), "emitted": sum(p["numInputRows"] for p in done)}


def with_expiry(df: DataFrame, inserted: str, ttl: str = "_ttl") -> DataFrame:
    """expire_at of rows with a time to live in seconds; null for the others."""
    return df.withColumn("expire_at", F.col(inserted) + F.make_dt_interval(secs=F.col(ttl).cast("decimal(18,6)")))


def live(df: DataFrame, now: Column, expire: str = "expire_at") -> DataFrame:
    return df.where(F.col(expire).isNull() | (F.col(expire) > now))


def expiry_stats(df: DataFrame, now: Column, expire: str = "expire_at") -> DataFrame:
    return df.agg(F.count(expire).alias("with_ttl"), F.count_if(F.col(expire) <= now).alias("expired"))


def live_state(stream: DataFrame, key: str, seconds: int) -> DataFrame:
    """The latest payload of each key of a stream (key, payload), forgotten some seconds after its last change. Needs the
    RocksDB state store."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Latest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("payload", "payload string", ttlDurationMs=seconds * 1000)

        def handleInputRows(self, key, rows, timerValues):
            payload = None
            for pdf in rows:
                payload = pdf["payload"].iloc[-1]
            self.state.update((payload,))
            yield pd.DataFrame({"key": [str(key[0])], "payload": [payload]})

        def close(self) -> None:
            pass

    return stream.groupBy(key).transformWithStateInPandas(Latest(), outputStructType="key string, payload string", outputMode="Update", timeMode="ProcessingTime")


def windowed(stream: DataFrame, time: str, late: str, width: str, by: list[str], aggs: list[Column]) -> DataFrame:
    """Windowed aggregates with a watermark: an extension, beyond the feeds above."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(*aggs)
