"""Incremental import of raw messages as a micro-batch stream, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchlake.operators.deliveries import deduplicated, normalised_id, with_quotient
from matchlake.sources.store import KeyedTable

RAW = "delivery_id bigint, provider string, provider_record_id string, record_type string, payload string, source_batch_id string, source_timestamp timestamp, fetched_at timestamp"


def raw_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files of raw messages as a stream, some files a batch."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def own_id() -> Column:
    """The message's normalised id; a delivery without one is a message of its own, named by its delivery id."""
    return F.coalesce(normalised_id(F.col("provider_record_id")), F.concat(F.lit("\u0000delivery "), F.col("delivery_id").cast("string")))


def message_key(df: DataFrame) -> DataFrame:
    """``df`` with message: provider, record type and id, lengths before them so that parts can't be confused."""
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    return df.withColumn("message", F.concat(*[part(F.coalesce(c, F.lit(""))) for c in (F.col("provider"), F.col("record_type"), own_id())]))


def import_once(spark: SparkSession, folder: str, target: KeyedTable, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 1) -> list[dict]:
    """Import everything that is new in ``folder`` and stop; returns a report of each batch.

    Each message is stored once, under its message key: repeats inside a batch are resolved by the earliest fetch,
    those of earlier batches are skipped. The stream's checkpoint remembers which files are done; a batch that ran
    twice because of a failure changes nothing the second time. ``transform`` maps new messages to rows with message.
    """
    reports: list[dict] = []

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        keyed = message_key(deduplicated(batch))
        new = keyed.join(target.read().select("message"), "message", "left_anti").dropDuplicates(["message"])
        rows = transform(new) if transform else new
        reports.append({"batch_id": batch_id, "read": batch.count(), "stored": target.upsert(rows)})
        batch.unpersist()

    query = raw_stream(spark, folder, files_per_batch).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return reports


def distinct_messages(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """A stream of messages without repeats: exact identifiers are kept as state until ``late`` after their fetch. Messages
    without an identifier all pass, once each."""
    named, names = with_quotient(stream, [F.col("provider"), F.col("record_type"), own_id()])
    once = named.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(names)
    return once.select(*stream.columns)


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type of a stream or table with ts, event_type and value."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "events", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", "w.start", "w.end", "events")


def to_memory(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what is there now into an in-memory table, for small results and tests."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
