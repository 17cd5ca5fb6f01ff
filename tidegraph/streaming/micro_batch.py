"""Streams on Structured Streaming: message sources, micro-batches with dead letters, windows.

Tumbling and session windows, watermarks and dropping repeats are beyond what a
plain batch of messages needs; they are offered as extras.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MESSAGE = "id string, topic string, payload string, timestamp timestamp, headers map<string,string>, partition int, offset bigint"


def subscribe(spark: SparkSession, path: str, schema, files_per_batch: int = 10, fmt: str = "parquet") -> DataFrame:
    """A stream of the files in a folder, oldest first; commits are the query's checkpoint."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def to_records(messages: DataFrame, payload_schema: str) -> DataFrame:
    """(record_id, source, timestamp, data, errors) of messages (id, topic, payload, timestamp); a payload that can't be read is an error."""
    data = F.from_json("payload", payload_schema, {"mode": "PERMISSIVE"})
    broken = F.col("payload").isNull() | F.try_parse_json("payload").isNull()
    errors = F.when(broken, F.array(F.lit("payload can't be read"))).otherwise(F.array().cast("array<string>"))
    return messages.select(F.col("id").alias("record_id"), F.col("topic").alias("source"), "timestamp", data.alias("data"), errors.alias("errors"))


def trigger_of(mode: str) -> dict:
    """Trigger options of the modes realtime, micro_batch and batch."""
    modes = {"realtime": {"processingTime": "0 seconds"}, "micro_batch": {"processingTime": "5 seconds"}, "batch": {"availableNow": True}}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}")
    return modes[mode]


def process(stream: DataFrame, handle: Callable[[DataFrame, int], None], dead: Callable[[DataFrame, str, int], None], checkpoint: str, mode: str = "batch") -> StreamingQuery:
    """Run ``handle`` on each micro-batch; a batch whose handler fails goes to ``dead`` as a whole and the stream goes on.

    A batch may be handed over again after a failure of the driver; a handler
    that writes by batch number writes each batch once.
    """

    def one(batch: DataFrame, number: int) -> None:
        try:
            handle(batch, number)
        except Exception as e:
            dead(batch, str(e)[:1000], number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger_of(mode)).start()


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """(start, keys…, events, total) per window; on a stream, rows later than ``late`` are left out."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("events"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "events", "total")


def sessions(events: DataFrame, at: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """(key, start, stop, events) of runs of events with less than ``gap`` between them."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "events")


def once(events: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Rows without their repeats; on a stream, within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)
