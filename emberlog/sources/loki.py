"""Nested log pushes → flat log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.schemas import PUSH, TOPIC_LOG

# JSON carries microseconds; the default format would cut them to milliseconds
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
LOG_REQUIRED = ["service", "node", "filename", "ts", "original_text"]


def push_time(ns: Column) -> Column:
    """Nanosecond epoch text → timestamp with microseconds."""
    return F.timestamp_micros(F.floor(F.try_to_number(ns, F.lit("9" * 20)) / 1000).cast("long"))


def short_time(ns: Column) -> Column:
    """The first 15 digits of the epoch text, as the shipper's legacy integer."""
    return F.substring(ns, 1, 15).cast("long")


def flatten_pushes(pushes: DataFrame, value: str = "value") -> DataFrame:
    """JSON push messages → one row per log line, with labels and both time forms."""
    parsed = pushes.select(F.from_json(F.col(value), PUSH).alias("p"))
    streams = parsed.select(F.explode("p.streams").alias("s"))
    entries = streams.select("s.stream.*", F.explode("s.values").alias("v"))
    ns = F.get("v", F.lit(0))
    return entries.select(
        "node",
        "filename",
        "service",
        push_time(ns).alias("ts"),
        short_time(ns).alias("timestamp"),
        F.get("v", F.lit(1)).alias("original_text"),
    )


def select_labelled(logs: DataFrame) -> DataFrame:
    """Keep records whose service label is not empty."""
    return logs.filter(F.col("service").rlike("^.+$"))


def epoch_time(number: Column) -> Column:
    """Epoch integer of any resolution, as its number of digits tells, → timestamp with microseconds."""
    digits = F.length(F.abs(number).cast("string"))
    micros = F.when(
        digits <= 16, number * F.pow(F.lit(10.0), 16 - F.greatest(digits, F.lit(10))).cast("long")
    ).otherwise(F.floor(number / F.pow(F.lit(10.0), digits - 16).cast("long")).cast("long"))
    return F.timestamp_micros(micros)


def content_id(*fields: str | Column) -> Column:
    """A repeatable id from 0 to 2^63 for a record that comes without one."""
    return F.shiftrightunsigned(F.xxhash64(*fields), 1)


def decode_logs(messages: DataFrame, value: str = "value", schema=TOPIC_LOG, required=None) -> DataFrame:
    """JSON messages → records plus ``is_valid`` and the raw text.

    A message that is not JSON, or lacks a required field, is not valid; it neither fails
    the query nor passes as a record. A time may also come as ``timestamp``, an epoch
    integer. A record without ``log_id`` gets the message's ``position`` in its topic, or
    else a hash of the message, so that reading it again gives the same id.
    """
    required = LOG_REQUIRED if required is None else required
    kept = [F.col(value).alias("raw"), F.from_json(F.col(value), schema, JSON_OPTIONS).alias("r")]
    given = "position" in messages.columns
    parsed = messages.select(*kept, (F.col("position") if given else content_id(F.col(value))).alias("_position"))
    fields = {name: F.col(f"r.{name}") for name in schema.names}
    if "ts" in fields and "timestamp" in fields:
        fields["ts"] = F.coalesce(fields["ts"], epoch_time(fields.pop("timestamp")))
    if "log_id" in fields:
        fields["log_id"] = F.coalesce(fields["log_id"], F.col("_position"))
    valid = F.lit(True)
    for name in required:
        valid = valid & fields[name].isNotNull()
    # a message that is not a record has no id either
    checked = parsed.withColumn("is_valid", F.coalesce(valid & F.col("r").isNotNull(), F.lit(False)))
    return checked.select("raw", *[c.alias(name) for name, c in fields.items()], "is_valid")


def valid_logs(decoded: DataFrame) -> DataFrame:
    return decoded.filter("is_valid").drop("raw", "is_valid")


def dead_letters(decoded: DataFrame) -> DataFrame:
    return decoded.filter("NOT is_valid").select("raw")


def encode(records: DataFrame) -> DataFrame:
    """Records → one JSON ``value`` per row, the form a topic sink takes."""
    return records.select(F.to_json(F.struct("*"), JSON_OPTIONS).alias("value"))
