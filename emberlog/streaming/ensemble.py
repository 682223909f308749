"""Verdicts of both detectors over time, deliveries that come twice, and sources that fall silent."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.windows import event_time_windows

POLICY = "spark.sql.streaming.multipleWatermarkPolicy"


@contextmanager
def watermark_policy(spark: SparkSession, slowest: bool) -> Iterator[None]:
    """Queries that first start inside go by the watermark of their slowest or of their furthest source."""
    before = spark.conf.get(POLICY)
    spark.conf.set(POLICY, "min" if slowest else "max")
    try:
        yield
    finally:
        spark.conf.set(POLICY, before)


def deliver_once(records: DataFrame, keys: Sequence[str] = ("log_id",), delay: str = "10 minutes") -> DataFrame:
    """A stream in which every record comes once, although an at-least-once topic may deliver it again.

    A record is known by ``keys``. Spark keeps the keys of the last ``delay`` of event time (``ts``), so a copy
    is recognised as long as it comes within that time; one that comes later is late and dropped as such.
    """
    return records.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def windows_of_sources(sources: Sequence[DataFrame], duration: str = "5 seconds", delay: str = "1 second") -> DataFrame:
    """Event-time windows per key over several streams of logs, each with a watermark of its own.

    Start it under ``watermark_policy``. Where the furthest source decides which windows are complete, one that has
    fallen silent holds nothing open, and what a slower one sends for a window already reported is late.
    Where the slowest decides, a silent source holds every window open.
    """
    together = None
    for source in sources:
        marked = source.withWatermark("ts", delay)
        together = marked if together is None else together.unionByName(marked)
    return event_time_windows(together, duration)


def first_verdicts(lines: DataFrame) -> DataFrame:
    """What the line detector alone says, at once: log_id, ts, verdict."""
    return lines.filter("is_anomaly").select("log_id", "ts", F.lit("suspected").alias("verdict"))


def final_verdicts(lines: DataFrame, sequences: DataFrame, delay: str) -> DataFrame:
    """What becomes of a log once its sequence is judged, or hasn't been within ``delay``: log_id, ts, verdict.

    ``lines`` are verdicts of the line detector (log_id, ts, is_anomaly), ``sequences`` those of the sequence
    detector with their ``original_logs``. A log is ``confirmed`` by both, ``refuted`` if only its line is anomalous,
    ``added`` if only its sequence is, and ``unconfirmed`` if no sequence with it came in time. Logs that nobody
    suspects have no row. The state holds ids and times of the last ``delay`` of event time, per log.
    """
    left = lines.select(F.col("log_id").alias("l_id"), F.col("ts").alias("l_ts"), F.col("is_anomaly").alias("l_bad"))
    inside = sequences.select(F.inline("original_logs"), F.col("is_anomaly").alias("s_bad"))
    right = inside.select(F.col("log_id").alias("s_id"), F.col("ts").alias("s_ts"), "s_bad")
    met = left.withWatermark("l_ts", delay).join(
        right.withWatermark("s_ts", delay), F.expr("l_id = s_id AND l_ts = s_ts"), "full"
    )
    line, sequence = F.coalesce("l_bad", F.lit(False)), F.coalesce("s_bad", F.lit(False))
    verdict = (
        F.when(line & sequence, "confirmed")
        .when(line & F.col("s_id").isNotNull(), "refuted")
        .when(line, "unconfirmed")
        .when(sequence, "added")
    )
    rows = met.select(F.coalesce("l_id", "s_id").alias("log_id"), F.coalesce("l_ts", "s_ts").alias("ts"), verdict.alias("verdict"))
    return rows.filter("verdict IS NOT NULL")
