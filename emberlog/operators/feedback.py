"""Prediction routing, the unified anomaly feed, user feedback and context lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.joins import BROADCAST_ROWS, is_small, sized
from emberlog.session import written

LINE_TYPE, SEQUENCE_TYPE = "rapid", "log_gpt"
FEED_FIELDS = ["type", "id", "hash", "service", "nodes", "filenames", "start_ts", "end_ts", "text"]


def route_lines(predictions: DataFrame) -> DataFrame:
    """Line predictions that are stored: the anomalous ones."""
    return predictions.filter((F.col("type") == LINE_TYPE) & F.col("is_anomaly")).withColumn("prompt_user", F.lit(True))


def route_sequences(predictions: DataFrame) -> DataFrame:
    """Sequence predictions that are stored: all, under the service of their first log."""
    return predictions.filter(F.col("type") == SEQUENCE_TYPE).withColumns(
        {
            "service": F.element_at("original_logs", 1)["service"],
            "train_strategy": F.coalesce("train_strategy", F.lit("ignore")),
            "prompt_user": F.lit(True),
        }
    )


def unify_lines(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.lit(LINE_TYPE).alias("type"),
        F.col("id").cast("string").alias("id"),
        "hash",
        "service",
        F.array("node").alias("nodes"),
        F.array("filename").alias("filenames"),
        F.col("ts").alias("start_ts"),
        F.col("ts").alias("end_ts"),
        F.col("original_text").alias("text"),
    )


def unify_sequences(sequences: DataFrame) -> DataFrame:
    logs = F.col("original_logs")
    each = lambda field: F.transform(logs, lambda x: x[field])
    return sequences.select(
        F.lit(SEQUENCE_TYPE).alias("type"),
        F.col("id").cast("string").alias("id"),
        "hash",
        "service",
        F.array_distinct(each("node")).alias("nodes"),
        F.array_distinct(each("filename")).alias("filenames"),
        F.element_at(logs, 1)["ts"].alias("start_ts"),
        F.element_at(logs, -1)["ts"].alias("end_ts"),
        F.array_join(each("original_text"), "\n").alias("text"),
    )


def pending(stored: DataFrame) -> DataFrame:
    return stored.filter(F.col("is_anomaly") & F.col("prompt_user"))


def anomaly_feed(lines: DataFrame, sequences: DataFrame) -> DataFrame:
    """Pending anomalies of both stores, newest first."""
    both = unify_lines(pending(lines)).unionByName(unify_sequences(pending(sequences)))
    return both.orderBy(F.desc("end_ts"), F.asc("id"))


def _with_feedback(stored: DataFrame, feedback: DataFrame, kind: str, action: str) -> DataFrame:
    wanted = feedback.filter((F.col("type") == kind) & (F.col("action") == action))
    ids = wanted.select(F.col("id").cast(stored.schema["id"].dataType).alias("id")).distinct()
    return stored.join(sized(ids.withColumn("_hit", F.lit(True))), "id", "left")


def mark_normal_lines(lines: DataFrame, feedback: DataFrame) -> DataFrame:
    hit = F.col("_hit").isNotNull()
    return _with_feedback(lines, feedback, LINE_TYPE, "normal").withColumn(
        "is_anomaly", F.when(hit, False).otherwise(F.col("is_anomaly"))
    ).drop("_hit")


def mark_normal_sequences(sequences: DataFrame, feedback: DataFrame) -> DataFrame:
    """Sequences marked normal also become fine-tuning data."""
    hit = F.col("_hit").isNotNull()
    return _with_feedback(sequences, feedback, SEQUENCE_TYPE, "normal").withColumns(
        {
            "is_anomaly": F.when(hit, False).otherwise(F.col("is_anomaly")),
            "train_strategy": F.when(hit, "finetune").otherwise(F.col("train_strategy")),
        }
    ).drop("_hit")


def marked_lines(lines: DataFrame, feedback: DataFrame) -> DataFrame:
    """Lines that a user marked normal: they join the normal store."""
    return _with_feedback(lines, feedback, LINE_TYPE, "normal").filter("_hit").drop("_hit")


def confirm(stored: DataFrame, feedback: DataFrame, kind: str) -> DataFrame:
    """Confirmed anomalies leave the pending feed."""
    return _with_feedback(stored, feedback, kind, "confirm").withColumn(
        "prompt_user", F.when(F.col("_hit").isNotNull(), False).otherwise(F.col("prompt_user"))
    ).drop("_hit")


def unmatched_feedback(feedback: DataFrame, lines: DataFrame, sequences: DataFrame) -> DataFrame:
    """Feedback whose document does not exist."""
    stored = (
        lines.select(F.lit(LINE_TYPE).alias("type"), F.col("id").cast("string").alias("id"))
        .unionByName(sequences.select(F.lit(SEQUENCE_TYPE).alias("type"), F.col("id").cast("string").alias("id")))
    )
    return feedback.withColumn("id", F.col("id").cast("string")).join(stored, ["type", "id"], "left_anti").withColumn(
        "message", F.lit("No document found")
    )


# bucket widths of the context lookup; a range uses the finest that needs few enough buckets
BUCKET_MINUTES = [1, 8, 64, 512, 4096]
MAX_BUCKETS = 10


def _bucket(ts, minutes: int):
    return F.floor(F.unix_micros(ts) / (minutes * 60_000_000)).cast("long")


def context_lookup(feed: DataFrame, logs: DataFrame, radius_minutes: int = 1) -> DataFrame:
    """Raw logs around each feed entry: same service, one of its nodes and files, close in time.

    Each time range becomes a few buckets as wide as it needs, so the join is an equi
    join on service, node, file and bucket; the exact bounds are checked on the bucket's
    rows. A log has one node, file and bucket per width, and an entry one width, hence a
    pair meets at most once. Buckets of a small feed are broadcast, and the logs stay where
    they are; with more of them logs and buckets are dealt by place and bucket once. There
    may be far more pairs than logs, so no step moves or stores them. Both give the same rows.
    """
    radius = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(radius_minutes), F.lit(0))
    start, end = F.col("start_ts") - radius, F.col("end_ts") + radius
    ranges = feed.select(
        F.col("id").alias("anomaly_id"), "service", F.array_distinct("filenames").alias("filenames"),
        F.explode(F.array_distinct("nodes")).alias("node"),
        start.alias("_from"), end.alias("_to"),
    ).select("*", F.explode("filenames").alias("filename"))
    minutes = (F.unix_micros("_to") - F.unix_micros("_from")) / 60_000_000
    fits = [F.when(minutes <= w * (MAX_BUCKETS - 1), w) for w in BUCKET_MINUTES[:-1]]
    width = F.coalesce(*fits, F.lit(BUCKET_MINUTES[-1]))
    # only the chosen width is counted out, as a long range has very many minutes
    chosen = F.coalesce(
        *[F.when(F.col("_width") == w, F.sequence(_bucket(F.col("_from"), w), _bucket(F.col("_to"), w))) for w in BUCKET_MINUTES]
    )
    buckets = ranges.withColumn("_width", width).select(
        "anomaly_id", "service", "node", "filename", "_from", "_to", "_width", F.explode(chosen).alias("_bucket")
    )
    buckets = written(buckets, "context-buckets")
    # at most as many numbers as there are widths
    widths = [r["_width"] for r in buckets.select("_width").distinct().collect()]
    if not widths:
        return logs.withColumn("anomaly_id", F.lit(None).cast("string")).limit(0)
    spread = F.array(*[F.struct(F.lit(w).alias("_width"), _bucket(F.col("ts"), w).alias("_bucket")) for w in widths])
    place = ["service", "node", "filename"]
    close = F.col("ts").between(F.col("_from"), F.col("_to"))
    # the table is stored, so its rows are counted without reading them
    if buckets.count() <= BROADCAST_ROWS and is_small(buckets):
        met = logs.select("*", F.inline(spread)).join(F.broadcast(buckets), [*place, "_width", "_bucket"])
        return met.filter(close).select(*logs.columns, "anomaly_id")
    # only logs of places that the feed names, once per width that is in use; a pair is made once and never stored
    near = logs.join(sized(buckets.select(*place).distinct()), place, "left_semi")
    # merged, as a table of buckets is small in files and large in memory
    met = near.select("*", F.inline(spread)).join(buckets.hint("merge"), [*place, "_width", "_bucket"])
    return met.filter(close).select(*logs.columns, "anomaly_id")


def ensemble(line_verdicts: DataFrame, sequences: DataFrame) -> DataFrame:
    """Per log: flagged by both detectors, by the line one only, or by the sequence one only."""
    lines = line_verdicts.filter("is_anomaly").select("log_id", F.lit(True).alias("_line"))
    in_sequences = (
        sequences.filter("is_anomaly")
        .select(F.explode("original_logs").alias("l"))
        .select("l.log_id")
        .distinct()
        .withColumn("_sequence", F.lit(True))
    )
    return lines.join(in_sequences, "log_id", "full").select(
        "log_id",
        F.when(F.col("_line") & F.col("_sequence"), "confirmed")
        .when(F.col("_line"), "line_only")
        .otherwise("sequence_only")
        .alias("verdict"),
    )
