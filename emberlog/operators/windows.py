"""Count windows, framed chunks, time windows and session sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.sequences import ONLINE_CONTEXT, frame, frame_mask
from emberlog.functions.text import hash64
from emberlog.operators.joins import sized
from emberlog.operators.ordering import ROWS_PER_RANGE, number_rows, number_stored_rows, position, running_totals
from emberlog.operators.services import attach
from emberlog.session import written

ORDER = ["ts", "log_id"]
# what a window keeps of each log, in addition to its position
WINDOW_FIELDS = [
    "log_id", "ts", "service", "node", "filename", "original_text", "cleaned_text", "hash", "key_id", "train_strategy",
]


def tag_train_strategy(
    logs: DataFrame,
    services: DataFrame,
    rows_per_range: int = ROWS_PER_RANGE,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Tag logs of training services: the first ``max_pretrain + 1`` are ``pre-train``, later ones ``finetune``.

    A tag that the log already carries wins. ``seen`` (service, seen) counts training logs
    of earlier micro-batches. Only the ids and times of training logs are numbered, to find
    the last pre-training log of each service; the logs themselves are not shuffled. In services of more
    than ``rows_per_range`` logs these are counted by the minute first, and one minute is numbered.
    """
    minute = F.floor(F.unix_micros("ts") / 60_000_000).alias("_minute")
    training = attach(
        logs.select("service", minute, position().alias("_at")), services, ["is_train", "max_pretrain"]
    ).filter("is_train")
    minutes = training.groupBy("service", "_minute").agg(
        F.count(F.lit(1)).alias("_rows"), F.max("max_pretrain").alias("max_pretrain")
    )
    minutes = written(minutes, "training-minutes")
    biggest = minutes.groupBy("service").agg(F.sum("_rows").alias("n")).agg(F.max("n")).first()[0] or 0
    if biggest > rows_per_range:
        counted = _after_seen(running_totals(minutes, {"_upto": F.col("_rows")}, ["_minute"], ["service"], rows_per_range), "_upto", seen)
        # the last minute that begins with a pre-training log holds the last one; only its logs are numbered
        counted = counted.withColumn("_before", F.col("_upto") - F.col("_rows")).filter("_before <= max_pretrain")
        cuts = counted.groupBy("service").agg(F.max("_minute").alias("_minute"), F.max_by("_before", "_minute").alias("_before"))
        near = training.join(sized(written(cuts, "pretrain-minutes")), ["service", "_minute"])
        numbered = number_rows(near, ["_at"], ["service"], "_no", rows_per_range).withColumn("_no", F.col("_no") + F.col("_before"))
    else:
        numbered = _after_seen(number_rows(training, ["_at"], ["service"], "_no", rows_per_range, biggest), "_no", seen)
    last = numbered.filter("_no - 1 <= max_pretrain").groupBy("service").agg(F.max("_at").alias("_last"))
    marked = attach(logs, services, ["is_train"]).join(written(last, "pretrain-ends"), "service", "left")
    tag = F.when(F.col("is_train"), F.when(position() <= F.col("_last"), "pre-train").otherwise("finetune"))
    given = F.col("train_strategy") if "train_strategy" in logs.columns else F.lit(None).cast("string")
    return marked.withColumn("train_strategy", F.coalesce(given, tag)).drop("_last", "is_train")


def _after_seen(numbered: DataFrame, name: str, seen: DataFrame | None) -> DataFrame:
    """Positions of a micro-batch's training logs, with those of earlier ones counted."""
    if seen is None:
        return numbered
    return numbered.join(seen, "service", "left").withColumn(name, F.col(name) + F.coalesce("seen", F.lit(0))).drop("seen")


def window_keys(scope: str) -> list[str]:
    """Columns that key a window: ``key`` alone lets one window mix services."""
    if scope not in ("key", "service"):
        raise ValueError("scope must be 'key' or 'service'")
    return ["key"] if scope == "key" else ["service", "key"]


def gather_windows(positioned: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Rows with a 0-based position ``_pos`` per key → one row per window, logs in order."""
    fields = [c for c in WINDOW_FIELDS if c in positioned.columns]
    positioned = positioned.withColumn("window_no", F.floor(F.col("_pos") / size).cast("long"))
    return (
        positioned.groupBy(*keys, "window_no")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", *fields))).alias("logs"))
    )


def count_windows(
    logs: DataFrame,
    size: int = ONLINE_CONTEXT,
    scope: str = "service",
    emit_partial: bool = False,
    rows_per_range: int = ROWS_PER_RANGE,
    kept: Sequence[str] | None = None,
) -> DataFrame:
    """Tumbling windows of ``size`` logs per key; a window that is not full is not emitted.

    ``kept`` names what a window keeps of each log: all of ``WINDOW_FIELDS``, or only some, so that no others are moved.
    """
    keys = window_keys(scope)
    wanted = WINDOW_FIELDS if kept is None else [*ORDER, *kept]
    fields = [c for c in wanted if c in logs.columns and c not in keys]
    positioned = number_stored_rows(logs.select(*keys, *fields), ORDER, keys, "_pos", rows_per_range)
    positioned = positioned.withColumn("_pos", F.col("_pos") - 1)
    if kept is not None:
        positioned = positioned.select(*keys, "_pos", *[c for c in kept if c not in keys])
    windows = gather_windows(positioned, keys, size)
    return windows if emit_partial else windows.filter(F.size("logs") == size)


def chunk_windows(windows: DataFrame, context: int = ONLINE_CONTEXT) -> DataFrame:
    """Cut windows into framed chunks of at most ``context - 2`` logs, one row per chunk.

    Windows that kept no ``cleaned_text`` give chunks without ``hash``.
    """
    body = context - 2
    keys = [c for c in windows.columns if c not in ("logs", "window_no")]
    last = F.ceil(F.size("logs") / body).cast("int") - 1
    pieces = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice("logs", c * body + 1, body))
    chunks = windows.select(*keys, "window_no", F.posexplode(pieces).alias("chunk_no", "original_logs"))
    ids = F.transform("original_logs", lambda x: x["key_id"].cast("int"))
    framed = frame(ids, context)
    hashed = []
    if _has(windows, "cleaned_text"):
        hashed = [hash64(F.array_join(F.transform("original_logs", lambda x: x["cleaned_text"]), "\n")).alias("hash")]
    service = F.col("service") if "service" in keys else F.element_at("original_logs", 1)["service"]
    strategy = (
        F.element_at("original_logs", 1)["train_strategy"] if _has(windows, "train_strategy") else F.lit(None)
    )
    chunk_id = F.concat_ws("|", *[F.col(k) for k in keys], "window_no", "chunk_no")
    return chunks.select(
        chunk_id.alias("chunk_id"),
        *[F.col(k) for k in keys if k != "service"],
        service.alias("service"),
        "window_no",
        F.col("chunk_no").cast("long").alias("chunk_no"),
        F.size("original_logs").cast("long").alias("n_logs"),
        *hashed,
        F.struct(
            framed.alias("input_ids"), frame_mask(ids, context).alias("attention_mask"), framed.alias("labels")
        ).alias("chunk"),
        "original_logs",
        strategy.cast("string").alias("train_strategy"),
    )


def _has(windows: DataFrame, field: str) -> bool:
    return field in windows.schema["logs"].dataType.elementType.names


def event_time_windows(logs: DataFrame, duration: str = "5 seconds", delay: str | None = None) -> DataFrame:
    """Logs per key and tumbling event-time window; ``delay`` sets the watermark of a stream."""
    if delay is not None:
        logs = logs.withWatermark("ts", delay)
    return (
        logs.groupBy(F.window("ts", duration).alias("w"), "key")
        .agg(F.count(F.lit(1)).alias("n_logs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select(F.col("w.start").alias("window_start"), "key", "n_logs", "first_ts", "last_ts")
    )


def time_sequences(
    logs: DataFrame,
    duration: str = "1 minute",
    context: int = 256,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Key sequences of tumbling time windows, cut every ``context`` logs; label is the maximum."""
    windowed = logs.withColumn("timestamp", F.window("ts", duration)["start"])
    numbered = number_rows(windowed, ORDER, ["timestamp"], "_no", rows_per_range)
    return (
        numbered.withColumn("chunk_no", F.floor((F.col("_no") - 1) / context).cast("long"))
        .groupBy("timestamp", "chunk_no")
        .agg(
            F.array_sort(F.collect_list(F.struct("_no", "key_id"))).alias("_s"),
            F.max("is_anomaly").alias("is_anomaly"),
        )
        .select("timestamp", "chunk_no", F.transform("_s", lambda x: x["key_id"].cast("int")).alias("line"), "is_anomaly")
    )


def session_positions(logs: DataFrame, session: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """session, 1-based ``pos`` and ``key_id`` of every row: a session of any size, spread over many rows."""
    rows = logs.select(session, *ORDER, "key_id")
    return number_stored_rows(rows, ORDER, [session], "pos", rows_per_range).select(session, "pos", "key_id")


def session_sequences(
    logs: DataFrame, session: str, first: int | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Key sequence of each session in row order, its number of rows, and the label of its first row.

    One row per session, as a data set of sessions is defined. ``first`` keeps only that many
    keys of each, which bounds the rows; a truncating frame needs no more than its size. Where
    whole sessions may be too long for a row, use ``session_positions``.
    """
    positioned = session_positions(logs, session, rows_per_range)
    if first is not None:
        positioned = positioned.filter(F.col("pos") <= first)
    lines = positioned.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("pos", "key_id"))).alias("_s"))
    facts = logs.groupBy(session).agg(
        F.min_by("is_anomaly", position()).alias("is_anomaly"), F.count(F.lit(1)).alias("n_keys")
    )
    return lines.join(facts, session).select(
        session, F.transform("_s", lambda x: x["key_id"].cast("int")).alias("line"), "n_keys", "is_anomaly"
    )
