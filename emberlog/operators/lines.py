"""Line-level operators: clean, hash, trace ids, fixed-length tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import (
    BGL_RULES,
    HDFS_RULES,
    THUNDERBIRD_RULES,
    basename,
    bgl_time,
    hash64,
    hdfs_block,
    is_alert,
    shorten,
    substitute,
    thunderbird_time,
    word_tokens,
)
from emberlog.operators.ordering import number_rows, position
from emberlog.operators.services import attach, clean_text, trace_ids
from emberlog.session import written

# Reserved rows of the token vocabulary.
PAD_TOKEN, UNKNOWN_TOKEN, CLS_TOKEN, SEP_TOKEN = 0, 1, 2, 3
RESERVED_TOKENS = 4
TOKEN_LENGTH = 512


def clean(logs: DataFrame, services: DataFrame) -> DataFrame:
    """Add ``cleaned_text`` (the service's ordered substitutions) and its ``hash``."""
    return clean_text(services)(logs).withColumn("hash", hash64(F.col("cleaned_text")))


def extract_traces(logs: DataFrame, services: DataFrame) -> DataFrame:
    """Add ``enable_trace`` and ``trace_id`` (NULL when tracing is off or nothing matches)."""
    return trace_ids(services)(attach(logs, services, ["enable_trace"]))


def window_key(logs: DataFrame) -> DataFrame:
    """Add ``key``: the trace id of a traced service, else the node.

    A traced log without a trace id falls back to its node.
    """
    traced = F.coalesce(F.col("enable_trace"), F.lit(False))
    return logs.withColumn("key", F.when(traced, F.coalesce("trace_id", "node")).otherwise(F.col("node")))


def parse_hdfs(lines: DataFrame, templates: bool = False) -> DataFrame:
    """``line`` → block id and line; the line is cleaned unless templates are mined from it."""
    block = hdfs_block(F.col("line"))
    text = F.col("line") if templates else substitute(F.col("line"), HDFS_RULES)
    return lines.withColumns({"block_id": block, "line": text})


def parse_bgl(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    return lines.withColumns(
        {"is_anomaly": is_alert(line), "timestamp": bgl_time(line), "line": substitute(line, BGL_RULES)}
    )


def parse_thunderbird(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    return lines.withColumns(
        {"is_anomaly": is_alert(line), "timestamp": thunderbird_time(line), "line": substitute(line, THUNDERBIRD_RULES)}
    )


def unique_lines(logs: DataFrame, group: str, line: str) -> DataFrame:
    """The distinct lines of each group, first-seen order, joined by blanks: one row per group.

    Distinct lines are found by a partial aggregation, so a hot group shrinks to them before
    the shuffle; the text of a group is one value of the data set.
    """
    seen = logs.groupBy(group, line).agg(F.min(position()).alias("_first"))
    gathered = seen.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_first", line))).alias("_lines"))
    return gathered.select(group, F.array_join(F.transform("_lines", lambda x: x[line]), " ").alias("line"))


def build_vocabulary(texts: DataFrame, text: str = "text", max_size: int | None = None) -> DataFrame:
    """Token → id by falling count, after the reserved ids."""
    tokens = texts.select(F.explode(word_tokens(F.col(text))).alias("token"))
    counts = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token-counts")
    numbered = number_rows(counts.withColumn("_falling", -F.col("n")), ["_falling", "token"], name="_no")
    vocabulary = numbered.select("token", "n", (F.col("_no") + RESERVED_TOKENS - 1).alias("token_id"))
    return vocabulary if max_size is None else vocabulary.filter(F.col("token_id") < max_size)


def tokenize(
    texts: DataFrame, vocabulary: DataFrame, key: str, text: str = "text", length: int = TOKEN_LENGTH
) -> DataFrame:
    """Fixed-length token ids: CLS + ids + SEP, cut and padded to ``length``, with masks.

    Only the first ``length - 2`` tokens of a text can appear, so at most that many rows
    per text are looked up.
    """
    body = length - 2
    words = F.slice(word_tokens(F.col(text)), 1, body)
    rows = texts.select(key, F.posexplode_outer(words).alias("_pos", "token"))
    ids = written(vocabulary.select("token", "token_id"), "vocabulary")
    found = rows.join(ids, "token", "left")
    # place and id as one number: a list of them is a third as wide as one of structs, and sorts as numbers
    known = F.coalesce("token_id", F.lit(UNKNOWN_TOKEN)).cast("int")
    entry = F.when(F.col("token").isNotNull(), F.shiftleft(F.col("_pos").cast("long"), 32).bitwiseOR(known.cast("long")))
    ordered = found.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_ids"))
    ids = F.concat(
        F.array(F.lit(CLS_TOKEN)), F.transform("_ids", lambda x: x.bitwiseAND(0xFFFFFFFF).cast("int")), F.array(F.lit(SEP_TOKEN)),
    )
    padded = ordered.withColumn("input_ids", ids).withColumn(
        "input_ids",
        F.concat("input_ids", F.array_repeat(F.lit(PAD_TOKEN), F.lit(length) - F.size("input_ids"))),
    )
    return padded.select(
        key,
        F.struct(
            "input_ids",
            F.transform("input_ids", lambda v: F.when(v != PAD_TOKEN, 1).otherwise(0)).alias("attention_mask"),
            F.array_repeat(F.lit(0), length).alias("token_type_ids"),
        ).alias("tokens"),
    )


def dashboard_rows(feed: DataFrame) -> DataFrame:
    """Feed rows as the table on the dashboard shows them."""
    return feed.select(
        "service",
        F.element_at("nodes", 1).alias("node"),
        basename(F.element_at("filenames", 1)).alias("filename"),
        F.date_format("end_ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
        shorten(F.col("text")).alias("log"),
    )
