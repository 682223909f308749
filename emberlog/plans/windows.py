"""Train strategy, window keys, count and time windows, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions.sequences import frame_truncated, pad_mask, prompt_length
from emberlog.functions.text import hdfs_block
from emberlog.operators import windows as ops
from emberlog.operators.lines import extract_traces, window_key
from emberlog.plans import views as v
from emberlog.plans.registry import query

# small enough that the positions of every group of the test tables span several ranges
SMALL_RANGE = 500

STRATEGY_SQL = (
    v.with_views("logs", "services")
    + """SELECT log_id, CASE WHEN is_train THEN CASE WHEN row_number() OVER (PARTITION BY service ORDER BY ts, log_id) - 1
         <= max_pretrain THEN 'pre-train' ELSE 'finetune' END END AS train_strategy FROM logs JOIN services ON service = name"""
)


@query("E1_train_strategy", STRATEGY_SQL)
def strategy(spark, sf_dir):
    return ops.tag_train_strategy(v.logs(spark, sf_dir), v.services(spark, sf_dir)).select("log_id", "train_strategy")


@query("E1_train_strategy_ranged", STRATEGY_SQL)
def strategy_ranged(spark, sf_dir):
    logs, config = v.logs(spark, sf_dir), v.services(spark, sf_dir)
    return ops.tag_train_strategy(logs, config, SMALL_RANGE).select("log_id", "train_strategy")


@query("E2_window_key", v.with_views("window_input") + "SELECT log_id, key FROM window_input")
def key(spark, sf_dir):
    return window_key(extract_traces(v.logs(spark, sf_dir), v.LogTables(spark, sf_dir).services)).select("log_id", "key")


def _window_sql(size: int, scope: str) -> str:
    return v.with_views("window_input") + f"""SELECT {scope}, window_no, count(*) AS n_logs, min(log_id) AS first_id,
      max(log_id) AS last_id, sum(log_id) AS id_sum FROM (
        SELECT *, pos // {size} AS window_no FROM (
          SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY ts, log_id) - 1 AS pos,
          count(*) OVER (PARTITION BY {scope}) AS total FROM window_input))
      WHERE (window_no + 1) * {size} <= total GROUP BY {scope}, window_no"""


def _window_rows(windows, keys):
    ids = F.transform("logs", lambda x: x["log_id"])
    return windows.select(
        *keys,
        "window_no",
        F.size("logs").alias("n_logs"),
        F.array_min(ids).alias("first_id"),
        F.array_max(ids).alias("last_id"),
        F.aggregate(ids, F.lit(0).cast("long"), lambda a, b: a + b).alias("id_sum"),
    )


@query("E3_count_windows", _window_sql(512, "key"))
def count_windows(spark, sf_dir):
    logs = window_key(extract_traces(v.logs(spark, sf_dir), v.LogTables(spark, sf_dir).services))
    return _window_rows(ops.count_windows(logs, 512, "key"), ["key"])


@query("E3_count_windows_by_service", _window_sql(v.WINDOW, "service, key"))
def count_windows_by_service(spark, sf_dir):
    logs = window_key(extract_traces(v.logs(spark, sf_dir), v.LogTables(spark, sf_dir).services))
    return _window_rows(ops.count_windows(logs, v.WINDOW), ["service", "key"])


@query("E3_count_windows_ranged", _window_sql(64, "key"))
def count_windows_ranged(spark, sf_dir):
    logs = window_key(extract_traces(v.logs(spark, sf_dir), v.LogTables(spark, sf_dir).services))
    return _window_rows(ops.count_windows(logs, 64, "key", rows_per_range=SMALL_RANGE), ["key"])


@query(
    "E4_chunks",
    v.with_views("chunks") + "SELECT chunk_id, service, key, window_no, chunk_no, n_logs FROM chunks",
)
def chunked(spark, sf_dir):
    return v.chunks(spark, sf_dir).select("chunk_id", "service", "key", "window_no", "chunk_no", "n_logs")


@query(
    "E5_framed_chunks",
    v.with_views("chunks") + "SELECT chunk_id, array_to_string(input_ids, ',') AS input_ids, n_logs + 2 AS n_used FROM chunks",
)
def framed(spark, sf_dir):
    return v.chunks(spark, sf_dir).select(
        "chunk_id",
        v.text_of("chunk.input_ids").alias("input_ids"),
        F.aggregate("chunk.attention_mask", F.lit(0), lambda a, b: a + b).alias("n_used"),
    )


@query("E6_chunk_hash", v.with_views("chunks") + f"SELECT chunk_id, {v.sql_hash64('joined')} AS hash FROM chunks")
def chunk_hash(spark, sf_dir):
    return v.chunks(spark, sf_dir).select("chunk_id", "hash")


@query(
    "E7_chunk_logs",
    v.with_views("chunks") + "SELECT chunk_id, array_to_string(log_ids, ',') AS log_ids, text FROM chunks",
)
def chunk_logs(spark, sf_dir):
    return v.chunks(spark, sf_dir).select(
        "chunk_id",
        v.text_of(F.transform("original_logs", lambda x: x["log_id"])).alias("log_ids"),
        F.array_join(F.transform("original_logs", lambda x: x["original_text"]), "\n").alias("text"),
    )


EVENT_TIME_SQL = v.with_views("logs") + """SELECT epoch_us(time_bucket(INTERVAL '5 seconds', ts)) AS window_us, node AS key,
  count(*) AS n_logs, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM logs GROUP BY 1, 2"""


def event_time_rows(windows):
    return windows.select(
        v.micros("window_start").alias("window_us"), "key", "n_logs",
        v.micros("first_ts").alias("first_us"), v.micros("last_ts").alias("last_us"),
    )


@query("E8_event_time_windows", EVENT_TIME_SQL)
def event_time(spark, sf_dir):
    return event_time_rows(ops.event_time_windows(v.logs(spark, sf_dir).withColumn("key", F.col("node"))))


def _time_sql(unit: str, context: int) -> str:
    return v.with_views("keyed") + f"""SELECT epoch_us(w) AS window_us, chunk_no,
      string_agg(CAST(key_id AS VARCHAR), ',' ORDER BY rn) AS line, max(is_anomaly) AS is_anomaly FROM (
        SELECT *, (rn - 1) // {context} AS chunk_no FROM (
          SELECT *, date_trunc('{unit}', ts) AS w,
          row_number() OVER (PARTITION BY date_trunc('{unit}', ts) ORDER BY ts, log_id) AS rn FROM keyed))
      GROUP BY w, chunk_no"""


def _time_rows(sequences):
    return sequences.select(
        v.micros("timestamp").alias("window_us"), "chunk_no", v.text_of("line").alias("line"), "is_anomaly"
    )


@query("E10_minute_sequences", _time_sql("minute", 256))
def minute_sequences(spark, sf_dir):
    return _time_rows(ops.time_sequences(v.keyed_logs(spark, sf_dir), "1 minute"))


@query("E10_day_sequences", _time_sql("day", 64))
def day_sequences(spark, sf_dir):
    return _time_rows(ops.time_sequences(v.keyed_logs(spark, sf_dir), "1 day", 64))


SESSIONS = """sessions AS (SELECT block_id, list(key_id ORDER BY ts, log_id) AS ids, arg_min(is_anomaly, (ts, log_id)) AS is_anomaly
  FROM (SELECT *, regexp_extract(original_text, '(blk_-?[0-9]+)', 1) AS block_id FROM keyed) GROUP BY block_id)"""


def sessions(spark, sf_dir, first=None):
    blocks = v.keyed_logs(spark, sf_dir).withColumn("block_id", hdfs_block(F.col("original_text")))
    return ops.session_sequences(blocks, "block_id", first)


def positioned_sessions(spark, sf_dir):
    blocks = v.keyed_logs(spark, sf_dir).withColumn("block_id", hdfs_block(F.col("original_text")))
    return ops.session_positions(blocks, "block_id")


@query(
    "E11_session_sequences",
    v.with_views("keyed")
    + f", {SESSIONS} SELECT block_id, array_to_string(ids, ',') AS line, len(ids) AS n_keys, is_anomaly FROM sessions",
)
def session_rows(spark, sf_dir):
    return sessions(spark, sf_dir).select("block_id", v.text_of("line").alias("line"), "n_keys", "is_anomaly")


@query(
    "E11_session_positions",
    v.with_views("keyed") + f""", {SESSIONS} SELECT block_id, pos, ids[pos] AS key_id
      FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS pos FROM sessions)""",
)
def session_positions(spark, sf_dir):
    blocks = v.keyed_logs(spark, sf_dir).withColumn("block_id", hdfs_block(F.col("original_text")))
    return ops.session_positions(blocks, "block_id", rows_per_range=100)


@query(
    "E12_dataset_frames",
    v.with_views("keyed")
    + f""", {SESSIONS} SELECT block_id, array_to_string(CASE WHEN len(ids) + 2 > 256
          THEN list_concat([0], ids[1:254], [1]) ELSE list_concat([0], ids, [1], [2 for x in range(254 - len(ids))]) END, ',')
          AS input_ids, least(len(ids) + 2, 256) AS n_used FROM sessions""",
)
def dataset_frames(spark, sf_dir):
    framed_rows = sessions(spark, sf_dir, first=256).withColumn("ids", frame_truncated(F.col("line"), 256))
    return framed_rows.select(
        "block_id",
        v.text_of("ids").alias("input_ids"),
        F.aggregate(pad_mask(F.col("ids")), F.lit(0), lambda a, b: a + b).alias("n_used"),
    )


def _prompt_sql(margin: int, cut: float) -> str:
    start = f"floor({cut} * n)"
    return f"""CAST(CASE WHEN {start} < {margin} THEN least({margin}, n) WHEN {start} >= n - {margin}
      THEN greatest(n - {margin}, 0) ELSE {start} END AS INTEGER)"""


@query(
    "G5_prompt_cut",
    v.with_views("keyed")
    + f""", {SESSIONS} SELECT block_id, {_prompt_sql(2, 0.8)} AS framed_len, {_prompt_sql(1, 0.2)} AS sliding_len
          FROM (SELECT *, len(ids) + 2 AS n FROM sessions)""",
)
def prompt_cuts(spark, sf_dir):
    n = (F.col("n_keys") + 2).cast("int")
    return sessions(spark, sf_dir, first=1).select(
        "block_id",
        prompt_length(n, 0.8).alias("framed_len"),
        prompt_length(n, 0.2, margin=1).alias("sliding_len"),
    )
