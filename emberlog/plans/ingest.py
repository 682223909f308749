"""Sources: nested pushes, JSON messages, line files, label tables, cached results."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators.templates import cached_vocabulary_size
from emberlog.operators.windows import time_sequences
from emberlog.plans import views as v
from emberlog.plans.registry import query
from emberlog.session import new_shared_path
from emberlog.sources.files import read_cached_csv, read_labels, read_lines, read_or_build
from emberlog.sources.loki import decode_logs, encode, flatten_pushes, select_labelled, valid_logs

PUSH_LINES = 100


def pushes(logs):
    """Logs packed into push messages of at most ``PUSH_LINES`` lines of one stream each."""
    entry = F.struct("log_id", F.array(F.concat(v.micros("ts").cast("string"), F.lit("123")), "original_text").alias("e"))
    packed = logs.groupBy("filename", "node", "service", F.floor(F.col("log_id") / PUSH_LINES).alias("_p")).agg(
        F.array_sort(F.collect_list(entry)).alias("entries")
    )
    stream = F.struct(
        F.struct("filename", "node", "service").alias("stream"),
        F.transform("entries", lambda x: x["e"]).alias("values"),
    )
    return packed.select(F.to_json(F.struct(F.array(stream).alias("streams"))).alias("value"))


@query(
    "A1_flatten_pushes",
    v.with_views("logs") + "SELECT node, filename, service, original_text, epoch_us(ts) AS ts_us FROM logs",
)
def flatten(spark, sf_dir):
    flat = flatten_pushes(pushes(v.logs(spark, sf_dir)))
    return flat.select("node", "filename", "service", "original_text", v.micros("ts").alias("ts_us"))


@query(
    "A2_label_selector",
    v.with_views("logs") + "SELECT log_id, service FROM logs WHERE log_id % 5 <> 0",
)
def labelled(spark, sf_dir):
    unlabelled = F.when(F.col("log_id") % 10 == 0, "").when(F.col("log_id") % 5 != 0, F.col("service"))
    return select_labelled(v.logs(spark, sf_dir).withColumn("service", unlabelled)).select("log_id", "service")


@query(
    "A3_push_time",
    v.with_views("logs")
    + """SELECT original_text, epoch_us(ts) AS ts_us,
         CAST(substr(CAST(epoch_us(ts) AS VARCHAR) || '123', 1, 15) AS BIGINT) AS timestamp FROM logs""",
)
def push_times(spark, sf_dir):
    flat = flatten_pushes(pushes(v.logs(spark, sf_dir)))
    return flat.select("original_text", v.micros("ts").alias("ts_us"), "timestamp")


def truncated(logs):
    """Logs as topic messages, every seventh one cut short."""
    fields = ["log_id", "service", "node", "filename", "ts", "original_text"]
    messages = encode(logs.select(*fields))
    broken = F.get_json_object("value", "$.log_id").cast("long") % 7 == 0
    return messages.select(F.when(broken, F.substring("value", 1, 25)).otherwise(F.col("value")).alias("value"))


@query(
    "A5_lenient_decode",
    v.with_views("logs")
    + """SELECT log_id % 7 <> 0 AND log_id % 11 <> 0 AS is_valid,
         CASE WHEN log_id % 7 <> 0 AND log_id % 11 <> 0 THEN service END AS service, count(*) AS n
         FROM logs GROUP BY ALL""",
)
def decoded(spark, sf_dir):
    logs = v.logs(spark, sf_dir).withColumn("node", F.when(F.col("log_id") % 11 != 0, F.col("node")))
    messages = truncated(logs)
    checked = decode_logs(messages)
    return checked.groupBy("is_valid", F.when(F.col("is_valid"), F.col("service")).alias("service")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "A5_valid_logs",
    v.with_views("logs")
    + "SELECT log_id, service, node, filename, epoch_us(ts) AS ts_us, original_text FROM logs WHERE log_id % 7 <> 0",
)
def valid(spark, sf_dir):
    logs = v.logs(spark, sf_dir)
    messages = truncated(logs)
    return valid_logs(decode_logs(messages)).select(
        "log_id", "service", "node", "filename", v.micros("ts").alias("ts_us"), "original_text"
    )


@query(
    "A9_line_files",
    v.with_views("logs") + """SELECT original_text AS line, row_number() OVER (ORDER BY log_id) - 1 AS line_id
      FROM logs""",
)
def line_files(spark, sf_dir):
    """Files of unequal size, whose names rise with the ids of their lines."""
    path = new_shared_path(spark, "lines")
    logs = v.logs(spark, sf_dir).select("log_id", "original_text")
    logs.repartitionByRange(6, "log_id").sortWithinPartitions("log_id").select("original_text").write.text(path)
    return read_lines(spark, path).select("line", "line_id")


@query(
    "A10_label_csv",
    "SELECT 'doc_' || doc_id AS \"BlockId\", CAST(toxic AS BIGINT) AS is_anomaly FROM labels",
)
def label_csv(spark, sf_dir):
    path = new_shared_path(spark, "labels")
    labels = v.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("BlockId"),
        F.when(F.col("toxic") == 1, "Anomaly").otherwise("Normal").alias("Label"),
    )
    labels.write.option("header", True).csv(path)
    return read_labels(spark, path)


@query(
    "A11_read_or_build",
    v.with_views("keyed")
    + """SELECT epoch_us(day) AS window_us, chunk_no, string_agg(CAST(key_id AS VARCHAR), ',' ORDER BY rn) AS line,
         max(is_anomaly) AS is_anomaly FROM (
           SELECT *, (rn - 1) // 64 AS chunk_no FROM (
             SELECT *, date_trunc('day', ts) AS day,
             row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, log_id) AS rn FROM keyed))
         GROUP BY day, chunk_no""",
)
def cached_sequences(spark, sf_dir):
    path = new_shared_path(spark, "cache")
    build = lambda: time_sequences(v.keyed_logs(spark, sf_dir), "1 day", 64)
    read_or_build(spark, path, build)
    cached = read_or_build(spark, path, build)
    return cached.select(
        v.micros("timestamp").alias("window_us"), "chunk_no", v.text_of("line").alias("line"), "is_anomaly"
    )


@query(
    "A11_cached_csv",
    v.with_views("keyed") + "SELECT max(key_id) AS vocab_size FROM keyed",
)
def cached_csv(spark, sf_dir):
    path = new_shared_path(spark, "csv")
    sequences = time_sequences(v.keyed_logs(spark, sf_dir), "1 day", 64)
    as_text = sequences.select(
        F.concat(F.lit("["), F.array_join(F.col("line").cast("array<string>"), ", "), F.lit("]")).alias("line")
    )
    as_text.write.option("header", True).option("compression", "gzip").csv(path)
    return cached_vocabulary_size(read_cached_csv(spark, path))


@query(
    "C10_json_encode",
    v.with_views("logs")
    + """SELECT '{"log_id":' || log_id || ',"service":"' || service || '","node":"' || node || '"}' AS value FROM logs""",
)
def json_encode(spark, sf_dir):
    return encode(v.logs(spark, sf_dir).select("log_id", "service", "node"))
