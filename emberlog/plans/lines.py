"""Line operators: substitutions, hashes, corpus formats, tokens, vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions.text import THUNDERBIRD_RULES, basename, shorten, substitute_by_column
from emberlog.operators import lines as ops
from emberlog.operators.services import attach
from emberlog.plans import views as v
from emberlog.plans.registry import query
from emberlog.sources.files import spread


@query("C1_regex_clean", v.with_views("cleaned") + "SELECT log_id, cleaned_text FROM cleaned")
def regex_clean(spark, sf_dir):
    return v.cleaned(spark, sf_dir).select("log_id", "cleaned_text")


@query("C1_regex_clean_by_join", v.with_views("cleaned") + "SELECT log_id, cleaned_text FROM cleaned")
def regex_clean_by_join(spark, sf_dir):
    joined = attach(v.logs(spark, sf_dir), v.services(spark, sf_dir), ["regex_subs"])
    return joined.select("log_id", substitute_by_column(F.col("original_text"), F.col("regex_subs")).alias("cleaned_text"))


@query(
    "C2_hash64",
    v.with_views("cleaned") + f"SELECT log_id, hash, {v.sql_hash64('original_text')} AS original_hash FROM cleaned",
)
def hashed(spark, sf_dir):
    return v.cleaned(spark, sf_dir).select("log_id", "hash", v.spark_hash64("original_text").alias("original_hash"))


WORDS = r"[x for x in string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') if x <> '']"
VOCABULARY = f"""vocabulary AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id FROM (
  SELECT token, count(*) AS n FROM (SELECT unnest({WORDS}) AS token FROM documents) GROUP BY token))"""


@query("C12_vocabulary", f"WITH {VOCABULARY} SELECT token, n, token_id FROM vocabulary")
def vocabulary(spark, sf_dir):
    return ops.build_vocabulary(v.documents(spark, sf_dir))


@query(
    "C3_tokenize",
    f"""WITH {VOCABULARY}, words AS (SELECT doc_id, unnest(({WORDS})[1:510]) AS token,
          generate_subscripts(({WORDS})[1:510], 1) AS pos FROM documents),
        ids AS (SELECT doc_id, list(token_id ORDER BY pos) AS ids
                FROM words JOIN vocabulary USING (token) GROUP BY doc_id)
        SELECT d.doc_id, array_to_string(list_concat([2], coalesce(ids, []), [3],
                 [0 for x in range(510 - coalesce(len(ids), 0))]), ',') AS input_ids,
               coalesce(len(ids), 0) + 2 AS n_used FROM documents d LEFT JOIN ids USING (doc_id)""",
)
def tokenized(spark, sf_dir):
    documents = v.documents(spark, sf_dir)
    out = ops.tokenize(documents, ops.build_vocabulary(documents), "doc_id")
    return out.select(
        "doc_id",
        v.text_of("tokens.input_ids").alias("input_ids"),
        F.aggregate("tokens.attention_mask", F.lit(0), lambda a, b: a + b).alias("n_used"),
    )


@query(
    "C4_hdfs_clean",
    v.with_views("logs")
    + r"""SELECT log_id, regexp_extract(original_text, '(blk_-?\d+)', 1) AS block_id,
          regexp_replace(regexp_replace(regexp_replace(original_text, 'blk_-?\d+', 'BLK', 'g'),
          '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{1,5})?', 'IP', 'g'), '\d*\d', 'NUM', 'g') AS line FROM logs""",
)
def hdfs(spark, sf_dir):
    lines = v.logs(spark, sf_dir).select("log_id", F.col("original_text").alias("line"))
    return ops.parse_hdfs(lines).select("log_id", "block_id", "line")


def bgl_lines(spark, sf_dir):
    """Events in the layout of the BGL corpus."""
    e = spread(v.table(spark, sf_dir, "events"), "event_id")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("log_id"),
        F.concat(
            F.when(F.col("value") >= v.ANOMALY_VALUE, "APPREAD ").otherwise("- "),
            (F.lit(1117838570) + F.col("event_id")).cast("string"), F.lit(" "), F.date_format(ts, "yyyy.MM.dd"),
            F.lit(" R02-M1-N0-C:J"), F.col("user_id").cast("string"), F.lit("-U11 "),
            F.date_format(ts, "yyyy-MM-dd-HH.mm.ss.SSSSSS"), F.lit(" RAS KERNEL INFO "), F.col("event_type"),
            F.lit(" at 0x00AF12 of /var/log/app failed"),
        ).alias("line"),
    )


BGL_LINES = """bgl AS (SELECT event_id AS log_id, ts, value >= 60 AS is_anomaly, event_type FROM events)"""


@query(
    "C5_bgl_clean",
    f"""WITH {BGL_LINES} SELECT log_id, is_anomaly, epoch_us(ts) AS ts_us,
        CASE WHEN is_anomaly THEN 'APPREAD ' ELSE '' END || 'IARNUM DATE NODE DT RAS KERNEL INFO ' || event_type ||
        ' at MEM ofPATH failed' AS line FROM bgl""",
)
def bgl(spark, sf_dir):
    return ops.parse_bgl(bgl_lines(spark, sf_dir)).select(
        "log_id", "is_anomaly", v.micros("timestamp").alias("ts_us"), "line"
    )


def thunderbird_lines(spark, sf_dir):
    """Events in the layout of the Thunderbird corpus."""
    e = spread(v.table(spark, sf_dir, "events"), "event_id")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("log_id"),
        F.concat(
            F.when(F.col("value") >= v.ANOMALY_VALUE, "R_HDA ").otherwise("- "),
            (F.lit(1131566461) + F.col("event_id")).cast("string"), F.lit(" "), F.date_format(ts, "yyyy.MM.dd"),
            F.lit(" dn"), F.col("user_id").cast("string"), F.lit(" "), F.date_format(ts, "MMM d HH:mm:ss"),
            F.lit(" local@tbird-admin1 crond(pam_unix)["), F.col("event_id").cast("string"), F.lit("]: "),
            F.col("event_type"), F.lit(" opened /var/spool/mail for root@host from 10.0.0."),
            (F.col("user_id") % 256).cast("string"),
        ).alias("line"),
    )


def _sql_chain(column: str, rules) -> str:
    for pattern, replacement in rules:
        column = f"regexp_replace({column}, '{pattern}', '{replacement}', 'g')"
    return column


TB_LINES = """tb AS (SELECT event_id AS log_id, ts, value >= 60 AS is_anomaly,
  concat(CASE WHEN value >= 60 THEN 'R_HDA ' ELSE '- ' END, 1131566461 + event_id, ' ', strftime(ts, '%Y.%m.%d'), ' dn',
    user_id, ' ', strftime(ts, '%b '), day(ts), ' ', strftime(ts, '%H:%M:%S'), ' local@tbird-admin1 crond(pam_unix)[',
    event_id, ']: ', event_type, ' opened /var/spool/mail for root@host from 10.0.0.', user_id % 256) AS line FROM events)"""


@query(
    "C6_thunderbird_clean",
    f"""WITH {TB_LINES} SELECT log_id, is_anomaly, epoch_us(date_trunc('second', ts)) AS ts_us,
        {_sql_chain('line', THUNDERBIRD_RULES)} AS line FROM tb""",
)
def thunderbird(spark, sf_dir):
    return ops.parse_thunderbird(thunderbird_lines(spark, sf_dir)).select(
        "log_id", "is_anomaly", v.micros("timestamp").alias("ts_us"), "line"
    )


@query(
    "C7_alert_labels",
    f"WITH {TB_LINES} SELECT NOT starts_with(line, '- ') AS is_anomaly, count(*) AS n FROM tb GROUP BY 1",
)
def alerts(spark, sf_dir):
    parsed = ops.parse_thunderbird(thunderbird_lines(spark, sf_dir))
    return parsed.groupBy("is_anomaly").agg(F.count(F.lit(1)).alias("n"))


@query(
    "C8_time_from_text",
    f"""WITH {BGL_LINES} SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, count(*) AS n, min(epoch_us(ts)) AS first_us
        FROM bgl GROUP BY 1""",
)
def times(spark, sf_dir):
    parsed = ops.parse_bgl(bgl_lines(spark, sf_dir))
    return parsed.groupBy(v.micros(F.date_trunc("hour", "timestamp")).alias("hour_us")).agg(
        F.count(F.lit(1)).alias("n"), F.min(v.micros("timestamp")).alias("first_us")
    )


# replacements as re.sub reads them: numbered and named groups, a plain dollar, a digit after a group
GROUP_RULES = [
    (r"took (\d+)\.(\d+) ms", r"\2<\1>$"),
    (r"user=(?P<user>\d+)", r"$\g<user>0"),
    (r"blk_(\d)", r"b\g<1>7"),
]


@query(
    "C1_group_references",
    v.with_views("logs")
    + r"""SELECT log_id, regexp_replace(regexp_replace(regexp_replace(original_text, 'took (\d+)\.(\d+) ms', '\2<\1>$', 'g'),
          'user=(\d+)', '$\1' || '0', 'g'), 'blk_(\d)', 'b\1' || '7', 'g') AS cleaned_text FROM logs""",
)
def group_references(spark, sf_dir):
    rules = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(r).alias("replacement")) for p, r in GROUP_RULES])
    services = v.services(spark, sf_dir).withColumn("regex_subs", rules)
    return ops.clean(v.logs(spark, sf_dir), services).select("log_id", "cleaned_text")


@query(
    "C9_trace_ids",
    v.with_views("window_input") + "SELECT log_id, enable_trace, trace_id FROM window_input",
)
def traces(spark, sf_dir):
    return ops.extract_traces(v.logs(spark, sf_dir), v.services(spark, sf_dir)).select(
        "log_id", "enable_trace", "trace_id"
    )


@query(
    "C11_dashboard_cells",
    """SELECT doc_id, split_part(source, '/', -1) AS file, CASE WHEN length(text) > 800
       THEN substr(text, 1, 800) || '...' ELSE text END AS log FROM documents""",
)
def cells(spark, sf_dir):
    documents = v.table(spark, sf_dir, "documents")
    return documents.select("doc_id", basename(F.col("source")).alias("file"), shorten(F.col("text")).alias("log"))


@query(
    "C13_unique_lines",
    v.with_views("cleaned")
    + """SELECT block_id, string_agg(cleaned_text, ' ' ORDER BY f_ts, f_id) AS line FROM (
             SELECT regexp_extract(original_text, '(blk_-?[0-9]+)', 1) AS block_id, cleaned_text,
             min(ts) AS f_ts, arg_min(log_id, (ts, log_id)) AS f_id FROM cleaned GROUP BY 1, 2)
         GROUP BY block_id""",
)
def unique_per_block(spark, sf_dir):
    blocks = v.cleaned(spark, sf_dir).withColumn("block_id", F.regexp_extract("original_text", r"(blk_-?\d+)", 1))
    return ops.unique_lines(blocks, "block_id", "cleaned_text")
