"""Splits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import evaluate as ops
from emberlog.operators.windows import session_sequences
from emberlog.plans import views as v
from emberlog.plans.registry import query

TRAIN, TEST_NORMAL, TEST_ABNORMAL = 500, 200, 100
THRESHOLD = 2000
CURVE = """curve AS (SELECT threshold, pos, neg, sum(pos) OVER (ORDER BY threshold DESC) AS tp,
  sum(neg) OVER (ORDER BY threshold DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (
  SELECT score AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY score)),
  points AS (SELECT *, tp / (tp + fp) AS precision, tp / p AS recall,
  CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p) END AS f1 FROM curve)"""


def _split_sql(normal_limit: str, abnormal_limit: str, order: str, columns: str = "log_id") -> str:
    return v.with_views("logs") + f"""SELECT {columns}, split FROM (SELECT *, CASE
      WHEN NOT is_anomaly AND rn <= {TRAIN} THEN 'train' WHEN is_anomaly AND {abnormal_limit} THEN 'test'
      WHEN NOT is_anomaly AND {normal_limit} THEN 'test' END AS split FROM (
        SELECT *, row_number() OVER (PARTITION BY is_anomaly ORDER BY {order}) AS rn FROM logs)) WHERE split IS NOT NULL"""


@query("I1_positional_split", _split_sql("true", "true", "ts, log_id"))
def split(spark, sf_dir):
    return ops.positional_split(v.logs(spark, sf_dir), ["ts", "log_id"], TRAIN).select("log_id", "split")


@query(
    "I1_positional_split_sized",
    _split_sql(f"rn <= {TRAIN + TEST_NORMAL}", f"rn <= {TEST_ABNORMAL}", "ts, log_id"),
)
def split_sized(spark, sf_dir):
    logs = v.logs(spark, sf_dir)
    parts = ops.positional_split(logs, ["ts", "log_id"], TRAIN, TEST_NORMAL, TEST_ABNORMAL, rows_per_range=500)
    return parts.select("log_id", "split")


SHUFFLED = "concat('0x', substr(sha256('7:' || log_id), 1, 13))::UBIGINT, log_id"


@query("I2_shuffled_split", _split_sql("true", "true", SHUFFLED))
def split_shuffled(spark, sf_dir):
    return ops.shuffled_split(v.logs(spark, sf_dir), "log_id", TRAIN, seed=7).select("log_id", "split")


@query(
    "I3_train_validation",
    v.with_views("logs")
    + """SELECT log_id, CASE WHEN row_number() OVER (ORDER BY ts, log_id) <= floor(0.9 * (SELECT count(*) FROM logs))
         THEN 'train' ELSE 'validation' END AS part FROM logs""",
)
def validation(spark, sf_dir):
    logs = v.logs(spark, sf_dir)
    return ops.train_validation_cut(logs, ["ts", "log_id"], 0.9, rows_per_range=1000).select("log_id", "part")


@query(
    "I4_merge_labels",
    """SELECT d.doc_id, lang, toxic FROM documents d JOIN labels l ON 'd' || d.doc_id = 'd' || l.doc_id""",
)
def labels(spark, sf_dir):
    lines = v.table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("block_id")
    )
    marks = v.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("BlockId"), "toxic"
    )
    return ops.merge_labels(lines, marks).select("doc_id", "lang", "toxic")


@query(
    "I5_merge_index",
    v.with_views("keyed")
    + """SELECT block_id, count(*) AS n_keys, arg_min(is_anomaly, (ts, log_id)) AS is_anomaly, max(is_anomaly) AS any_anomaly
         FROM (SELECT *, regexp_extract(original_text, '(blk_-?[0-9]+)', 1) AS block_id FROM keyed) GROUP BY block_id""",
)
def index(spark, sf_dir):
    blocks = v.keyed_logs(spark, sf_dir).withColumn("block_id", F.regexp_extract("original_text", r"(blk_-?\d+)", 1))
    sequences = session_sequences(blocks, "block_id", first=1).select("block_id", "n_keys", "is_anomaly")
    marks = blocks.groupBy("block_id").agg(F.max("is_anomaly").alias("any_anomaly"))
    return ops.merge_index(sequences, marks, "block_id")


def points(spark, sf_dir, rows_per_range=100):
    return ops.curve(v.scored_documents(spark, sf_dir), rows_per_range=rows_per_range)


@query(
    "I6_precision_recall_curve",
    v.with_views("scored")
    + f", {CURVE} SELECT threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM points",
)
def pr_curve(spark, sf_dir):
    return points(spark, sf_dir).select(
        "threshold", "tp", "fp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall")
    )


@query(
    "I7_best_threshold",
    v.with_views("scored")
    + f", {CURVE} SELECT threshold, round(f1, 6) AS f1 FROM points WHERE f1 IS NOT NULL ORDER BY points.f1 DESC, threshold LIMIT 1",
)
def best(spark, sf_dir):
    return ops.best_threshold(points(spark, sf_dir)).select("threshold", F.round("f1", 6).alias("f1"))


def judged(spark, sf_dir):
    return v.scored_documents(spark, sf_dir).withColumn("pred", F.col("score") > THRESHOLD)


COUNTS = f"""c AS (SELECT count(*) FILTER (y = 0 AND NOT pred) AS tn, count(*) FILTER (y = 0 AND pred) AS fp,
  count(*) FILTER (y = 1 AND NOT pred) AS fn, count(*) FILTER (y = 1 AND pred) AS tp, count(*) AS n
  FROM (SELECT *, score > {THRESHOLD} AS pred FROM scored))"""


@query(
    "I8_classification_report",
    v.with_views("scored")
    + f""", {COUNTS}, m AS (SELECT 'Normal' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, tn + fp AS support FROM c
          UNION ALL SELECT 'Anomaly', tp / (tp + fp), tp / (tp + fn), tp + fn FROM c),
          f AS (SELECT *, 2 * p * r / (p + r) AS f1 FROM m),
          u AS (SELECT class, p, r, f1, support FROM f
            UNION ALL SELECT 'accuracy', (tp + tn) / n, (tp + tn) / n, (tp + tn) / n, n FROM c
            UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), sum(support) FROM f
            UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
              sum(f1 * support) / sum(support), sum(support) FROM f)
          SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1,
            CAST(support AS BIGINT) AS support FROM u""",
)
def report(spark, sf_dir):
    r = ops.classification_report(judged(spark, sf_dir))
    return r.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "I9_f1_at_best",
    v.with_views("scored")
    + f""", {CURVE}, b AS (SELECT threshold FROM points WHERE f1 IS NOT NULL ORDER BY points.f1 DESC, threshold LIMIT 1),
          c AS (SELECT count(*) FILTER (y = 0 AND pred) AS fp, count(*) FILTER (y = 1 AND NOT pred) AS fn,
            count(*) FILTER (y = 1 AND pred) AS tp FROM (SELECT *, score > (SELECT threshold FROM b) AS pred FROM scored))
          SELECT round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
)
def f1(spark, sf_dir):
    threshold = ops.best_threshold(points(spark, sf_dir)).select("threshold").scalar()
    return ops.f1_at(v.scored_documents(spark, sf_dir), threshold).select(F.round("f1", 6).alias("f1"))


@query(
    "I10_confusion_matrix",
    v.with_views("scored")
    + f", {COUNTS} SELECT 0 AS y, tn AS pred_0, fp AS pred_1 FROM c UNION ALL SELECT 1, fn, tp FROM c",
)
def matrix(spark, sf_dir):
    return ops.confusion_matrix(judged(spark, sf_dir))


@query(
    "I11_roc_auc",
    v.with_views("scored")
    + """SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc
         FROM (SELECT score FROM scored WHERE y = 1) a, (SELECT score FROM scored WHERE y = 0) b""",
)
def auc(spark, sf_dir):
    return ops.roc_auc(points(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


@query(
    "I12_average_precision",
    v.with_views("scored") + f", {CURVE} SELECT round(sum(precision * pos / p), 6) AS average_precision FROM points",
)
def average_precision(spark, sf_dir):
    return ops.average_precision(points(spark, sf_dir)).select(F.round("average_precision", 6).alias("average_precision"))


@query(
    "I13_sample",
    """SELECT doc_id FROM documents ORDER BY concat('0x', substr(sha256('3:' || doc_id), 1, 13))::UBIGINT, doc_id LIMIT 100""",
)
def sample(spark, sf_dir):
    return ops.sample_rows(v.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, seed=3)
