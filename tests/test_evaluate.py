from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import evaluate as ops


def frame(spark, seed, n=300, values=25):
    random.seed(seed)
    rows = [(i, int(random.random() < 0.3), float(random.randint(0, values))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, y int, score double")


@pytest.mark.parametrize("rows_per_range", [10**6, 4])
def test_curve_auc_and_average_precision(spark, rows_per_range):
    rows, df = frame(spark, 1)
    points = ops.curve(df, rows_per_range=rows_per_range)
    p = sum(y for _, y, _ in rows)
    expected, area, last = {}, 0.0, 0.0
    for t in sorted({s for *_, s in rows}, reverse=True):
        tp = sum(y for _, y, s in rows if s >= t)
        fp = sum(1 - y for _, y, s in rows if s >= t)
        expected[t] = (tp, fp, tp / (tp + fp), tp / p)
        area += (tp / p - last) * (tp / (tp + fp))
        last = tp / p
    got = {r.threshold: (r.tp, r.fp, r.precision, r.recall) for r in points.collect()}
    assert got.keys() == expected.keys()
    for t in got:
        assert got[t] == pytest.approx(expected[t])
    pairs = [(a, b) for _, ya, a in rows if ya for _, yb, b in rows if not yb]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert ops.roc_auc(points).first().auc == pytest.approx(auc)
    assert ops.average_precision(points).first().average_precision == pytest.approx(area)
    f1 = {t: 2 * a * b / (a + b) for t, (_, _, a, b) in expected.items() if a + b > 0}
    best = ops.best_threshold(points).first()
    assert best.f1 == pytest.approx(max(f1.values()))
    assert best.threshold == min(t for t in f1 if f1[t] == pytest.approx(max(f1.values())))


def test_report_and_confusion(spark):
    rows, df = frame(spark, 2)
    judged = df.withColumn("pred", F.col("score") > 12)
    tp = sum(y == 1 and s > 12 for _, y, s in rows)
    fp = sum(y == 0 and s > 12 for _, y, s in rows)
    fn = sum(y == 1 and s <= 12 for _, y, s in rows)
    tn = len(rows) - tp - fp - fn
    assert {(r.y, r.pred_0, r.pred_1) for r in ops.confusion_matrix(judged).collect()} == {(0, tn, fp), (1, fn, tp)}
    report = {r["class"]: r for r in ops.classification_report(judged).collect()}
    assert report["Anomaly"].precision == pytest.approx(tp / (tp + fp))
    assert report["Normal"].recall == pytest.approx(tn / (tn + fp))
    assert report["accuracy"].f1 == pytest.approx((tp + tn) / len(rows))
    assert report["macro avg"].recall == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)
    assert report["weighted avg"].support == len(rows)
    assert ops.f1_at(df, F.lit(12.0)).first().f1 == pytest.approx(2 * tp / (2 * tp + fp + fn))


def test_no_positives(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0)], "y int, score double")
    assert ops.best_threshold(ops.curve(df)).first().threshold is None
    assert ops.roc_auc(ops.curve(df)).first().auc is None
    assert {r.f1 for r in ops.classification_report(df.withColumn("pred", F.lit(False))).collect()} >= {0.0, 1.0}


@pytest.mark.parametrize("rows_per_range", [10**6, 20])
def test_splits(spark, rows_per_range):
    rows = [(i, i % 4 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, is_anomaly boolean")
    normals, anomalies = [i for i, a in rows if not a], [i for i, a in rows if a]
    got = ops.positional_split(df, ["id"], 50, 30, 20, rows_per_range=rows_per_range).collect()
    assert sorted(r.id for r in got if r.split == "train") == normals[:50]
    assert sorted(r.id for r in got if r.split == "test") == sorted(normals[50:80] + anomalies[:20])
    whole = ops.positional_split(df, ["id"], 50, rows_per_range=rows_per_range)
    assert whole.count() == 200 and whole.filter("split = 'train'").count() == 50

    shuffled = ops.shuffled_split(df, "id", 40, seed=3, rows_per_range=rows_per_range)
    train = {r.id for r in shuffled.filter("split = 'train'").collect()}
    again = {r.id for r in ops.shuffled_split(df, "id", 40, seed=3).filter("split = 'train'").collect()}
    other = {r.id for r in ops.shuffled_split(df, "id", 40, seed=4).filter("split = 'train'").collect()}
    assert train == again != other and len(train) == 40 and train <= set(normals) and train != set(normals[:40])

    cut = ops.train_validation_cut(df, ["id"], 0.9, rows_per_range).collect()
    assert sorted(r.id for r in cut if r.part == "train") == list(range(180))


def test_sample_and_merges(spark):
    df = spark.range(500).withColumnRenamed("id", "doc")
    assert {r.doc for r in ops.sample_rows(df, "doc", 20, 1).collect()} == {r.doc for r in ops.sample_rows(df, "doc", 20, 1).collect()}
    lines = spark.createDataFrame([("b1", "x"), ("b2", "y"), ("b1", "z")], "block_id string, line string")
    labels = spark.createDataFrame([("b1", 1), ("b9", 0)], "BlockId string, is_anomaly long")
    assert sorted(r.line for r in ops.merge_labels(lines, labels).collect()) == ["x", "z"]
