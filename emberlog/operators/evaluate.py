"""Splits and detection metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.ordering import ROWS_PER_RANGE, number_rows, running_totals
from emberlog.session import written


def _up_to(df: DataFrame, order: Sequence[str], cuts: dict[str, tuple[Column, int]], rows_per_range: int) -> dict[str, Column]:
    """For each (rows, n): the condition that a row is not behind the n-th of those rows.

    Only the order columns are numbered, to find the n-th rows; ``df`` itself is not
    shuffled. With fewer than n rows the condition always holds.
    """
    found = []
    for name, (rows, n) in cuts.items():
        numbered = number_rows(df.filter(rows).select(*order), order, (), "_no", rows_per_range)
        found.append(numbered.filter(F.col("_no") == n).select(F.lit(name).alias("_cut"), F.struct(*order).alias("_at")))
    table = found[0]
    for more in found[1:]:
        table = table.unionByName(more)
    table = written(table, "cuts")
    here = F.struct(*order)
    return {
        name: F.lit(False)
        if n < 1
        else F.coalesce(here <= table.filter(F.col("_cut") == name).select("_at").scalar(), F.lit(True))
        for name, (_, n) in cuts.items()
    }


def positional_split(
    df: DataFrame,
    order: Sequence[str],
    train_size: int,
    test_normal_size: int | None = None,
    test_abnormal_size: int | None = None,
    label: str = "is_anomaly",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``split``: the first ``train_size`` normals train; later normals and the anomalies test.

    With test sizes, rows beyond them belong to neither and are left out.
    """
    anomaly = F.col(label).cast("int") == 1
    cuts = {"train": (~anomaly, train_size)}
    if test_normal_size is not None:
        cuts["normal"] = (~anomaly, train_size + test_normal_size)
    if test_abnormal_size is not None:
        cuts["abnormal"] = (anomaly, test_abnormal_size)
    up_to = _up_to(df, order, cuts, rows_per_range)
    tested = F.when(anomaly, up_to.get("abnormal", F.lit(True))).otherwise(up_to.get("normal", F.lit(True)))
    split = F.when(~anomaly & up_to["train"], "train").when(tested, "test")
    return df.withColumn("split", split).filter("split IS NOT NULL")


def shuffle_key(seed: int, key: Column) -> Column:
    """Repeatable random order: a number in [0, 2^52) from a salted hash."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 13), 16, 10).cast("long")


def shuffled_split(
    df: DataFrame,
    key: str,
    train_size: int,
    seed: int = 0,
    label: str = "is_anomaly",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``split``: ``train_size`` normals in a seeded random order train, all else tests."""
    keyed = df.withColumn("_order", shuffle_key(seed, F.col(key)))
    return positional_split(keyed, ["_order", key], train_size, label=label, rows_per_range=rows_per_range).drop("_order")


def train_validation_cut(
    df: DataFrame, order: Sequence[str], ratio: float = 0.9, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Add ``part``: ``train`` for the first ``floor(ratio * n)`` rows, else ``validation``."""
    up_to = _up_to(df, order, {"train": (F.lit(True), int(ratio * df.count()))}, rows_per_range)
    return df.withColumn("part", F.when(up_to["train"], "train").otherwise("validation"))


def sample_rows(df: DataFrame, key: str, n: int = 100, seed: int = 0) -> DataFrame:
    """``n`` rows in a seeded random order."""
    return df.withColumn("_order", shuffle_key(seed, F.col(key))).orderBy("_order", key).limit(n).drop("_order")


def merge_labels(lines: DataFrame, labels: DataFrame, left: str = "block_id", right: str = "BlockId") -> DataFrame:
    """Inner equi join of lines with their labels."""
    return lines.join(labels, F.col(left) == F.col(right), "inner")


def merge_index(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    return left.join(right, index, "inner")


def curve(scored: DataFrame, y: str = "y", score: str = "score", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Precision and recall at every distinct score, predicting positive at ``score >= threshold``.

    Rows are first counted per distinct score, so ties shrink before any shuffle. ``tp`` and
    ``fp`` are counts at or above the threshold, ``pos`` and ``neg`` those exactly at it.
    """
    counts = scored.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"),
        F.sum(1 - F.col(y).cast("long")).alias("neg"),
    )
    counts = written(counts, "score-counts")
    falling = counts.withColumn("_falling", -F.col("threshold"))
    sums = running_totals(falling, {"tp": F.col("pos"), "fp": F.col("neg")}, ["_falling"], (), rows_per_range)
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    total_pos, total_neg = totals.select("p").scalar(), totals.select("n").scalar()
    recall = F.try_divide(F.col("tp"), total_pos)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return sums.drop("_falling").withColumns(
        {
            "precision": precision,
            "recall": recall,
            "f1": F.try_divide(2 * precision * recall, precision + recall),
            "total_pos": total_pos,
            "total_neg": total_neg,
        }
    )


def best_threshold(points: DataFrame) -> DataFrame:
    """Threshold with the highest F1; the lowest one among equals."""
    best = points.filter("f1 IS NOT NULL").agg(
        F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")
    )
    return best.select("b.threshold", "b.f1")


def confusion(scored: DataFrame, y: str = "y", predicted: str = "pred") -> DataFrame:
    """One row with the four counts tn, fp, fn, tp."""
    truth, guess = F.col(y).cast("int") == 1, F.col(predicted).cast("int") == 1
    return scored.agg(
        F.count_if(~truth & ~guess).alias("tn"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(truth & guess).alias("tp"),
    )


def confusion_matrix(scored: DataFrame, y: str = "y", predicted: str = "pred") -> DataFrame:
    """Rows by true class, columns by predicted class."""
    counts = confusion(scored, y, predicted)
    rows = F.array(
        F.struct(F.lit(0).alias("y"), F.col("tn").alias("pred_0"), F.col("fp").alias("pred_1")),
        F.struct(F.lit(1).alias("y"), F.col("fn").alias("pred_0"), F.col("tp").alias("pred_1")),
    )
    return counts.select(F.inline(rows))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / F.nullif(bottom, F.lit(0)))


def classification_report(scored: DataFrame, y: str = "y", predicted: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means and accuracy."""
    c = confusion(scored, y, predicted)
    tn, fp, fn, tp = (F.col(n) for n in ("tn", "fp", "fn", "tp"))

    def scores(hit, wrong, missed):
        precision, recall = _ratio(hit, hit + wrong), _ratio(hit, hit + missed)
        return precision, recall, _ratio(2 * precision * recall, precision + recall), hit + missed

    normal, anomaly = scores(tn, fn, fp), scores(tp, fp, fn)
    n = normal[3] + anomaly[3]
    accuracy = _ratio(tp + tn, n)
    macro = [(a + b) / 2 for a, b in zip(normal[:3], anomaly[:3])]
    weighted = [_ratio(a * normal[3] + b * anomaly[3], n) for a, b in zip(normal[:3], anomaly[:3])]

    def line(name, values, support):
        cells = [v.cast("double").alias(a) for v, a in zip(values, ("precision", "recall", "f1"))]
        return F.struct(F.lit(name).alias("class"), *cells, support.cast("long").alias("support"))

    return c.select(
        F.inline(
            F.array(
                line("Normal", normal[:3], normal[3]),
                line("Anomaly", anomaly[:3], anomaly[3]),
                line("accuracy", [accuracy] * 3, n),
                line("macro avg", macro, n),
                line("weighted avg", weighted, n),
            )
        )
    )


def f1_at(scored: DataFrame, threshold: Column, y: str = "y", score: str = "score") -> DataFrame:
    """F1 of the strict rule ``score > threshold``."""
    judged = scored.withColumn("pred", F.col(score) > threshold)
    c = confusion(judged, y)
    return c.select(_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def roc_auc(points: DataFrame) -> DataFrame:
    """Area under the ROC curve from curve points: ties count half."""
    below = F.col("total_neg") - F.col("fp")
    pairs = F.sum((F.col("pos") * (below + F.col("neg") / 2)).cast("double"))
    return points.agg(
        F.try_divide(pairs, F.first("total_pos").cast("double") * F.first("total_neg").cast("double")).alias("auc")
    )


def average_precision(points: DataFrame) -> DataFrame:
    """Sum of precision times the recall gained at each threshold."""
    gain = F.col("pos") / F.col("total_pos")
    return points.agg(F.sum(F.col("precision") * gain).alias("average_precision"))
