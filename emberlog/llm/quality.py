"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed n-grams: runs of one to four bytes, single words and
pairs of words (words that repeat the one before, once or more, have features of their own).
Log-count ratios of the two classes are counted over all training rows. The indicators, scaled by
these ratios and to unit length, train a linear hinge-loss model by dual coordinate descent on a
bounded sample, and a logistic curve turns margins into scores.

Defined results: a null or empty text has no n-grams and gets the score of a margin of the bias
alone; without training rows of both classes every score is the share of label 1 among the
training rows, or 0.5 without any; rows without an id are never held out and are scored; rows
that repeat an id are scored each; an empty table gives an empty result; other columns,
language and source among them, are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import mix, seeds, slices, table, utf8, word_hashes
from emberlog.llm.labelled import held_out, sample_rows, training_rows
from emberlog.llm.registry import query

BITS = 17
#: rows of each label that the linear model is fitted on
SAMPLE_PER_LABEL = 1500
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12

_KIND = seeds(8, 11 << 40)


def ngrams(column: pa.Array, bits: int = BITS) -> Iterator[np.ndarray]:
    """The distinct feature numbers of every text, sorted."""
    shift = np.uint64(64 - bits)
    raw, starts = utf8(column)
    seen = np.zeros(1 << bits, dtype=bool)
    for a, b in slices(starts):
        part, at = raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
        grams, wide = [], np.zeros(len(part), dtype=np.uint64)
        for n in range(1, 5):
            # the n bytes from each place on as one number
            wide[: len(part) - n + 1] |= part[n - 1 :].astype(np.uint64) << np.uint64(8 * (n - 1))
            grams.append((((wide + np.uint64(n << 40)) * _KIND[0] ^ _KIND[1]) * _KIND[2] >> shift).astype(np.int32))
        words, _, counts = word_hashes(part, at, lower=False)
        again = np.zeros(len(words), dtype=bool)
        again[1:] = words[1:] == words[:-1]
        # the first word of a text follows no other
        again[counts[:-1][counts[:-1] < len(words)]] = False
        single = (mix(words + _KIND[3]) >> shift).astype(np.int32)
        pair = np.zeros(len(words), dtype=np.uint64)
        pair[1:] = mix(words[1:] * _KIND[4] + words[:-1])
        pair[again] = _KIND[5]
        thrice = np.flatnonzero(again[2:] & again[1:-1]) + 2
        pair[thrice] = _KIND[6]
        pair = (pair >> shift).astype(np.int32)
        for i in range(b - a):
            for n, gram in enumerate(grams, 1):
                seen[gram[at[i] : max(at[i], at[i + 1] - n + 1)]] = True
            first, last = counts[i], counts[i + 1]
            seen[single[first:last]] = True
            seen[pair[first + 1 : last]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found.astype(np.int32)


@dataclass
class QualityModel:
    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float
    constant: float | None = None

    def margin(self, found: np.ndarray) -> float:
        if not len(found):
            return self.bias
        return float(self.weights[found].sum() / max(np.sqrt(self.squares[found].sum()), 1e-9)) + self.bias

    def score(self, found: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def class_counts(rows: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Per feature the number of training rows with it (row 0: label 0, row 1: label 1), and rows per label."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((2, 1 << bits), dtype=np.int64), [0, 0]
        for batch in batches:
            for label, found in zip(batch.column(1).to_pylist(), ngrams(batch.column(0), bits)):
                counts[label, found] += 1
                n[label] += 1
        used = np.flatnonzero(counts.any(axis=0))
        # one row more than there are features carries the numbers of rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, 1 << bits))] + [pa.array(np.append(counts[k, used], n[k])) for k in (0, 1)],
            ["feature", "n0", "n1"],
        )

    sums = (
        rows.select("_text", "_label")
        .mapInArrow(count, "feature long, n0 long, n1 long")
        .groupBy("feature")
        .agg(F.sum("n0"), F.sum("n1"))
        .toArrow()
    )
    counts = np.zeros((2, (1 << bits) + 1), dtype=np.int64)
    for k in (0, 1):
        counts[k, sums.column(0).to_numpy()] = sums.column(k + 1).to_numpy()
    return counts[:, :-1], counts[:, -1]


def descend(examples: list[np.ndarray], values: np.ndarray, labels: np.ndarray, cost: float, epochs: int):
    """Weights and bias of the hinge-loss model by dual coordinate descent.

    An example has ``values`` at its features, scaled to unit length, and a constant 1 for the bias.
    """
    weights, bias = np.zeros(len(values)), 0.0
    scale = [1 / max(float(np.sqrt((values[x] ** 2).sum())), 1e-9) for x in examples]
    duals = np.zeros(len(examples))
    rng = np.random.default_rng(17)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(examples)):
            x, y = examples[i], labels[i]
            margin = y * (float(weights[x] @ values[x]) * scale[i] + bias)
            # the squared length of an example is 1 for the features and 1 for the constant
            new = min(max(duals[i] - (margin - 1) / 2, 0.0), cost)
            step = new - duals[i]
            if step:
                duals[i] = new
                weights[x] += step * y * scale[i] * values[x]
                bias += step * y
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weights, bias


def logistic(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through weighted labels, held back a little from 0 and 1."""
    target = np.where(labels > 0, 1 - 1e-3, 1e-3)
    design = np.column_stack([margins, np.ones(len(margins))])
    theta = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weight * (p - target)) + 1e-3 * theta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = BITS,
    sample_per_label: int = SAMPLE_PER_LABEL,
) -> QualityModel:
    """Counts over all training rows; the linear model on at most ``sample_per_label`` rows of each label."""
    rows = training_rows(docs, labels, label_col, id_col, text_col)
    counts, n = class_counts(rows, bits)
    empty = np.zeros(1 << bits, dtype=np.float32)
    if not n.all():
        return QualityModel(empty, empty, 0.0, 1.0, 0.0, float(n[1] / n.sum()) if n.sum() else 0.5)
    share = (counts + SMOOTHING) / (n[:, None] + 2 * SMOOTHING)
    ratios = np.log(share[1] / share[0])

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(ngrams(batch.column(0), bits))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["found", "label"])

    # descent depends on the order of its examples
    chosen = sample_rows(rows, sample_per_label).orderBy("_id", "_text")
    sample = chosen.select("_text", "_label").mapInArrow(features, "found array<int>, label int").toArrow()
    signs = np.where(sample.column(1).to_numpy() > 0, 1, -1)
    examples = [x.values.to_numpy() for chunk in sample.column(0).chunks for x in chunk]
    weights, bias = descend(examples, ratios, signs, COST, EPOCHS)
    model = QualityModel((weights * ratios).astype(np.float32), (ratios**2).astype(np.float32), bias, 1.0, 0.0)
    margins = np.array([model.margin(x) for x in examples])
    drawn = np.array([(signs < 0).sum(), (signs > 0).sum()])
    model.slope, model.shift = logistic(margins, signs, np.where(signs > 0, n[1] / drawn[1], n[0] / drawn[0]))
    return model


def score(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3
) -> DataFrame:
    """id, held_out, score and predicted (1: the score reaches ``threshold``) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = len(model.weights).bit_length() - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(found) for found in ngrams(batch.column(1), bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["_id", "_score"])

    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return narrow.mapInArrow(run, f"_id {kind}, _score double").select(
        F.col("_id").alias(id_col),
        held_out(F.col("_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
