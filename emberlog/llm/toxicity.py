"""Toxicity: a bidirectional recurrent network over all overlapping windows of a text.

Words are runs of letters, digits and bytes above 127, lower-cased (A-Z). A window holds 32 words
and the next one begins 16 words later, so every word but the first and last few is read in two
windows. A text's score is its most toxic window's, through a logistic curve.

Labels belong to texts, not to windows, so each epoch trains on every text's currently most toxic
window, beside a random window of the texts of label 0. The first choice is by the most telling
word in a window.

Defined results: a null or empty text, or one without words, is one window of padding and gets the
lowest score any window can give on its own: 0; without training rows of both classes every score
is the share of label 1 among them, or 0 without any; rows without an id are never held out and
are scored; rows that repeat an id are scored each; an empty table gives an empty result; other
columns, language and source among them, are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import mix, seeds, slices, table, utf8, word_hashes
from emberlog.llm.gru import Adam, Params, Words, forward, gradients, new_params
from emberlog.llm.labelled import held_out, sample_rows, training_rows
from emberlog.llm.quality import logistic
from emberlog.llm.registry import query

WINDOW, STRIDE = 32, 16
SLOTS = 1 << 13
SIZE, HIDDEN, ATTENTION = 8, 8, 8
GRAM = 4
#: bytes of text that are scored at a time
SLICE = 1 << 18
#: texts of each label that the network is trained on
SAMPLE_PER_LABEL = 1200
EPOCHS, BATCH, RATE = 6, 64, 0.01

#: bytes that end a word: all of ASCII but letters and digits
_GAPS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_KIND = seeds(GRAM + 2, 21 << 40)


def distinct_words(raw: np.ndarray, starts: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the number of each occurring word's, words before each text, and hashes."""
    hashes, begins, counts = word_hashes(raw, starts, gaps=_GAPS)
    names, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    if not len(names):
        return Words(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)), which, counts, names
    at = begins[first]
    stops = np.flatnonzero(np.append(_GAPS[raw], True))
    # a word ends at the next gap or at the end of its text
    end = np.minimum(stops[np.searchsorted(stops, at)], starts[np.searchsorted(starts, at, side="right")])
    length = end - at + 2  # with a mark on either side
    begin = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(begin, length)
    edge = (place == 0) | (place == np.repeat(length, length) - 1)
    byte = np.where(edge, 0, raw[np.minimum(np.repeat(at, length) + place - 1, len(raw) - 1)]).astype(np.uint64)
    upper = (byte >= 65) & (byte <= 90)
    byte[upper] += np.uint64(32)
    left = np.repeat(length, length) - place  # bytes from here to the end of the marked word
    grams, owner, wide = [], [], np.zeros(len(byte), dtype=np.uint64)
    number = np.repeat(np.arange(len(names)), length)
    for n in range(1, GRAM + 1):
        wide[: len(wide) - n + 1] |= byte[n - 1 :] << np.uint64(8 * (n - 1))
        if n >= 3:
            ok = np.flatnonzero(left >= n)
            grams.append(mix(wide[ok] * _KIND[0] + _KIND[n]) % np.uint64(SLOTS))
            owner.append(number[ok])
    owner, grams = np.concatenate(owner), np.concatenate(grams).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    slots = (mix(names + _KIND[0]) % np.uint64(SLOTS)).astype(np.int64)
    return Words(slots, grams[order], np.searchsorted(owner[order], np.arange(len(names)))), which, counts, names


def text_windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts: first word, number of words, and the number of windows before each text."""
    n_words = np.diff(counts)
    n = np.where(n_words > 0, np.maximum(0, -(-(n_words - WINDOW) // STRIDE)) + 1, 0)
    before = np.concatenate([[0], np.cumsum(n)])
    number = np.arange(before[-1]) - np.repeat(before[:-1], n)
    first = np.repeat(counts[:-1], n) + number * STRIDE
    return first, np.minimum(WINDOW, np.repeat(counts[1:], n) - first), before


def gather(which: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as (step, window) numbers of words, and 1 where there is a word."""
    at = first[None, :] + np.arange(WINDOW)[:, None]
    real = (np.arange(WINDOW)[:, None] < size[None, :]).astype(np.float32)
    return which[np.minimum(at, len(which) - 1)], real


def window_logits(params: Params, words: Words, which: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.empty(len(first), dtype=np.float32)
    for a in range(0, len(first), 4096):
        out[a : a + 4096] = forward(params, words, *gather(which, first[a : a + 4096], size[a : a + 4096]))
    return out


def top_logits(column: pa.Array, params: Params) -> Iterator[np.ndarray]:
    """Largest window logit of every text, slice by slice; minus infinity without words."""
    raw, starts = utf8(column)
    for a, b in slices(starts, SLICE):
        words, which, counts, _ = distinct_words(raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        first, size, before = text_windows(counts)
        out = np.full(b - a, -np.inf)
        some = np.flatnonzero(np.diff(before))
        if len(some):
            out[some] = np.maximum.reduceat(window_logits(params, words, which, first, size), before[some])
        yield out


@dataclass
class ToxicityModel:
    params: Params | None
    slope: float = 1.0
    shift: float = 0.0
    constant: float = 0.0

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.params is None:
            return np.full(len(column), self.constant)
        logits = np.concatenate([np.zeros(0), *top_logits(column, self.params)])
        known = np.isfinite(logits)
        curve = 1 / (1 + np.exp(-np.clip(self.slope * np.where(known, logits, 0) + self.shift, -30, 30)))
        return np.where(known, curve, 0.0)


def _part(words: Words, wanted: np.ndarray) -> Words:
    """Only the words with the given numbers, in that order."""
    counts = words.counts()[wanted]
    at = np.repeat(words.begins[wanted] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    return Words(words.slot[wanted], words.grams[at], np.cumsum(counts) - counts)


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS) -> tuple[Params, np.ndarray]:
    """Network parameters, and the largest logit of every text under them."""
    raw, starts = utf8(texts)
    words, which, counts, _ = distinct_words(raw, starts)
    first, size, before = text_windows(counts)
    some = np.flatnonzero(np.diff(before))
    params = new_params(SLOTS, SIZE, HIDDEN, ATTENTION)
    rng = np.random.default_rng(7)

    # log-odds of words by texts, to choose the first windows
    text_of = np.repeat(np.arange(len(labels)), np.diff(counts))
    seen = np.unique(text_of * np.int64(len(words.slot)) + which)
    of = [np.bincount((seen % len(words.slot))[labels[seen // len(words.slot)] == k], minlength=len(words.slot)) for k in (0, 1)]
    odds = np.log((of[1] + 0.5) / (of[0] + 0.5))
    at, real = gather(which, first, size)
    best = np.where(real > 0, odds[at], -np.inf).max(axis=0)
    del at, real

    adam = Adam(params, RATE)
    for epoch in range(epochs):
        if epoch:
            best = window_logits(params, words, which, first, size)
        order = np.lexsort((best, np.repeat(np.arange(len(labels)), np.diff(before))))
        tops = order[before[some + 1] - 1]
        clean = some[labels[some] == 0]
        others = before[clean] + (rng.random(len(clean)) * np.diff(before)[clean]).astype(np.int64)
        windows = np.concatenate([tops, others])
        wanted = np.concatenate([labels[some], np.zeros(len(others))]).astype(np.float32)
        mixed = rng.permutation(len(windows))
        if epoch == epochs - 2:
            adam.rate /= 4
        for a in range(0, len(mixed), BATCH):
            chosen = windows[mixed[a : a + BATCH]]
            at, real = gather(which, first[chosen], size[chosen])
            used, local = np.unique(at, return_inverse=True)
            _, slopes = gradients(params, _part(words, used), local.reshape(at.shape), real, wanted[mixed[a : a + BATCH]])
            adam.move(params, slopes)
    logits = np.full(len(labels), -np.inf)
    logits[some] = np.maximum.reduceat(window_logits(params, words, which, first, size), before[some])
    return params, logits


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_per_label: int = SAMPLE_PER_LABEL,
) -> ToxicityModel:
    """A network trained on at most ``sample_per_label`` labelled texts of each class."""
    rows = training_rows(docs, labels, label_col, id_col, text_col)
    n = dict(rows.groupBy("_label").count().collect())
    if not (n.get(0) and n.get(1)):
        return ToxicityModel(None, constant=n.get(1, 0) / max(1, sum(n.values())))
    sample = sample_rows(rows, sample_per_label).orderBy("_id", "_text").select("_text", "_label").toArrow()
    texts, given = sample.column(0).combine_chunks(), sample.column(1).to_numpy()
    params, logits = fit(texts, given)
    known = np.isfinite(logits)
    if not known.any():
        return ToxicityModel(None, constant=n[1] / sum(n.values()))
    drawn = np.maximum(1, np.bincount(given, minlength=2))
    slope, shift = logistic(logits[known], np.where(given > 0, 1, -1)[known], np.array([n[0], n[1]])[given[known]] / drawn[given[known]])
    return ToxicityModel(params, slope, shift)


def score(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """id, held_out, score and predicted (1: the score reaches ``threshold``) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["_id", "_score"])

    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return narrow.mapInArrow(run, f"_id {kind}, _score double").select(
        F.col("_id").alias(id_col),
        held_out(F.col("_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
