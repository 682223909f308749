"""Two detectors with fit / transform, built from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.sequences import frame_truncated
from emberlog.functions.text import hash64
from emberlog.operators import nextkey
from emberlog.operators.embeddings import embed_trigrams
from emberlog.operators.retrieval import broadcast_back, core_set_size, distinct_texts, score_lines
from emberlog.session import written

Embedder = Callable[[DataFrame], DataFrame]


class RetrievalDetector:
    """Fit on normal lines; score a line by MaxSim against its nearest normal lines.

    Every distinct text is embedded and scored once and the score mapped back to all of
    its occurrences. The nearest neighbour itself is dropped from the core set.
    """

    def __init__(self, embed: Embedder = embed_trigrams, text: str = "cleaned_text", drop_first: bool = True):
        self.embed, self.text, self.drop_first = embed, text, drop_first
        self.normals: DataFrame | None = None
        self.core_size = 0

    def _unique(self, lines: DataFrame) -> DataFrame:
        texts = distinct_texts(lines.select(F.col(self.text).alias("cleaned_text")))
        embedded = self.embed(texts).withColumns({"hash": hash64(F.col("cleaned_text")), "corpus": F.lit(0)})
        return written(embedded, "unique-lines")

    def fit(self, normal_lines: DataFrame) -> RetrievalDetector:
        self.normals = self._unique(normal_lines)
        self.core_size = core_set_size(self.normals.count())
        return self

    def transform(self, lines: DataFrame) -> DataFrame:
        """Add ``score`` and ``score_per_token``."""
        unique = self._unique(lines)
        scores = score_lines(
            unique, self.normals, self.core_size, "euclidean", self.drop_first, group="corpus"
        )
        by_text = unique.select("cleaned_text", "hash").join(scores, "hash").select(
            F.col("cleaned_text").alias(self.text), "score", "score_per_token"
        )
        return broadcast_back(lines, written(by_text, "line-scores"), self.text, "left")


class NextKeyDetector:
    """Fit on normal key sequences (column ``line``); flag a sequence with a key outside the top k.

    A sequence is framed and cut to ``context`` ids. ``sliding`` takes sequences as they are, as
    windows of a longer stream without begin and end; the first key is then only a prompt. Sessions
    too long for a row go through ``fit_positions`` and ``judge_positions``, which work as ``sliding`` does.
    """

    def __init__(self, top_k: int = 80, order: int = nextkey.ORDER, context: int = 256, sliding: bool = False):
        self.top_k, self.order, self.context, self.sliding = top_k, order, context, sliding
        self.model: DataFrame | None = None

    def _framed(self, sequences: DataFrame) -> DataFrame:
        ids = F.col("line") if self.sliding else frame_truncated(F.col("line"), self.context)
        framed = sequences.withColumn("input_ids", ids)
        return framed if "service" in sequences.columns else framed.withColumn("service", F.lit(""))

    def fit(self, sequences: DataFrame) -> NextKeyDetector:
        self.model = written(nextkey.train(self._framed(sequences), self.order), "next-keys")
        return self

    def update(self, sequences: DataFrame, weight: int = 1) -> NextKeyDetector:
        """Fine-tune: add the counts of more sequences."""
        self.model = written(
            nextkey.update(self.model, self._framed(sequences), self.order, weight=weight), "next-keys"
        )
        return self

    def transform(self, sequences: DataFrame, key: str) -> DataFrame:
        """Add ``n_positions``, ``n_miss``, ``first_miss_pos`` and ``is_predicted``."""
        framed = self._framed(sequences).withColumn("chunk_id", F.col(key))
        top_k = self.model.select("service").distinct().withColumn("top_k", F.lit(self.top_k))
        found = nextkey.detect(framed, self.model, top_k, self.order).drop("service")
        return sequences.join(
            found.withColumnRenamed("chunk_id", key).withColumnRenamed("is_anomaly", "is_predicted"), key, "left"
        )

    def fit_positions(self, positioned: DataFrame, key: str) -> NextKeyDetector:
        """Fit on sessions with one row per key: ``key``, ``pos`` from 1 and ``key_id``."""
        contexts = nextkey.session_contexts(positioned, key, self.order)
        self.model = written(nextkey.ranked(nextkey.count_positions(contexts)), "next-keys")
        return self

    def judge_positions(self, positioned: DataFrame, key: str) -> DataFrame:
        """``key``, ``n_positions``, ``n_miss``, ``first_miss_pos`` and ``is_predicted`` of sessions of two keys or more."""
        top_k = self.model.select("service").distinct().withColumn("top_k", F.lit(self.top_k))
        contexts = written(nextkey.session_contexts(positioned, key, self.order), "session-contexts")
        found = nextkey.judge(contexts, self.model, top_k, self.order).drop("service")
        return found.withColumnRenamed("chunk_id", key).withColumnRenamed("is_anomaly", "is_predicted")
