"""The retrieval path on a stream: known lines skip, training lines seed, others are judged.

A micro-batch sees the normal store as it was when the batch started. Each distinct line is
embedded and judged once: an anomalous line is reported for all of its occurrences, a normal
one for the first only, as it then belongs to the store. Services without normal lines
report nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import retrieval
from emberlog.operators.embeddings import embed_cached, embed_trigrams
from emberlog.operators.joins import sized
from emberlog.operators.lines import clean
from emberlog.operators.services import attach
from emberlog.session import scratch, written
from emberlog.sources.tables import PartTable, Pins

VECTORS = "cls array<double>, tokens array<array<double>>"
STORED_FIELDS = ["log_id", "service", "node", "filename", "ts", "original_text", "cleaned_text", "hash"]


class RetrievalStream:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        load_services: Callable[[], DataFrame],
        embed: Callable[[DataFrame], DataFrame] = embed_trigrams,
        block_rows: int = retrieval.BLOCK_ROWS,
    ):
        self.spark, self.path, self.load_services = spark, path.rstrip("/"), load_services
        self.embed, self.block_rows = embed, block_rows
        self.normals = PartTable(spark, f"{self.path}/normals", f"service string, hash string, {VECTORS}")
        self.marked = PartTable(spark, f"{self.path}/marked-normal", f"service string, hash string, {VECTORS}")
        self.cache = PartTable(spark, f"{self.path}/vectors", f"hash string, {VECTORS}")
        self.predictions = PartTable(spark, f"{self.path}/predictions")
        self.pins = Pins(spark, f"{self.path}/marked-pins")

    def store(self, before: int | None = None) -> DataFrame:
        """Normal points: those learned before a micro-batch and those that users marked by then."""
        last = None if before is None else self.pins.pinned(before, self.marked)
        upto = None if before is None else 0 if last is None else last + 1
        learned, marked = self.normals.all(before), self.marked.all(upto)
        fresh = marked.dropDuplicates(["service", "hash"]).join(learned.select("service", "hash"), ["service", "hash"], "left_anti")
        return learned.unionByName(fresh)

    def mark_normal(self, lines: DataFrame) -> None:
        """Lines that a user called normal join the store of their service."""
        with scratch(self.spark):
            # lines may be dear to work out, and are looked at several times
            lines = written(lines.select("service", "hash", "cleaned_text", "ts", "log_id"), "lines-to-mark")
            distinct = written(retrieval.first_occurrences(lines, ["service", "hash"]), "marked-lines")
            vectors, _ = embed_cached(distinct, self.cache.all(), self.embed)
            self.marked.write(distinct.select("service", "hash").join(vectors, "hash").select("service", "hash", "cls", "tokens"))

    def process(self, logs: DataFrame, batch_id: int) -> None:
        """One micro-batch; the body of ``foreachBatch``."""
        with scratch(self.spark):
            self._process(logs, batch_id)

    def _process(self, logs: DataFrame, batch_id: int) -> None:
        services = self.load_services()
        store = self.store(batch_id)
        unknown = written(retrieval.unknown_lines(clean(logs, services), store), "unknown").select(*STORED_FIELDS)
        distinct = written(retrieval.first_occurrences(unknown, ["service", "hash"]), "unknown-lines")
        vectors, added = embed_cached(distinct, self.cache.all(batch_id), self.embed)
        self.cache.write(added, batch_id)
        vectors = self.cache.all(batch_id + 1)

        embedded = written(distinct.join(vectors, "hash"), "embedded")
        training, judged = retrieval.split_training(embedded, services)
        sized_queries = attach(judged, services, ["coreset_size"])
        scores = retrieval.score_lines(sized_queries, store, "coreset_size", block_rows=self.block_rows)
        verdicts = written(retrieval.judge(scores, services), "verdicts").select(
            "service", "hash", "score", "score_per_token", "is_anomaly"
        )
        normal = verdicts.filter("NOT is_anomaly")
        learned = training.unionByName(judged.join(sized(normal.select("service", "hash")), ["service", "hash"], "left_semi"))
        self.normals.write(learned.select("service", "hash", "cls", "tokens"), batch_id)

        anomalous = unknown.join(sized(verdicts.filter("is_anomaly")), ["service", "hash"])
        first_normal = distinct.join(sized(normal), ["service", "hash"])
        found = anomalous.unionByName(first_normal).withColumn("type", F.lit("rapid"))
        self.predictions.write(found, batch_id)

    def start(self, logs: DataFrame, **trigger):
        """Run on a stream of logs, resuming from the checkpoint under ``path``."""
        return (
            logs.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(**trigger)
            .start()
        )
