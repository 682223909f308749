"""Predictions → stored anomalies and the live feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import feedback
from emberlog.sources.tables import PartTable

FEED_SCHEMA = (
    "type string, id string, hash string, service string, nodes array<string>, filenames array<string>, "
    "start_ts timestamp, end_ts timestamp, text string"
)


class FeedWriter:
    """Appends the entries of new predictions to the feed; a prediction that comes twice is kept once.

    Each kind of prediction has part numbers and a checkpoint of its own, as each is a stream of its
    own; the feed is both together.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        kinds = (feedback.LINE_TYPE, feedback.SEQUENCE_TYPE)
        self.feeds = {kind: PartTable(spark, f"{self.path}/feed-{kind}", FEED_SCHEMA) for kind in kinds}

    def feed(self) -> DataFrame:
        lines, sequences = (table.all() for table in self.feeds.values())
        return lines.unionByName(sequences)

    def _append(self, kind: str, entries: DataFrame, batch_id: int) -> None:
        table = self.feeds[kind]
        seen = table.all(batch_id).select("id")
        fresh = entries.dropDuplicates(["id"]).join(seen, "id", "left_anti")
        table.write(fresh.select(*feedback.FEED_FIELDS), batch_id)

    def process_lines(self, predictions: DataFrame, batch_id: int) -> None:
        stored = feedback.route_lines(predictions).withColumn("id", F.col("log_id").cast("string"))
        self._append(feedback.LINE_TYPE, feedback.unify_lines(stored), batch_id)

    def process_sequences(self, predictions: DataFrame, batch_id: int) -> None:
        stored = feedback.route_sequences(predictions).withColumn("id", F.col("chunk_id"))
        self._append(feedback.SEQUENCE_TYPE, feedback.unify_sequences(stored), batch_id)

    def start(self, predictions: DataFrame, kind: str, **trigger):
        process = self.process_lines if kind == feedback.LINE_TYPE else self.process_sequences
        return (
            predictions.writeStream.foreachBatch(process)
            .option("checkpointLocation", f"{self.path}/checkpoint-{kind}")
            .trigger(**trigger)
            .start()
        )


def prediction_stream(spark: SparkSession, table: PartTable) -> DataFrame:
    """Stream over the parts that a prediction table gains."""
    return spark.readStream.schema(table.latest().schema).parquet(f"{table.path}/part=*")
