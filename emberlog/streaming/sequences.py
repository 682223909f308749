"""The sequence path on a stream: train tags, log keys, count windows, chunks, verdicts.

Every micro-batch runs the batch operators, so a hot node or service is spread over tasks
here as well. What must outlive a micro-batch is small and kept in part tables: rows of
windows that are not full, counters, and the template dictionary. A micro-batch reads parts
below its own number and writes its own, so running it again gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.sequences import ONLINE_CONTEXT
from emberlog.operators import nextkey
from emberlog.operators.joins import sized
from emberlog.operators.lines import clean, extract_traces, window_key
from emberlog.operators.ordering import ROWS_PER_RANGE, number_rows
from emberlog.operators.services import attach
from emberlog.operators.template_tree import TREE, tree_keyed
from emberlog.operators.templates import assign_keys, masked_templates, template_keys
from emberlog.operators.windows import (
    ORDER,
    WINDOW_FIELDS,
    chunk_windows,
    gather_windows,
    tag_train_strategy,
    window_keys,
)
from emberlog.session import scratch, written
from emberlog.sources.tables import PartTable, Pins

LoadServices = Callable[[], DataFrame]


class TrainTags:
    """Running train-strategy tags: the counter of each service goes on over micro-batches."""

    def __init__(self, spark: SparkSession, path: str, rows_per_range: int = ROWS_PER_RANGE):
        self.counters = PartTable(spark, f"{path}/train-counters", "service string, seen long")
        self.rows_per_range = rows_per_range

    def process(self, logs: DataFrame, batch_id: int, services: DataFrame) -> DataFrame:
        before = self.counters.latest(batch_id)
        # only logs that arrive while their service trains are counted
        training = attach(logs.select("service"), services, ["is_train"]).filter("is_train")
        grown = training.groupBy("service").agg(F.count(F.lit(1)).alias("seen"))
        totals = before.unionByName(grown).groupBy("service").agg(F.sum("seen").alias("seen"))
        self.counters.write(totals, batch_id)
        return tag_train_strategy(logs, services, self.rows_per_range, before)


class CountWindows:
    """Tumbling count windows over micro-batches.

    A counter per key gives every row its absolute position, hence its window; a window is
    complete once the counter has passed it. Rows of open windows wait in a table that a
    micro-batch only appends to; every ``compact_every`` micro-batches the rows that still
    wait, and the counters of all keys, are written anew. Rows of a micro-batch are ordered by time; across micro-batches
    arrival decides, and late rows are never dropped.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        size: int = ONLINE_CONTEXT,
        scope: str = "service",
        rows_per_range: int = ROWS_PER_RANGE,
        compact_every: int = 16,
    ):
        self.path, self.spark, self.size = path, spark, size
        self.keys = window_keys(scope)
        self.rows_per_range, self.compact_every = rows_per_range, compact_every

    def process(self, logs: DataFrame, batch_id: int) -> DataFrame:
        """Windows that this micro-batch completes."""
        keys, size = self.keys, self.size
        fields = [c for c in WINDOW_FIELDS if c in logs.columns and c not in keys]
        incoming = logs.select(*keys, *fields)
        placed_schema = incoming.withColumns(
            {"_pos": F.lit(0).cast("long"), "window_no": F.lit(0).cast("long")}
        ).schema
        counted = incoming.select(*keys, F.lit(0).cast("long").alias("seen")).schema
        counters = PartTable(self.spark, f"{self.path}/window-counters", counted)
        summed = PartTable(self.spark, f"{self.path}/window-counters-compacted", counted)
        waiting = PartTable(self.spark, f"{self.path}/open-rows", placed_schema)
        compacted = PartTable(self.spark, f"{self.path}/open-rows-compacted", placed_schema)

        def seen_before(upto: int) -> DataFrame:
            """Counts of earlier micro-batches: the last sums, and what each batch since then has added."""
            base = (summed.parts(batch_id) or [-1])[-1]
            return summed.latest(batch_id).unionByName(counters.all(upto, base))

        # a micro-batch writes the counts of its own keys only
        counters.write(incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen")), batch_id)
        grown = counters.latest(batch_id + 1)
        own = seen_before(batch_id).join(sized(grown.select(*keys)), keys, "left_semi")
        before = written(own.groupBy(*keys).agg(F.sum("seen").alias("seen")), "seen-before")
        totals = before.unionByName(grown).groupBy(*keys).agg(F.sum("seen").alias("_total"))

        numbered = number_rows(incoming, ORDER, keys, "_no", self.rows_per_range)
        position = F.col("_no") - 1 + F.coalesce("seen", F.lit(0).cast("long"))
        is_open = (F.col("window_no") + 1) * size > F.col("_total")
        placed = written(
            numbered.join(before, keys, "left")
            .withColumn("_pos", position)
            .withColumn("window_no", F.floor(F.col("_pos") / size).cast("long"))
            .join(totals, keys)
            .withColumn("_open", is_open)
            .select(*placed_schema.names, "_open"),
            "placed",
        )
        base = (compacted.parts(batch_id) or [-1])[-1]
        held = compacted.latest(batch_id).unionByName(waiting.all(batch_id, base))
        done = placed.filter("NOT _open").drop("_open")
        finished = done.select(*keys, "window_no").distinct()
        rows = done.unionByName(held.join(sized(finished), [*keys, "window_no"], "left_semi").select(*placed_schema.names))

        still_open = placed.filter("_open").drop("_open")
        waiting.write(still_open, batch_id)
        if batch_id % self.compact_every == self.compact_every - 1:
            everyone = seen_before(batch_id + 1).groupBy(*keys).agg(F.sum("seen").alias("seen"))
            summed.write(everyone, batch_id)
            ended = summed.latest(batch_id + 1).withColumnRenamed("seen", "_total")
            kept = held.join(ended, keys).filter(is_open).select(*placed_schema.names)
            compacted.write(kept.unionByName(still_open), batch_id)
        return gather_windows(rows, keys, size)


class SequenceStream:
    """Raw logs → chunk messages, and predictions once a model exists.

    Log keys come from a tree of mined templates that grows with the stream or, without ``mine``, from masked ones.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        load_services: LoadServices,
        context: int = ONLINE_CONTEXT,
        window: int | None = None,
        order: int = nextkey.ORDER,
        rows_per_range: int = ROWS_PER_RANGE,
        mine: bool = True,
    ):
        self.spark, self.path, self.load_services = spark, path.rstrip("/"), load_services
        self.context, self.order, self.mine = context, order, mine
        self.tags = TrainTags(spark, self.path, rows_per_range)
        self.windows = CountWindows(spark, self.path, window or context, rows_per_range=rows_per_range)
        self.tree = PartTable(spark, f"{self.path}/template-tree", TREE)
        self.dictionary = PartTable(
            spark, f"{self.path}/templates", "service string, template string, key_id long, size long"
        )
        self.models = PartTable(spark, f"{self.path}/models")
        self.pins = Pins(spark, f"{self.path}/model-pins")
        self.chunks = PartTable(spark, f"{self.path}/chunks")
        self.predictions = PartTable(spark, f"{self.path}/predictions")

    def process(self, logs: DataFrame, batch_id: int) -> None:
        """One micro-batch; the body of ``foreachBatch``."""
        with scratch(self.spark):
            self._process(logs, batch_id)

    def _process(self, logs: DataFrame, batch_id: int) -> None:
        services = self.load_services()
        if self.mine:
            keyed, tree = tree_keyed(written(clean(logs, services), "cleaned"), self.tree.latest(batch_id))
            self.tree.write(tree, batch_id)
        else:
            templated = written(masked_templates(clean(logs, services)), "templated")
            self.dictionary.write(template_keys(templated, self.dictionary.latest(batch_id)), batch_id)
            keyed = assign_keys(templated, self.dictionary.latest(batch_id + 1))
        tagged = window_key(extract_traces(self.tags.process(keyed, batch_id, services), services))
        self.chunks.write(chunk_windows(self.windows.process(tagged, batch_id), self.context), batch_id)

        new = self.chunks.latest(batch_id + 1).withColumn("input_ids", F.col("chunk.input_ids"))
        # the model that was newest when the micro-batch first ran, also if it runs again
        version = self.pins.pinned(batch_id, self.models)
        if version is not None:
            top_k = services.select(F.col("name").alias("service"), "top_k")
            verdicts = nextkey.detect(new, self.models.latest(version + 1), top_k, self.order)
        else:
            verdicts = new.select("chunk_id", F.lit(False).alias("is_anomaly"))
        self.predictions.write(nextkey.sequence_predictions(new, verdicts, services), batch_id)

    def retrain(self, stored: DataFrame) -> int:
        """The nightly job: pre-train on all stored chunks, fine-tune on the marked ones, publish a version."""
        chunks = stored.withColumn("input_ids", F.col("chunk.input_ids"))
        model = nextkey.train(nextkey.training_sets(chunks, "pre-train"), self.order)
        return self.models.write(nextkey.update(model, nextkey.training_sets(chunks, "finetune"), self.order))

    def extend_model(self, new: DataFrame) -> int:
        """Publish a version with the counts of chunks added that no version has seen yet."""
        chunks = new.withColumn("input_ids", F.col("chunk.input_ids"))
        usable = chunks.filter("train_strategy IN ('pre-train', 'finetune')")
        return self.models.write(nextkey.update(self.models.latest(), usable, self.order))

    def start(self, logs: DataFrame, **trigger):
        """Run on a stream of logs, resuming from the checkpoint under ``path``."""
        return (
            logs.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(**trigger)
            .start()
        )
