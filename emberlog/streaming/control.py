"""Log messages and control messages in one stream.

Three kinds of control messages reach the detectors while they run: a changed service configuration, a line
that a user marked normal, and a new model version. They share one topic. Logs and controls are one
streaming query, so a micro-batch has both, and its checkpoint decides which controls it has seen: the
controls of a micro-batch take effect before its logs are judged, and a repeated micro-batch finds the
same configuration, normal lines and model again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.operators import services as ops
from emberlog.schemas import SERVICE
from emberlog.session import scratch
from emberlog.sources.loki import JSON_OPTIONS, decode_logs, valid_logs
from emberlog.sources.tables import PartTable

CONFIG_CHANGE, MARK_NORMAL, MODEL_UPDATE = "config-change", "mark-normal", "model-update"
MARKED = "service string, hash string, cleaned_text string"

CONTROL = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("config", T.StructType([f for f in SERVICE.fields if f.name not in ("id", "name")])),
        T.StructField("cleaned_text", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("version", T.IntegerType()),
    ]
)


def merged(logs: DataFrame, controls: DataFrame) -> DataFrame:
    """One stream of two topics: is_control, value, position."""
    side = lambda df, flag: df.select(F.lit(flag).alias("is_control"), "value", "position")
    return side(logs, False).unionByName(side(controls, True))


def decode_controls(messages: DataFrame) -> DataFrame:
    """Control messages → their fields and ``position``; what isn't one, or lacks what its kind needs, is left out."""
    parsed = messages.select("position", F.from_json("value", CONTROL, JSON_OPTIONS).alias("c")).select("position", "c.*")
    needed = {
        CONFIG_CHANGE: F.col("service").isNotNull() & F.col("config").isNotNull(),
        MARK_NORMAL: F.col("service").isNotNull() & F.col("hash").isNotNull(),
        MODEL_UPDATE: F.col("version").isNotNull(),
    }
    known = F.lit(False)
    for kind, complete in needed.items():
        known = known | ((F.col("kind") == kind) & complete)
    return parsed.filter(known)


def last_patches(controls: DataFrame) -> DataFrame:
    """name and config fields: of several changes of a field the one with the largest position."""
    changes = controls.filter(F.col("kind") == CONFIG_CHANGE).select("position", F.col("service").alias("name"), "config.*")
    fields = [c for c in changes.columns if c not in ("position", "name")]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("position"))).alias(c) for c in fields]
    return changes.groupBy("name").agg(*last)


@dataclass
class ControlState:
    """What holds for the logs of a micro-batch."""

    services: DataFrame
    marked: DataFrame
    model_version: int | None


class ControlStream:
    """Routes the controls of each micro-batch to versioned tables, then hands its logs and the state to ``judge``.

    ``judge(logs, state, batch_id)`` is the work on the logs; the tables that it writes must be part tables too.
    """

    def __init__(
        self, spark: SparkSession, path: str, services: DataFrame, judge: Callable[[DataFrame, ControlState, int], None]
    ):
        self.spark, self.path, self.judge = spark, path.rstrip("/"), judge
        self.first = services
        self.configs = PartTable(spark, f"{self.path}/configs", services.schema)
        self.marks = PartTable(spark, f"{self.path}/marks", MARKED)
        self.versions = PartTable(spark, f"{self.path}/model-versions", "version int")

    def state(self, batch_id: int) -> ControlState:
        """As micro-batch ``batch_id`` has it once its own controls are applied."""
        upto = batch_id + 1
        services = self.configs.latest(upto) if self.configs.parts(upto) else self.first
        version = self.versions.latest(upto).first() if self.versions.parts(upto) else None
        return ControlState(services, self.marks.all(upto).distinct(), version["version"] if version else None)

    def process(self, messages: DataFrame, batch_id: int) -> None:
        """One micro-batch; the body of ``foreachBatch``."""
        with scratch(self.spark):
            controls = decode_controls(messages.filter("is_control")).persist()
            try:
                self._apply(controls, batch_id)
            finally:
                controls.unpersist()
            logs = valid_logs(decode_logs(messages.filter("NOT is_control").select("value", "position")))
            self.judge(logs, self.state(batch_id), batch_id)

    def _apply(self, controls: DataFrame, batch_id: int) -> None:
        kinds = {r["kind"] for r in controls.select("kind").distinct().collect()}  # three at most
        if CONFIG_CHANGE in kinds:
            before = self.state(batch_id - 1).services
            patches = last_patches(controls).join(before.select("name", "id"), "name").drop("name")
            self.configs.write(ops.patch(before, patches), batch_id)
        if MARK_NORMAL in kinds:
            marks = controls.filter(F.col("kind") == MARK_NORMAL).select("service", "hash", "cleaned_text").distinct()
            self.marks.write(marks, batch_id)
        if MODEL_UPDATE in kinds:
            newest = controls.filter(F.col("kind") == MODEL_UPDATE).agg(F.max_by("version", "position").alias("version"))
            self.versions.write(newest, batch_id)

    def start(self, logs: DataFrame, controls: DataFrame, **trigger):
        """Run on topics of log and control messages (value, position), resuming from the checkpoint under ``path``."""
        return (
            merged(logs, controls)
            .writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(**trigger)
            .start()
        )
