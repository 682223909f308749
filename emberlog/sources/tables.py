"""Tables of numbered parts, written by batch jobs and micro-batches.

Part ``n`` is the folder ``part=n``; it counts once its ``_SUCCESS`` marker is there. A
repeated micro-batch rewrites its own part and reads only smaller ones, so a retry after a
lost executor or driver changes nothing. No path is ever rewritten while it is being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class PartTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def parts(self, before: int | None = None) -> list[int]:
        """Numbers of the finished parts, ascending."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        numbers = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("part=") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                numbers.append(int(name.split("=")[1]))
        return sorted(n for n in numbers if before is None or n < before)

    def _read(self, numbers: list[int]) -> DataFrame:
        if not numbers:
            if self.schema is None:
                raise FileNotFoundError(f"no finished part in {self.path}")
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.path}/part={n}" for n in numbers])

    def claim(self) -> int:
        """A number after all others that no other writer has or gets: its claim file is made exclusively."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_claims")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(root)
        taken = [int(status.getPath().getName()) for status in fs.listStatus(root)]
        number = max([*self.parts(), *taken, -1]) + 1
        while not fs.createNewFile(jvm.org.apache.hadoop.fs.Path(root, str(number))):
            number += 1
        return number

    def write(self, df: DataFrame, number: int | None = None) -> int:
        """Write one part; without a number it becomes the next one, which concurrent writers don't share."""
        if number is None:
            number = self.claim()
        df.write.mode("overwrite").parquet(f"{self.path}/part={number}")
        return number

    def latest(self, before: int | None = None) -> DataFrame:
        """The newest part: each part is a full version."""
        return self._read(self.parts(before)[-1:])

    def all(self, before: int | None = None, after: int = -1) -> DataFrame:
        """Parts together: each part is an increment."""
        return self._read([n for n in self.parts(before) if n > after])

    def expire(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` parts; only for tables of full versions."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for number in self.parts()[:-keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"part={number}"), True)


class Pins:
    """Which version of a table each micro-batch reads, noted when it first runs."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = PartTable(spark, path, "version int")

    def pinned(self, batch_id: int, versions: PartTable) -> int | None:
        if batch_id not in self.table.parts():
            newest = (versions.parts() or [None])[-1]
            self.table.write(self.table.spark.createDataFrame([(newest,)], "version int"), batch_id)
        return self.table._read([batch_id]).first()["version"]
