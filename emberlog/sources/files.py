"""Line files, label tables, cached results and tailed log files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from emberlog.operators.joins import sized
from emberlog.operators.ordering import running_totals
from emberlog.session import written
from emberlog.sources.tail import tail_lines


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core on an input with fewer splits, or fewer files, than cores.

    A file that is cut into many splits may still be one row group, whose rows are all read by one task.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    few_files = 0 < len(df.inputFiles()) < cores
    return df.repartition(max(cores, splits), *keys) if splits < cores or few_files else df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file and an id: 0 on, by file path and then by place in the file.

    Spark deals files and parts of files to tasks by size. Lines are numbered inside each part
    of a file as they are read; only the counts of the parts are put in order.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_read"),
    )
    parts = written(
        lines.groupBy("file", "_start").agg(F.min("_read").alias("_first"), F.count(F.lit(1)).alias("_lines")), "file-parts"
    )
    offsets = running_totals(parts, {"_upto": F.col("_lines")}, ["file", "_start"])
    offsets = offsets.select("file", "_start", "_first", (F.col("_upto") - F.col("_lines")).alias("_before"))
    placed = lines.join(sized(offsets, of=parts), ["file", "_start"])
    return placed.select("line", "file", (F.col("_before") + F.col("_read") - F.col("_first")).alias("line_id"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label CSV with a header (BlockId, Label) → 0/1."""
    labels = spark.read.csv(path, header=True, schema="BlockId string, Label string")
    return labels.select("BlockId", (F.col("Label") == "Anomaly").cast("long").alias("is_anomaly"))


def read_cached_csv(spark: SparkSession, path: str) -> DataFrame:
    """Import a gzip CSV of sequences whose ``line`` column is the text of an id list."""
    cached = spark.read.csv(path, header=True)
    return cached.withColumn("line", F.from_json("line", "array<int>"))


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; it is built and written first if it is not there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.parquet(path)
        return spark.read.parquet(path)


def tail_files(spark: SparkSession, path: str, labels: DataFrame, **options) -> DataFrame:
    """Stream of the lines of log files below ``path`` as they grow, labelled by file name.

    ``labels`` has one row per file: filename (relative to ``path``), service, node. A line's ``ts`` is
    when its micro-batch began; (ts, log_id) is the order of a file, and equal lines have ids of their own.
    """
    lines = tail_lines(spark, path, **options).select(
        F.col("value").alias("original_text"), "filename", F.current_timestamp().alias("ts"), "log_id"
    )
    return lines.join(labels.select("filename", "service", "node"), "filename")
