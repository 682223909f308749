"""Session defaults and the shared folder every executor can reach."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # token matrices make wide rows: bound an Arrow batch by bytes as well as by rows
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def build_session(app_name: str = "emberlog", master: str | None = None, **conf: str) -> SparkSession:
    """SparkSession with the library's defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a fresh temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="emberlog-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables that ``written`` makes inside, once all that reads them has run.

    For jobs that end with a stored result, such as a micro-batch; a returned lazy result may still
    need its tables.
    """
    outer = getattr(_scopes, "paths", None)
    _scopes.paths = []
    try:
        yield
    finally:
        made, _scopes.paths = _scopes.paths, outer
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of a result that several later stages read, survives the loss of
    executors, and gives the optimizer real file sizes to plan joins with.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, label)
    if getattr(_scopes, "paths", None) is not None:
        _scopes.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
