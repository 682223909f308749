"""Labelled rows of a classifier: which rows it may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.joins import sized
from emberlog.session import written

FOLDS = 5


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    """True for the rows that are kept for evaluation: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """_id, _text, _label (0 or 1) of the labelled rows that aren't held out.

    Rows without an id or with another label are left out; of several labels of an id the largest counts.
    """
    given = (
        labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_label_id"))
        .agg(F.max(label_col).cast("int").alias("_label"))
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.join(sized(given), F.col("_id") == F.col("_label_id")).drop("_label_id")


def sample_rows(rows: DataFrame, per_label: int) -> DataFrame:
    """At most ``per_label`` rows of each label, the same ones whenever ids and texts are the same.

    Rows that repeat id and text count once, and rows that only share an id count each, so the
    bound holds however often an id occurs.
    """
    known = rows.withColumn("_text_key", F.xxhash64("_text"))
    narrow = known.select("_id", "_label", "_text_key", F.xxhash64("_id").alias("_order"))
    # every task gives up its copies before its rows are sorted
    narrow = narrow.groupBy("_id", "_label", "_text_key").agg(F.first("_order").alias("_order"))
    chosen = [
        narrow.filter(F.col("_label") == label).orderBy("_order", "_id", "_text_key").limit(per_label).select("_id", "_text_key")
        for label in (0, 1)
    ]
    keys = written(chosen[0].unionByName(chosen[1]).distinct(), "sample-ids")
    found = known.join(F.broadcast(keys), ["_id", "_text_key"], "left_semi")
    return found.dropDuplicates(["_id", "_text_key"]).drop("_text_key")
