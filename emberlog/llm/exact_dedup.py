"""Exact duplicates by skew-safe combining of full texts.

Texts are equal when they are identical after lower-casing A-Z only. Every partition first
combines its own equal texts, the winners meet by (digest, salt), and the winners of the salts
meet by digest. Each of these groupings has the whole text among its keys, so a digest never
decides alone. A group of copies of any size thus reaches a merging task as at most one row
per partition, then one row per salt.

Defined results: a null text counts as empty; a row without an id is a document that never
stays unless all of its group have none (then ``keep_id`` is null and ``kept`` is true); rows that
repeat an id and its text share one decision and each count towards ``group_size``; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import one_row_each, row_keyed, table
from emberlog.llm.registry import query
from emberlog.operators.joins import sized
from emberlog.session import written

SALTS = 16


def _fingerprints(
    docs: DataFrame, id_col: str, text_col: str, digits: int, with_text: bool, row_col: str | None = None
) -> DataFrame:
    """id, SHA-256 of the normalised text, the first ``digits`` of it as grouping digest, text and row key if asked for."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            # bytes.lower() changes the bytes of A-Z and no others
            norm = [t.as_py().lower() for t in texts]
            sha = [hashlib.sha256(t).hexdigest() for t in norm]
            columns = [batch.column(0), pa.array(sha, pa.string()), pa.array([s[:digits] for s in sha], pa.string())]
            names = ["_id", "_sha", "_digest"]
            if with_text:
                columns.append(pa.array(norm, pa.binary()))
                names.append("_norm")
            if row_col:
                columns.append(batch.column(2))
                names.append("_row")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"_id {kinds[id_col]}, _sha string, _digest string" + (", _norm binary" if with_text else "")
    narrow = [F.col(id_col).alias("_id"), F.col(text_col).alias("_text")]
    if row_col:
        schema += f", _row {kinds[row_col]}"
        narrow.append(F.col(row_col).alias("_row"))
    return docs.select(*narrow).mapInArrow(run, schema)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digits: int = 64
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``digits`` shortens the grouping digest. Different texts of one digest are told apart by their
    content; they only cost another pass over the texts of such digests.
    """
    result = _decided(docs, id_col, text_col, salts, digits)
    return result.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def _decided(
    docs: DataFrame, id_col: str, text_col: str, salts: int = SALTS, digits: int = 64, row_col: str | None = None
) -> DataFrame:
    """_id, _sha, _keep and _size of every row, and its key ``row_col`` as _row if that is given."""
    full = _fingerprints(docs, id_col, text_col, digits, with_text=True)
    salted = (
        full.withColumn("_salt", F.spark_partition_id() % salts)
        .groupBy("_digest", "_salt", "_norm")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    )
    winners = salted.groupBy("_digest", "_norm").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))
    groups = written(
        winners.groupBy("_digest").agg(
            F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"), F.count(F.lit(1)).alias("_texts")
        ),
        "exact-groups",
    )
    alone = groups.filter("_texts = 1").drop("_texts")
    result = _fingerprints(docs, id_col, text_col, digits, False, row_col).join(alone, "_digest")
    shared = groups.filter("_texts > 1").select("_digest")
    if shared.limit(1).count():
        full = _fingerprints(docs, id_col, text_col, digits, True, row_col)
        clashing = full.join(sized(shared), "_digest", "left_semi")
        by_text = clashing.groupBy("_digest", "_norm").agg(
            F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")
        )
        result = result.unionByName(clashing.join(by_text, ["_digest", "_norm"]).drop("_norm"))
    return result


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text of ``docs``: one with the largest id, whatever ids are null or repeat; columns stay."""
    keyed, key = row_keyed(docs)
    decided = _decided(keyed, id_col, text_col, row_col=key)
    kept = F.col("_id").eqNullSafe(F.col("_keep")).alias("kept")
    return one_row_each(keyed, key, decided.select("_row", F.unhex("_sha").alias("_group"), kept))


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


@query("op6_exact_dedup", SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))
