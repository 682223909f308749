"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are dealt to blocks of bounded size by a hash. In a block every dimension has a list of
the candidates sorted by value. A query reads its lists from the favourable end, all to the same
depth; every candidate it meets is scored in full, and the values at the current depth bound all
candidates not yet met. It stops when that bound cannot beat its k-th best score. A task takes the
blocks of one set of queries one after the other and carries the k-th best scores over, so later
blocks may stop at depth 0. The k best of every block meet in one ranking per query.

Components are floor(scale * x); scores are exact integers as long as they stay below 2^63.

Defined results: rows without an id, with a null vector, or with a null or non-finite component
take no part; only vectors of the same length are compared; ties go to the smaller id; a candidate
with the query's id counts as the query's own row; of repeated query ids the smallest vector asks,
while repeated candidate rows are candidates each; a query with fewer than k candidates gets all;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import table
from emberlog.llm.registry import query
from emberlog.operators.ordering import first_rows
from emberlog.session import written

BLOCK_ROWS = 2048
QUERY_ROWS = 512
FIRST_DEPTH = 4


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """_id and _vec (array of long) of the rows that take part."""
    vec = F.col(vec_col)
    finite = F.forall(
        vec,
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
    )
    return vectors.filter(F.col(id_col).isNotNull() & vec.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("_id"),
        F.transform(vec, lambda x: F.floor(x.cast("double") * float(scale)).cast("long")).alias("_vec"),
    )


def _packed(rows: DataFrame, block_rows: int, names: tuple[str, str, str]) -> DataFrame:
    """Rows as blocks of about ``block_rows``: length of the vectors, number, ids and vectors as bytes."""
    block, ids, data = names
    n_blocks = max(1, -(-rows.count() // block_rows))

    def pack(part: pa.Table) -> pa.Table:
        vectors = part["_vec"].combine_chunks()
        return pa.table(
            {
                "_dim": part["_dim"][:1],
                block: part["_block"][:1],
                ids: pa.array([part["_id"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
                data: pa.array([vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()),
            }
        )

    keyed = rows.select(
        F.size("_vec").alias("_dim"), F.pmod(F.xxhash64("_id", "_vec"), F.lit(n_blocks)).alias("_block"), "_id", "_vec"
    )
    return keyed.groupBy("_dim", "_block").applyInArrow(
        pack, f"_dim int, {block} long, {ids} binary, {data} binary"
    )


class _Block:
    """Candidates of one block with their sorted lists."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        self.ids, self.data = ids, data
        self.largest = max(int(data.max(initial=0)), -int(data.min(initial=0)))
        self.values = data.astype(np.float64)
        self.order = np.argsort(data, axis=0, kind="stable")
        self.sorted = np.take_along_axis(data, self.order, axis=0)

    def best(self, own: int, q: np.ndarray, k: int, bound: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of candidates that may be among the k best; ``bound``: a k-th best score known so far."""
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        # sums of whole numbers below 2^53 are exact as floats, which multiply faster
        most = self.largest * max(int(q.max(initial=0)), -int(q.min(initial=0))) * len(q)
        values, weights = (self.values, q.astype(np.float64)) if most < 2**53 else (self.data, q)
        met = np.zeros(n, dtype=bool)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, following = 0, FIRST_DEPTH
        while depth < n:
            # no candidate that hasn't been met has a value better than those at this depth
            limit = int(self.sorted[n - 1 - depth, up] @ q[up]) + int(self.sorted[depth, down] @ q[down])
            if bound is not None and limit < bound:
                break
            end = min(n, following)
            new = np.zeros(n, dtype=bool)
            if len(up) + len(down):
                new[self.order[n - end : n - depth, up]] = True
                new[self.order[depth:end, down]] = True
            else:
                new[:] = True
                end = n
            new &= ~met
            met |= new
            at = np.flatnonzero(new)
            found = (values[at] @ weights).astype(np.int64)
            other = self.ids[at] != own
            ids, scores = np.concatenate([ids, self.ids[at][other]]), np.concatenate([scores, found[other]])
            first = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[first], scores[first]
            if len(scores) == k and (bound is None or scores[-1] > bound):
                bound = int(scores[-1])
            depth, following = end, following * 2
        return ids, scores


def _unpack(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, dtype=np.int64)
    return numbers, np.frombuffer(data, dtype=np.int64).reshape(len(numbers), -1)


def top_k(
    vectors: DataFrame,
    asks: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 256,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, the candidate's id, score: the k best of all other rows for every row where ``asks`` holds."""
    candidates = whole_vectors(vectors, id_col, vec_col, scale)
    queries = (
        whole_vectors(vectors.filter(asks), id_col, vec_col, scale).groupBy("_id").agg(F.min("_vec").alias("_vec"))
    )
    blocks = written(_packed(candidates, block_rows, ("_block", "_ids", "_data")), "topk-blocks")
    sets = _packed(queries, query_rows, ("_set", "_asking", "_wanted"))
    # every set of queries meets every block of vectors of its length, one joined row each
    numbers = blocks.groupBy("_dim").agg(F.collect_list("_block").alias("_blocks"))
    meetings = sets.join(numbers, "_dim").withColumn("_block", F.explode("_blocks")).drop("_blocks")
    spread = meetings.join(blocks, ["_dim", "_block"]).repartition("_dim", "_set", F.col("_block") % 16)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds: dict[int, list[int]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                asking, wanted, ids, data = (batch.column(i)[row].as_py() for i in range(4))
                block = _Block(*_unpack(ids, data))
                out: list[tuple] = []
                for own, q in zip(*_unpack(asking, wanted)):
                    own = int(own)
                    known = bounds.get(own, [])
                    bound = known[k - 1] if len(known) >= k else None
                    found, scores = block.best(own, q, k, bound)
                    bounds[own] = sorted([*known, *scores.tolist()], reverse=True)[:k]
                    out.extend((own, i, s) for i, s in zip(found.tolist(), scores.tolist()))
                columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "_id", "score"])

    found = spread.sortWithinPartitions("_dim", "_set", "_block").select("_asking", "_wanted", "_ids", "_data")
    best = found.mapInArrow(run, "query_id long, _id long, score long")
    ranked = first_rows(best, k, [F.desc("score"), F.asc("_id")], ["query_id"])
    return ranked.select("query_id", F.col("rank").cast("int"), F.col("_id").alias(id_col), "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.vec) = len(c.vec)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op5_topk_search", SQL)
def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
