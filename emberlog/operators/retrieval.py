"""Scoring by retrieval: nearest normal lines, then token-level MaxSim against them."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from emberlog.operators.embeddings import normalized
from emberlog.operators.joins import sized
from emberlog.operators.ordering import first_rows, position
from emberlog.operators.services import attach
from emberlog.session import written

# vectors compared at once in one task: a block of queries against a block of normal points
BLOCK_ROWS = 1024
MAX_CELL_BITS = 16
# more vectors than make so many blocks get larger blocks, up to BLOCK_ROWS
MOST_BLOCKS = 64
# neighbours that a task holds at once, points that it compares at once, pairs measured at once, rows of a batch it returns
BEST_ENTRIES, POINT_ROWS, EXACT_PAIRS, OUT_ROWS = 1 << 22, 2048, 1 << 16, 1 << 16
# distances are ranked after rounding, so equal vectors tie and the id decides
ROUND = 9


@F.pandas_udf(T.LongType())
def _cell(vectors: pd.Series, bits: pd.Series) -> pd.Series:
    """Cell of a vector: the signs of its projections on fixed random directions."""
    if len(vectors) == 0:
        return pd.Series([], dtype="int64")
    n = int(bits.iloc[0])
    matrix = np.stack(vectors.to_numpy())
    directions = np.random.default_rng(17).standard_normal((matrix.shape[1], n))
    return pd.Series((matrix @ directions > 0) @ (1 << np.arange(n, dtype="int64")))


def _block_size(n_vectors: int, block_rows: int) -> int:
    """Rows of a block: ``block_rows``, or more where that would make very many blocks.

    Blocks meet in pairs, so it is their number that must not grow with the input.
    """
    return max(block_rows, min(BLOCK_ROWS, math.ceil(n_vectors / MOST_BLOCKS)))


def _parted(celled: DataFrame, group: str, block_rows: int) -> DataFrame:
    """Add ``block``: rows of one group and ``_cell``, at most about ``block_rows`` of them."""
    sizes = celled.groupBy(group, "_cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_n"))
    part = F.pmod(F.xxhash64("id"), F.col("_n"))
    return celled.join(sizes, [group, "_cell"]).withColumn("block", F.concat_ws("/", "_cell", part)).drop("_n")


def _blocked(vectors: DataFrame, group: str, block_rows: int) -> DataFrame:
    """Add ``block``: near vectors of one group; a small group has fewer cells."""
    bits = min(MAX_CELL_BITS, max(1, math.ceil(math.log2(max(2, vectors.count() / block_rows)))))
    # of its own size a group takes three bits more than full cells would need, as cells are filled unevenly
    cells = F.pow(F.lit(2), F.ceil(F.log2(8 * F.count(F.lit(1)) / block_rows))).cast("long")
    own = vectors.groupBy(group).agg(F.greatest(cells, F.lit(1)).alias("_cells"))
    celled = vectors.join(own, group).withColumn("_cell", F.pmod(_cell("vec", F.lit(bits)), F.col("_cells"))).drop("_cells")
    return _parted(celled, group, block_rows).drop("_cell")


def _block_summary(group: str):
    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack(pdf["vec"].to_numpy())
        center = matrix.mean(axis=0)
        radius = float(np.sqrt(((matrix - center) ** 2).sum(axis=1)).max())
        return pd.DataFrame(
            {
                group: [pdf[group].iloc[0]],
                "block": [pdf["block"].iloc[0]],
                "center": [center],
                "radius": [radius],
                "n": [len(pdf)],
                "k": [int(pdf["k"].max())],
            }
        )

    return summarize


def _candidate_blocks(queries: DataFrame, points: DataFrame, group: str) -> DataFrame:
    """Pairs of blocks that can hold a nearest neighbour.

    Blocks are balls (centre, radius). The k-th neighbour of any query in a ball is no
    farther than the smallest upper bound under which k points lie for certain; a block
    whose lower bound exceeds it cannot contribute and is left out. The result is exact.
    """
    def summaries(df, side):
        kind = df.schema[group].dataType.simpleString()
        schema = f"`{group}` {kind}, block string, center array<double>, radius double, n long, k long"
        made = df.groupBy(group, "block").applyInPandas(_block_summary(group), schema)
        return made.select(group, *[F.col(c).alias(f"{side}_{c}") for c in ("block", "center", "radius", "n", "k")])

    pairs = summaries(queries, "q").join(written(summaries(points, "p"), "blocks"), group)
    apart = F.sqrt(
        F.aggregate(
            F.zip_with("q_center", "p_center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x
        )
    )
    slack = F.col("q_radius") + F.col("p_radius")
    bounded = pairs.select(
        group, "q_block", "p_block", "p_n", "q_k", (apart - slack).alias("low"), (apart + slack).alias("high")
    )
    per_query = Window.partitionBy(group, "q_block")
    sure = F.sum("p_n").over(per_query.orderBy("high", "p_block").rowsBetween(Window.unboundedPreceding, 0))
    reach = F.min(F.when(F.col("_sure") >= F.col("q_k"), F.col("high"))).over(per_query)
    return (
        bounded.withColumn("_sure", sure)
        .withColumn("_reach", reach)
        .filter(F.col("_reach").isNull() | (F.col("low") <= F.col("_reach") + 1e-9))
        .select(group, "q_block", "p_block")
    )


def _rough(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Every query against every point: 1 - cosine, or the squared distance up to rounding errors."""
    if metric == "cosine":
        return 1.0 - q @ p.T
    return np.maximum((q * q).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2.0 * (q @ p.T), 0.0)


def _exact(rough: np.ndarray, q: np.ndarray, p: np.ndarray, rows: np.ndarray, cols: np.ndarray, metric: str, radius) -> np.ndarray:
    """Rounded distances of the pairs (rows, cols); infinite beyond ``radius``."""
    if metric == "cosine":
        return np.round(rough[rows, cols], ROUND)
    squares = np.empty(len(rows))
    for i in range(0, len(rows), EXACT_PAIRS):
        some = slice(i, i + EXACT_PAIRS)
        squares[some] = ((p[cols[some]] - q[rows[some]]) ** 2).sum(axis=1)
    if metric == "euclidean":
        return np.round(np.sqrt(squares), ROUND)
    # unit vectors: half the square is the cosine distance
    return np.where(np.sqrt(squares) < radius, np.round(squares / 2, ROUND), np.inf)


class _Best:
    """The nearest points so far of a block of queries; points come in order of their ids."""

    def __init__(self, ids: list, matrix: np.ndarray, k: np.ndarray, metric: str, radius: float | None):
        self.ids, self.matrix, self.k, self.metric, self.radius = ids, matrix, k, metric, radius
        self.row, self.distance, self.point = np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=object)
        self.worst = np.full(len(ids), np.inf)

    def add(self, ids: np.ndarray, points: np.ndarray) -> None:
        most = int(self.k.max())
        if most < 1:
            return
        rough = _rough(self.matrix, points, self.metric)
        limit = {"cosine": 1, "euclidean": 2}.get(self.metric)
        limit = self.worst**limit if limit else 2 * self.worst
        if most < len(points):
            limit = np.minimum(limit, np.partition(rough, most - 1, axis=1)[:, most - 1])
        # what rounding, of the sums and of the distance, can hide
        largest = (self.matrix**2).sum(axis=1).max() + (points**2).sum(axis=1).max()
        slack = 1e-11 * largest + 4e-9 * np.maximum(1.0, np.sqrt(np.where(np.isfinite(limit), np.maximum(limit, 0), 0)))
        rows, cols = np.nonzero(rough <= (limit + slack)[:, None])
        distance = _exact(rough, self.matrix, points, rows, cols, self.metric, self.radius)
        near = np.isfinite(distance)
        row = np.concatenate([self.row, rows[near]])
        distance = np.concatenate([self.distance, distance[near]])
        point = np.concatenate([self.point, ids[cols[near]]])
        # stable: of equal distances the earlier point, which has the smaller id, stays in front
        order = np.lexsort((distance, row))
        row = row[order]
        starts = np.searchsorted(row, np.arange(len(self.ids)))
        place = np.arange(len(row)) - starts[row]
        kept = place < self.k[row]
        self.row, self.distance, self.point = row[kept], distance[order][kept], point[order][kept]
        last = place[kept] == self.k[self.row] - 1
        self.worst[self.row[last]] = self.distance[last]

    def rows(self, names: list[str], schema: pa.Schema, group) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.row), OUT_ROWS):
            some = slice(i, i + OUT_ROWS)
            row = self.row[some]
            values = [
                [group] * len(row), [self.ids[r] for r in row], self.point[some].tolist(), self.distance[some], self.k[row],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, schema.field(c).type) for c, x in zip(names, values)], names)


def _fold(group: str, metric: str, radius: float | None, schema: pa.Schema):
    """Batches in order of (group, meet, side, id) → the nearest points per query of each meeting."""

    def matrix(vectors: pa.Array) -> np.ndarray:
        return np.asarray(vectors.flatten(), dtype=float).reshape(len(vectors), -1)

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, at, queries, best = schema.names, None, [], None
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in (group, "meet", "side")))
            start = 0
            for (*key, side), run in groupby(keys):
                stop = start + sum(1 for _ in run)
                if key != at:
                    if best:
                        yield from best.rows(names, schema, at[0])
                    at, queries, best = key, [], None
                part = batch.slice(start, stop - start)
                start = stop
                if side == 0:
                    queries.append(part)
                    continue
                if best is None:
                    if not queries:
                        continue
                    ids = [x for q in queries for x in q.column("id").to_pylist()]
                    k = np.concatenate([q.column("k").to_numpy(zero_copy_only=False) for q in queries])
                    best = _Best(ids, np.concatenate([matrix(q.column("vec")) for q in queries]), k, metric, radius)
                ids = np.array(part.column("id").to_pylist(), dtype=object)
                points = matrix(part.column("vec"))
                for i in range(0, len(ids), POINT_ROWS):
                    best.add(ids[i : i + POINT_ROWS], points[i : i + POINT_ROWS])
        if best:
            yield from best.rows(names, schema, at[0])

    return fold


def _met(q: DataFrame, p: DataFrame, group: str, metric: str, radius: float | None = None) -> DataFrame:
    """Queries and points of one ``meet`` → group, q_id, p_id, distance and the query's ``_k``, its nearest ones only.

    The queries of a meeting are held as a matrix and its points stream past it, so no group of
    points is ever in memory and no pair leaves the task but the nearest.
    """
    columns = [group, "meet", "side", "id", "vec", "k"]
    both = q.withColumn("side", F.lit(0)).select(*columns).unionByName(p.withColumn("side", F.lit(1)).select(*columns))
    dealt = both.repartition(group, "meet").sortWithinPartitions(group, "meet", "side", "id")
    out = T.StructType(
        [
            T.StructField(group, both.schema[group].dataType),
            T.StructField("q_id", both.schema["id"].dataType),
            T.StructField("p_id", both.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
            T.StructField("_k", T.LongType()),
        ]
    )
    return dealt.mapInArrow(_fold(group, metric, radius, to_arrow_schema(out)), out)


def nearest_points(
    queries: DataFrame,
    points: DataFrame,
    k: int | str,
    metric: str = "cosine",
    group: str = "service",
    key: str = "hash",
    vector: str = "cls",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest points of each query inside its group: group, q_id, p_id, distance, rank.

    ``k`` is a number or the name of a column of ``queries``. Exact. A block of queries meets
    the points as a matrix and hands on only the ``k`` best per query; blocks of points that
    cannot matter are never compared. ``block_rows`` is the least size of a block.
    """
    direction = normalized(F.col(vector)) if metric == "cosine" else F.transform(vector, lambda x: x.cast("double"))
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    q = queries.select(group, F.col(key).alias("id"), direction.alias("vec"), limit.cast("long").alias("k"))
    p = points.select(group, F.col(key).alias("id"), direction.alias("vec"), F.lit(0).cast("long").alias("k"))

    n_queries, n_points = at_most(q, block_rows), at_most(p, block_rows)
    if n_queries and n_points:
        met = _met(q.withColumn("meet", F.lit("")), p.withColumn("meet", F.lit("")), group, metric)
    elif n_queries:
        # few queries: every block of points meets all of them, in one pass over the points
        n_blocks = math.ceil(p.count() / block_rows)
        n_blocks = math.ceil(n_blocks * block_rows / _block_size(n_blocks * block_rows, block_rows))
        numbers = F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))
        pairs_p = p.withColumn("meet", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("string"))
        met = _met(q.withColumn("meet", F.explode(F.transform(numbers, lambda n: n.cast("string")))), pairs_p, group, metric)
    else:
        q, p = written(q, "queries"), written(p, "points")
        size = q.agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k")).first()
        # a task holds the k nearest points of each query of a block
        rows = min(_block_size(size["n"], block_rows), max(1, BEST_ENTRIES // max(1, size["k"] or 1)))
        q = written(_blocked(q, group, rows), "query-blocks")
        p = written(_blocked(p, group, _block_size(p.count(), block_rows)), "point-blocks")
        pairs = written(_candidate_blocks(q, p, group), "block-pairs").withColumnRenamed("q_block", "meet")
        pairs_p = p.withColumnRenamed("block", "p_block").join(pairs, [group, "p_block"])
        met = _met(q.withColumnRenamed("block", "meet"), pairs_p, group, metric)
    return first_rows(met, F.col("_k"), [F.asc("distance"), F.asc("p_id")], [group, "q_id"]).drop("_k")


def at_most(vectors: DataFrame, rows: int) -> bool:
    return vectors.limit(rows + 1).count() <= rows


def nearest_points_lsh(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    radius: float,
    group: str = "service",
    key: str = "hash",
    vector: str = "cls",
    bucket_length: float = 0.5,
    tables: int = 4,
) -> DataFrame:
    """Approximate cosine neighbours within ``radius`` (Euclidean, on unit vectors) by hashing."""
    def prepared(df):
        return df.select(group, F.col(key).alias("id"), array_to_vector(normalized(F.col(vector))).alias("unit"))

    def buckets(df):
        """One row per table; ``_cell`` is the table and the vector's bucket in it."""
        hashed = model.transform(df).select(group, "id", "unit", F.posexplode("hashes").alias("_table", "_hash"))
        bucket = vector_to_array("_hash")[0].cast("long").cast("string")
        celled = hashed.select(
            group, "id", vector_to_array("unit").alias("vec"), F.lit(k).cast("long").alias("k"),
            F.concat_ws(":", "_table", bucket).alias("_cell"),
        )
        return written(celled, "buckets")

    q, p = prepared(queries), prepared(points)
    model = BucketedRandomProjectionLSH(
        inputCol="unit", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=1
    ).fit(p)
    # points of a bucket stream past its blocks of queries: no pair is written but the k nearest of each table
    q, p = buckets(q), buckets(p)
    q = written(_parted(q, group, min(_block_size(q.count(), 1), max(1, BEST_ENTRIES // k))), "query-buckets")
    meetings = q.select(group, "_cell", F.col("block").alias("meet")).distinct()
    met = _met(q.withColumnRenamed("block", "meet"), p.join(meetings, [group, "_cell"]), group, "unit", radius)
    found = met.drop("_k").dropDuplicates([group, "q_id", "p_id"])
    return first_rows(found, k, [F.asc("distance"), F.asc("p_id")], [group, "q_id"])


@F.pandas_udf(T.DoubleType())
def maxsim_distance(query: pd.Series, normal: pd.Series) -> pd.Series:
    """1 − Σ over query tokens of the best cosine with any normal token."""

    def one(q, t):
        if len(q) == 0 or len(t) == 0:
            return 1.0
        a, b = np.stack(q).astype(float), np.stack(t).astype(float)
        norms = np.outer(np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1)))
        cosines = np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0)
        return 1.0 - cosines.max(axis=1).sum()

    return pd.Series([one(q, t) for q, t in zip(query, normal)], dtype="float64")


def core_set_size(n_unique: int) -> int:
    """Off-line core set: one percent of the unique lines, rounded half to even, at least two."""
    return max(2, round(0.01 * n_unique))


def score_pairs(pairs: DataFrame, queries: DataFrame, points: DataFrame, group: str = "service", key: str = "hash") -> DataFrame:
    """Add the MaxSim ``maxsim`` of each (query, core point) pair.

    Token matrices are joined only here, to the few pairs that the line vectors selected.
    """
    q = queries.select(group, F.col(key).alias("q_id"), F.col("tokens").alias("_q"))
    p = points.select(group, F.col(key).alias("p_id"), F.col("tokens").alias("_p"))
    joined = pairs.join(q, [group, "q_id"]).join(p, [group, "p_id"])
    return joined.select(*pairs.columns, F.size("_q").alias("n_tokens"), maxsim_distance("_q", "_p").alias("maxsim"))


def best_scores(scored: DataFrame, group: str = "service") -> DataFrame:
    """Lowest distance over the core set, and the same per token (free of the line's length)."""
    best = scored.groupBy(group, "q_id").agg(F.min("maxsim").alias("score"), F.max("n_tokens").alias("n_tokens"))
    return best.withColumn("score_per_token", (F.col("score") - 1) / F.nullif("n_tokens", F.lit(0)) + 1)


def score_lines(
    queries: DataFrame,
    points: DataFrame,
    k: int | str = 2,
    metric: str = "cosine",
    drop_first: bool = False,
    group: str = "service",
    key: str = "hash",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Anomaly score of each query line; a group without normal points gets none."""
    core = nearest_points(queries, points, k, metric, group, key, block_rows=block_rows)
    if drop_first:
        core = core.filter(F.col("rank") > 1)
    return best_scores(score_pairs(core, queries, points, group, key), group).withColumnRenamed("q_id", key)


def judge(scores: DataFrame, services: DataFrame) -> DataFrame:
    """``is_anomaly``: the score is above the service's threshold."""
    judged = attach(scores, services, ["threshold"])
    return judged.withColumn("is_anomaly", F.col("score") > F.col("threshold")).drop("threshold")


def upsert_normals(store: DataFrame, added: DataFrame, version: str = "version") -> DataFrame:
    """Store with the added points: the newest row per (service, hash) stays."""
    both = store.unionByName(added)
    fields = [c for c in both.columns if c not in ("service", "hash")]
    return both.groupBy("service", "hash").agg(
        F.max_by(F.struct(*fields), F.col(version)).alias("_r")
    ).select("service", "hash", "_r.*")


def unknown_lines(logs: DataFrame, store: DataFrame) -> DataFrame:
    """Lines whose hash is not yet a normal point of their service."""
    return logs.join(sized(store.select("service", "hash")), ["service", "hash"], "left_anti")


def split_training(logs: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of training services: they seed the store, lines to judge)."""
    marked = attach(logs, services, ["is_train"])
    training = F.coalesce(F.col("is_train"), F.lit(False))
    return marked.filter(training).drop("is_train"), marked.filter(~training).drop("is_train")


def distinct_texts(lines: DataFrame, text: str = "cleaned_text") -> DataFrame:
    return lines.select(text).distinct()


def broadcast_back(lines: DataFrame, scores: DataFrame, on: str = "cleaned_text", how: str = "inner") -> DataFrame:
    """Scores of unique texts → every occurrence."""
    return lines.join(sized(scores), on, how)


def first_occurrences(lines: DataFrame, on: list[str]) -> DataFrame:
    """The earliest line of each group: a minimum per group, then one of the lines that attain it."""
    placed = lines.withColumn("_first", position())
    firsts = written(placed.groupBy(*on).agg(F.min("_first").alias("_first")), "first-lines")
    return placed.join(firsts, [*on, "_first"], "left_semi").dropDuplicates(on).select(*lines.columns)
