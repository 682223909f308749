"""Mixing sources to target weights by entropy balancing.

Each source is to give a target number of words. Among all document rates that meet these
constraints, the ones nearest to 1 in relative entropy are exponentially tilted by the document's
size: rate = exp(lambda_source * size / mean size), held below the largest allowed repeat. The
lambdas solve the convex dual. Every Newton step is one aggregation over all (source, size)
cells; a constraint touches only its own source's documents, so the Hessian is diagonal and one
step moves all sources at once. A step that leaves the bracket of the root is replaced by a
bisection.

Rates become whole copies by passing the rounding error on: hashed buckets of about a thousand
documents go from the largest size to the smallest, and each document gets the whole number within
one of its rate's floor and ceiling that keeps the bucket nearest to its words. A source of any
size is many buckets, and reruns give the same copies.

Defined results: a null text has no words; documents without words get whole copies and take no
words; a null source is a source, last in order; a source without words has target 0; null and
repeated ids are rounded like others, row by row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import row_keyed, table, unused
from emberlog.llm.registry import query
from emberlog.operators.joins import is_small, sized
from emberlog.operators.ordering import number_rows
from emberlog.session import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
BUCKET_DOCS = 1024
TOLERANCE = 1e-9
MAX_STEPS = 200


def word_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """Per source: number of documents, source_size, and the words it is to give.

    Weights go round the sources in code point order. No target passes ``max_repeat`` times its
    source; what is cut off goes to the other sources by weight, until none is above.
    """
    sources = written(
        sizes.groupBy("_source").agg(F.sum("_size").alias("_words"), F.count_if(F.col("_size") > 0).alias("_docs")),
        "mix-sources",
    )
    named = sources.withColumns(
        {"_last": F.col("_source").isNull().cast("int"), "_name": F.coalesce("_source", F.lit(""))}
    )
    numbered = number_rows(named, ["_last", "_name"], name="_no")
    around = F.array(*[F.lit(float(w)) for w in weights])
    weighted = numbered.select(
        "_source",
        "_words",
        "_docs",
        F.element_at(around, ((F.col("_no") - 1) % len(weights) + 1).cast("int")).alias("_weight"),
        (F.col("_words") * float(max_repeat)).alias("_most"),
    )
    weighted = written(weighted, "mix-weights")
    words, weight = weighted.agg(F.sum("_words"), F.sum("_weight")).first()
    wanted = share * (words or 0)
    level, full = wanted / weight if weight else 0.0, -1
    while True:
        above = F.col("_weight") * level >= F.col("_most")
        count, used, free = weighted.agg(
            F.count_if(above), F.sum(F.when(above, F.col("_most"))), F.sum(F.when(~above, F.col("_weight")))
        ).first()
        if count == full or not free:
            break
        level, full = max(level, (wanted - (used or 0.0)) / free), count
    return weighted.select("_source", "_words", "_docs", F.least("_most", F.col("_weight") * level).alias("_target"))


def tilts(sizes: DataFrame, targets: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The targets with ``_lambda`` per source, infinite where every document is repeated most often."""
    mean = F.col("_words") / F.col("_docs")
    cells = written(
        sizes.filter("_size > 0")
        .groupBy("_source", "_size")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumnRenamed("_source", "_of"),
        "mix-cells",
    )
    full = F.col("_target") >= max_repeat * F.col("_words") * (1 - TOLERANCE)
    state = written(
        targets.select(
            "*",
            F.when(full, float("inf")).otherwise(0.0).alias("_lambda"),
            F.lit(float("-inf")).alias("_low"),
            F.lit(float("inf")).alias("_high"),
            (full | (F.col("_words") == 0)).alias("_done"),
        ),
        "mix-tilts",
    )
    small = is_small(targets)
    for _ in range(MAX_STEPS):
        moving = state.filter("not _done")
        if not moving.limit(1).count():
            break
        x = F.col("_size") / mean
        tilted = F.exp(F.least(F.col("_lambda") * x, F.lit(math.log(max_repeat))))
        below = F.col("_lambda") * x < math.log(max_repeat)
        words = F.col("_n") * F.col("_size") * tilted
        sums = (
            cells.join(F.broadcast(moving) if small else moving, F.col("_of").eqNullSafe(F.col("_source")))
            .groupBy("_of")
            .agg(F.sum(words).alias("_given"), F.sum(F.when(below, words * x)).alias("_slope"))
        )
        gap = F.log(F.col("_given") / F.col("_target"))
        met = F.abs(F.col("_given") / F.col("_target") - 1) < TOLERANCE
        newton = F.col("_lambda") - gap * F.col("_given") / F.col("_slope")
        low = F.when(gap < 0, F.col("_lambda")).otherwise(F.col("_low"))
        high = F.when(gap > 0, F.col("_lambda")).otherwise(F.col("_high"))
        inside = (newton > F.col("_low_now")) & (newton < F.col("_high_now"))
        halved = (
            F.when(F.col("_high_now") == float("inf"), F.col("_low_now") * 2 + 1)
            .when(F.col("_low_now") == float("-inf"), F.col("_high_now") * 2 - 1)
            .otherwise((F.col("_low_now") + F.col("_high_now")) / 2)
        )
        stuck = F.col("_high_now") - F.col("_low_now") <= 1e-15 * F.abs(F.col("_lambda"))
        stepped = (
            moving.join(sums, F.col("_of").eqNullSafe(F.col("_source")))
            .withColumns({"_low_now": low, "_high_now": high})
            .select(
                "_source", "_words", "_docs", "_target",
                F.when(met, F.col("_lambda")).when(inside, newton).otherwise(halved).alias("_lambda"),
                F.col("_low_now").alias("_low"),
                F.col("_high_now").alias("_high"),
                (met | F.coalesce(stuck, F.lit(False))).alias("_done"),
            )
        )
        state = written(state.filter("_done").unionByName(stepped), "mix-tilts")
    return state.drop("_low", "_high", "_done")


def _round(bucket: pa.Table, max_repeat: int) -> pa.Table:
    """Copies of one bucket's documents, the rounding error passed on from large to small ones."""
    size = bucket["_size"].to_numpy()
    rate = bucket["_rate"].to_numpy()
    key = bucket["_key"].to_numpy()
    copies = np.zeros(len(size), dtype=np.int64)
    owed = 0.0
    for i in np.lexsort((key, -size)):
        if size[i] == 0:
            copies[i] = round(rate[i])
            continue
        owed += rate[i] * size[i]
        low, high = max(math.floor(rate[i]) - 1, 0), min(math.ceil(rate[i]) + 1, max_repeat)
        copies[i] = min(max(round(owed / size[i]), low), high)
        owed -= copies[i] * size[i]
    return bucket.drop_columns(["_key"]).append_column("_copies", pa.array(copies))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.0,
    max_repeat: int = MAX_REPEAT,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, rate, copies, taken.

    ``share`` is the part of all words that the mix is to hold.
    """
    rounded = _rounded(docs, weights, share, max_repeat, id_col, text_col, source_col)
    return rounded.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_words").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_rate").alias("rate"),
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def _rounded(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.0,
    max_repeat: int = MAX_REPEAT,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """_id, _size, _words, _target, _rate and _copies of every row, and its key ``row_col`` as _row if that is given."""
    kinds = dict(docs.dtypes)
    row = [F.col(row_col).alias("_row")] if row_col else []
    sizes = written(
        docs.select(
            *row,
            F.col(id_col).alias("_id"),
            F.col(source_col).cast("string").alias("_source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        ),
        "mix-sizes",
    )
    tilted = tilts(sizes, word_targets(sizes, weights, share, max_repeat), max_repeat)
    per_source = tilted.withColumnRenamed("_source", "_of")
    exponent = F.col("_lambda") * F.col("_size") * F.col("_docs") / F.col("_words")
    rate = (
        F.when(F.col("_lambda") == float("inf"), float(max_repeat))
        .when(F.col("_size") == 0, 1.0)
        .otherwise(F.least(F.exp(exponent), F.lit(float(max_repeat))))
    )
    rated = sizes.join(sized(per_source, tilted), F.col("_of").eqNullSafe(F.col("_source"))).select(
        *(["_row"] if row_col else []), "_id", "_source", "_size", "_words", "_target", "_docs", rate.alias("_rate"),
        F.xxhash64("_id", "_size").alias("_key"),
    )
    buckets = F.pmod(F.shiftright("_key", 8), F.ceil(F.col("_docs") / BUCKET_DOCS) + 1)
    schema = (
        f"_id {kinds[id_col]}, _source string, _size long, _words long, _target double, _docs long, _rate double,"
        " _bucket long, _copies long"
    )
    if row_col:
        schema = f"_row {kinds[row_col]}, {schema}"
    return (
        rated.withColumn("_bucket", buckets)
        .groupBy("_source", "_bucket")
        .applyInArrow(lambda part: _round(part, max_repeat).select([f.split()[0] for f in schema.split(", ")]), schema)
    )


def take_mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, whatever ids are null or repeat; columns stay."""
    keyed, key = row_keyed(docs)
    taken, times = unused(keyed, "_taken"), unused(keyed, "_times")
    copies = (
        _rounded(keyed, id_col=id_col, row_col=key, **options)
        .filter("_copies > 0")
        .select(F.col("_row").alias(taken), F.col("_copies").cast("int").alias(times))
    )
    # the same plan at every size; one row per document is no table to broadcast
    joined = keyed.join(written(copies, "mix-copies").hint("merge"), F.col(key) == F.col(taken))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(taken)).select(*docs.columns)


@query("op1_source_mix")
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
