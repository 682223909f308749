"""Positions and running totals inside ordered groups of any size.

A plain window function sorts a whole group in one task. That is right while groups are
small, and useless when one node or one service holds a third of all rows. The functions
here first measure the largest group. Above ``rows_per_range`` they cut the order columns
into ranges of about equal size, total each (group, range), turn the totals into offsets,
and sort only inside a range. No task ever sorts more than about one range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.operators.joins import sized
from emberlog.session import written

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 16_384

_RANGE = "_range"


def position(ts: str = "ts", row_id: str = "log_id") -> Column:
    """(ts, id) as one number with the same order, for ids from 0 to 2^63.

    The minimum of a number is a hash aggregation; that of a struct sorts every input row.
    """
    micros = F.unix_micros(ts).cast("decimal(38,0)")
    return micros * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col(row_id).cast("long")


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest group; one number reaches the driver."""
    if not keys:
        return df.count()
    sizes = df.groupBy(*keys).count()
    return sizes.agg(F.max("count")).first()[0] or 0


def _numeric(df: DataFrame, name: str) -> Column:
    """Order column as a double that sorts the same way (ties allowed)."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name)).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, T.StringType):
        # the first six bytes as a number keep the byte order that Spark sorts strings by
        head = F.rpad(F.substring(F.hex(F.encode(F.col(name), "utf-8")), 1, 12), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    raise TypeError(f"cannot order by ranges of {name}: {kind.simpleString()}")


def _with_ranges(df: DataFrame, order: Sequence[str], n_ranges: int) -> DataFrame:
    """Add ``_range``: a number that never decreases along ``order``.

    Quantiles of the first order column bound the ranges. A value so frequent that it is
    itself a quantile gets ranges of its own, cut by the quantiles of the second column.
    """
    probabilities = [i / n_ranges for i in range(1, n_ranges)]
    accuracy = max(10_000, 10 * n_ranges)
    leading = list(order[:2])
    quantiles = df.agg(
        *[F.percentile_approx(_numeric(df, c), probabilities, accuracy).alias(c) for c in leading]
    ).first()
    cuts = {c: sorted({float(q) for q in (quantiles[c] or [])}) for c in leading}

    out = df
    for c in leading:
        out = out.withColumn(f"_num_{c}", _numeric(df, c))
        splits = [float("-inf"), *cuts[c], float("inf")]
        if len(splits) > 2:
            bucketizer = Bucketizer(
                splits=splits, inputCol=f"_num_{c}", outputCol=f"_cut_{c}", handleInvalid="keep"
            )
            out = bucketizer.transform(out)
            out = out.withColumn(f"_cut_{c}", F.when(F.col(f"_num_{c}").isNull(), -1).otherwise(F.col(f"_cut_{c}")))
        else:
            out = out.withColumn(f"_cut_{c}", F.lit(0.0))
    first = leading[0]
    on_cut = F.coalesce(F.col(f"_num_{first}").isin(cuts[first]) if cuts[first] else F.lit(False), F.lit(False))
    within = F.when(on_cut, F.col(f"_cut_{leading[1]}")).otherwise(0) if len(leading) > 1 else F.lit(0)
    major = F.col(f"_cut_{first}") * 2 + F.when(on_cut, 0).otherwise(1)
    out = out.withColumn(_RANGE, (major * (n_ranges + 2) + within).cast("long"))
    return out.drop(*[f"_num_{c}" for c in leading], *[f"_cut_{c}" for c in leading])


def running_totals(
    df: DataFrame,
    totals: dict[str, Column],
    order: Sequence[str],
    keys: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
    biggest: int | None = None,
) -> DataFrame:
    """Add inclusive running sums ``totals`` along ascending ``order`` inside each group of ``keys``.

    ``order`` must be unique inside a group; its first two columns are timestamps, numbers or strings.
    ``biggest`` is the size of the largest group, where it is known.
    """
    keys, order = list(keys), list(order)
    biggest = largest_group(df, keys) if biggest is None else biggest
    if biggest <= rows_per_range:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(window).alias(name) for name, c in totals.items()])

    n_ranges = min(MAX_RANGES, -(-df.count() // rows_per_range) + 1)
    ranged = _with_ranges(df, order, n_ranges)
    inside = Window.partitionBy(*keys, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(c).over(inside).alias(name) for name, c in totals.items()])

    earlier = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, _RANGE).agg(*[F.sum(c).alias(f"_t_{name}") for name, c in totals.items()])
    offsets = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(_RANGE).alias("_k_range"),
        *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}") for name in totals],
    )
    # one row per group and range: while these are few, the numbered rows stay where they are
    offsets = sized(written(offsets, "range-offsets"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col(_RANGE) == F.col("_k_range")]
    joined = local.join(offsets, reduce(lambda a, b: a & b, same), "inner")
    return joined.select(
        *df.columns, *[(F.col(name) + F.col(f"_o_{name}")).alias(name) for name in totals]
    )


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "row_no",
    rows_per_range: int = ROWS_PER_RANGE,
    biggest: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row inside its group along ``order``."""
    return running_totals(df, {name: F.lit(1).cast("long")}, order, keys, rows_per_range, biggest)


def number_stored_rows(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str],
    name: str = "row_no",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """As ``number_rows`` for rows that are dear to work out: they are stored once, then measured and numbered.

    Rows that agree in keys and order get numbers of their own, in no particular order.
    """
    stored = written(df, "rows-to-number")
    return number_rows(stored, order, keys, name, rows_per_range)


def first_rows(df: DataFrame, n: int | Column, order: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """Keep the ``n`` first rows of each group, with their ``rank``.

    Spark limits every map task to ``n`` rows per group before it shuffles
    (WindowGroupLimit), so a hot group costs no more than its first rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)
