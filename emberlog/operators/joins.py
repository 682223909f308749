"""Joins against a smaller table, broadcast only after its size was checked."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


# measured sizes by DataFrame, as one small table is often joined several times
_MEASURED: WeakKeyDictionary[DataFrame, dict[int, tuple[int, int]]] = WeakKeyDictionary()


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` of JSON text.

    Reads at most ``max_rows + 1`` rows and returns two numbers to the driver.
    """
    measured = _MEASURED.setdefault(df, {})
    if max_rows not in measured:
        measured[max_rows] = _measure(df, max_rows)
    rows, size = measured[max_rows]
    return rows <= max_rows and size <= max_bytes


def _measure(df: DataFrame, max_rows: int) -> tuple[int, int]:
    size = (
        df.limit(max_rows + 1)
        .select(F.length(F.to_json(F.struct("*"))).alias("bytes"))
        .agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
        .first()
    )
    return size["rows"], size["bytes"]


def sized(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is small, else unchanged.

    Meant for derived tables, whose size Spark can only guess; a table read straight from
    files is broadcast by Spark itself when the files are small. ``of`` names a table that
    ``df`` is a projection of, to measure that one. Without the hint Spark shuffles both
    sides, and adaptive execution splits a hot key's partition, so the join stays correct
    and balanced at any size.
    """
    return F.broadcast(df) if is_small(df if of is None else of) else df
