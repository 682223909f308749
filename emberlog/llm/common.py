"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.joins import sized
from emberlog.session import written

SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: the bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


#: rows of an Arrow batch; whole texts make wide rows, and a batch is held several times over
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of the session hold more than ``BATCH_ROWS`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number that no two rows share and that stays the same however often it is read; its name.

    Rows of written files are named by file and place in it. Anything else may be evaluated anew for
    each use, so it is written once.
    """
    key = unused(docs, "_row")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        # not by name, as the table may have a column that is called so
        hidden = docs.metadataColumn("_metadata")
        file = F.xxhash64(hidden["file_path"]).cast("decimal(20,0)") * F.lit("10000000000000").cast("decimal(14,0)")
        number = (file + hidden["row_index"].cast("decimal(13,0)")).cast("decimal(38,0)")
        return docs.select("*", number.alias(key)), key
    numbered = docs.withColumn(key, F.monotonically_increasing_id().cast("decimal(38,0)"))
    return written(numbered, "row-keys"), key


def one_row_each(keyed: DataFrame, key: str, decisions: DataFrame) -> DataFrame:
    """The rows of ``keyed`` to keep, without ``key``, from ``decisions`` (_row, _group, kept), one per row.

    Of several kept rows of a group the one with the smallest key stays; rows without a group all do.
    """
    decisions = written(decisions, "row-decisions")
    kept = decisions.filter("kept and _group is not null")
    several = (
        kept.groupBy(F.col("_group").alias("_of"))
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
    )
    several = written(several.drop("_n"), "row-repeats")
    again = kept.join(sized(several), F.col("_group") == F.col("_of")).filter(F.col("_row") != F.col("_first"))
    name = unused(keyed, "_gone")
    gone = decisions.filter("not kept").select("_row").unionByName(again.select("_row"))
    gone = written(gone.withColumnRenamed("_row", name), "row-gone")
    return keyed.join(sized(gone), F.col(key) == F.col(name), "left_anti").drop(key)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one byte array, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each, whole rows only, so that temporary arrays stay small."""
    row, last = 0, len(starts) - 1
    while row < last:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + size, side="right")) - 1)
        yield row, min(end, last)
        row = min(end, last)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, key: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE_VALUE = seeds(256, 1 << 20)


def word_bounds(raw: np.ndarray, starts: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of bytes outside ``gaps``; no word crosses from one text to the next.

    With the default, words are ``[^\\x20\\x09-\\x0D]+``.
    """
    inside = ~gaps[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[starts] = True
    before = np.empty(len(raw), dtype=bool)
    after = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    begins = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return begins, ends


def word_hashes(
    raw: np.ndarray, starts: np.ndarray, lower: bool = True, gaps: np.ndarray = _SPACE, piece: int = 1 << 18
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, the words' begins, and the number of words before each text.

    The hash is a sum of random byte values times random position factors, mixed with the length.
    Long inputs are hashed piece by piece, cut between words.
    """
    begins, ends = word_bounds(raw, starts, gaps)
    lengths = ends - begins
    counts = np.searchsorted(begins, starts)
    out = np.empty(len(begins), dtype=np.uint64)
    factors = seeds(int(lengths.max(initial=1)), 7 << 40) | np.uint64(1)
    low = 0
    while low < len(begins):
        high = max(low + 1, int(np.searchsorted(begins, begins[low] + piece)))
        first, last = int(begins[low]), int(ends[high - 1])
        part = raw[first:last]
        if lower:
            part = _LOWER[part]
        at = begins[low:high] - first
        place = np.arange(last - first)
        owner = np.repeat(at, np.diff(np.append(at, last - first)))
        place -= owner
        gap = gaps[part]
        place[gap] = 0
        values = _BYTE_VALUE[part] * factors[place]
        values[gap] = 0
        out[low:high] = np.add.reduceat(values, at)
        low = high
    return mix(out + lengths.astype(np.uint64)), begins, counts
