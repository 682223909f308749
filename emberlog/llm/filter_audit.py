"""Audit of how quality filters interact, by sorted posting lists.

Rows are dealt by ranges of ids, so that a task holds an unbroken range, and are cut into blocks
of one part (a language) and at most ``BLOCK_ROWS`` rows. For every filter a block has the
ascending list of the rows that fail it. Unions of lists over all subsets of the filters and the
differences between them are built by galloping merges: the place of a run of entries in another
list is searched with doubling steps from the place of the run before, and only inside the window
that this finds. What leaves a block are sizes; their sums over the blocks of a part say what each filter removes
in each order of the filters.

Defined results: a null text counts as empty, a null part as the empty string; a row is a repeat if
a smaller id has an identical text (compared by SHA-256), so a row without an id never is; rows
that repeat an id are documents of their own and share its labels; of several labels of an id the
largest counts; texts of any length are read whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import table
from emberlog.llm.registry import query
from emberlog.operators.joins import sized
from emberlog.session import written

BLOCK_ROWS = 1 << 16
RUN = 256
WHITE = " \t\n\x0b\f\r"


def default_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a text's own content: few words, repeated words, capitals, markup characters."""
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def judged(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column],
    repeats: str | None = "E",
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """_id, _at (unique), _part, _good, _toxic and one boolean column per filter (true: fails), one row per row of ``docs``.

    ``filters`` are conditions over a column ``_text``; ``repeats`` names the filter for texts that a
    smaller id has.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(part_col), F.lit("")).alias("_part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    rows = rows.select(
        "_id", "_part", F.monotonically_increasing_id().alias("_at"), F.unhex(F.sha2("_text", 256)).alias("_digest"),
        *[condition.alias(name) for name, condition in filters.items()],
    )
    rows = written(rows, "audit-rows")
    if repeats:
        firsts = rows.groupBy("_digest").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
        firsts = written(firsts.filter("_first < _last").drop("_last"), "audit-repeats")
        rows = rows.join(sized(firsts), "_digest", "left")
        rows = rows.withColumn(repeats, F.coalesce(F.col("_id") > F.col("_first"), F.lit(False))).drop("_first")
    marks = (
        labels.filter(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max("quality").alias("_quality"), F.max("toxic").alias("_bad"))
        .filter("_quality = 1 or _bad = 1")
    )
    rows = rows.drop("_digest").join(sized(written(marks, "audit-labels")), "_id", "left")
    good, toxic = (F.coalesce(F.col(c) == 1, F.lit(False)) for c in ("_quality", "_bad"))
    return rows.withColumns({"_good": good, "_toxic": toxic}).drop("_quality", "_bad")


def posting_lists(rows: DataFrame, names: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """part, first_id, last_id, n_docs, fails (one ascending list per filter), good, toxic: one row per block.

    Lists hold places of rows in their block, which is ordered by id, so repeated ids are told apart.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block_rows:
                yield from blocks(pa.Table.from_batches(held))
                held = []
        if held:
            yield from blocks(pa.Table.from_batches(held))

    def blocks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        parts = rows.column("_part").combine_chunks().dictionary_encode()
        if isinstance(parts, pa.ChunkedArray):
            parts = parts.combine_chunks()
        codes = parts.indices.to_numpy(zero_copy_only=False)
        ids = rows.column("_id")
        flags = [rows.column(n).to_numpy() for n in (*names, "_good", "_toxic")]
        for code, part in enumerate(parts.dictionary.to_pylist()):
            own = np.flatnonzero(codes == code)
            lists = [np.flatnonzero(f[own].astype(bool)).astype(np.int32) for f in flags]
            columns = [
                pa.array([part]),
                pa.array([ids[int(own[0])].as_py()], ids.type),
                pa.array([ids[int(own[-1])].as_py()], ids.type),
                pa.array([len(own)], pa.int64()),
                pa.array([lists[:-2]], pa.list_(pa.list_(pa.int32()))),
                *[pa.array([x], pa.list_(pa.int32())) for x in lists[-2:]],
            ]
            yield pa.RecordBatch.from_arrays(
                columns, ["part", "first_id", "last_id", "n_docs", "fails", "good", "toxic"]
            )

    kind = dict(rows.dtypes)["_id"]
    schema = (
        f"part string, first_id {kind}, last_id {kind}, n_docs long, fails array<array<int>>, good array<int>, "
        "toxic array<int>"
    )
    ordered = rows.repartitionByRange("_id", "_at").sortWithinPartitions("_id", "_at")
    return ordered.select("_id", "_part", *names, "_good", "_toxic").mapInArrow(run, schema)


def gallop(hay: np.ndarray, needles: np.ndarray, run: int = RUN) -> np.ndarray:
    """Where each of the ascending ``needles`` would stand in the ascending ``hay`` (before equal entries)."""
    out = np.empty(len(needles), dtype=np.int64)
    at = 0
    for low in range(0, len(needles), run):
        part = needles[low : low + run]
        end, step = at, run
        while end < len(hay) and hay[end] < part[-1]:
            end += step
            step *= 2
        out[low : low + len(part)] = at + np.searchsorted(hay[at : end + 1], part)
        at = int(out[low + len(part) - 1])
    return out


def _found(hay: np.ndarray, needles: np.ndarray, at: np.ndarray) -> np.ndarray:
    inside = at < len(hay)
    inside[inside] = hay[at[inside]] == needles[inside]
    return inside


def difference(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Entries of ``one`` that ``other`` doesn't hold."""
    return one[~_found(other, one, gallop(other, one))]


def common(one: np.ndarray, other: np.ndarray) -> int:
    """How many entries both hold; the shorter list gallops through the longer one."""
    short, long = sorted((one, other), key=len)
    return int(np.count_nonzero(_found(long, short, gallop(long, short))))


def union(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Entries of either; those that only the shorter list holds are put between those of the longer one."""
    short, long = sorted((one, other), key=len)
    at = gallop(long, short)
    fresh = ~_found(long, short, at)
    return np.insert(long, at[fresh], short[fresh])


def _sizes(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
    """before (bits of the filters applied), filter, size of their union, and what the filter removes: all, good, toxic."""
    unions = [np.zeros(0, np.int32)]
    for subset in range(1, 1 << len(lists)):
        last = subset.bit_length() - 1
        unions.append(union(unions[subset ^ (1 << last)], lists[last]))
    for before, held in enumerate(unions):
        for k, own in enumerate(lists):
            if not before >> k & 1:
                fresh = difference(own, held)
                yield before, k, len(held), len(fresh), common(fresh, good), common(fresh, toxic)


def subset_sizes(postings: DataFrame) -> DataFrame:
    """part, before, filter, docs, gone, fresh, fresh_good, fresh_toxic: sums over all blocks of a part.

    ``before`` is a set of filters as bits, ``gone`` the size of their union, ``fresh`` what ``filter``
    removes after them.
    """
    names = ["part", "before", "filter", "docs", "gone", "fresh", "fresh_good", "fresh_toxic"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, docs = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                lists = [np.asarray(own.values) for own in batch.column(2)[i]]
                good, toxic = (batch.column(c)[i].values.to_numpy() for c in (3, 4))
                rows = [(part, b, k, docs, *rest) for b, k, *rest in _sizes(lists, good, toxic)]
                kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "part string, before int, filter int, " + ", ".join(f"{n} long" for n in names[3:])
    sizes = postings.select("part", "n_docs", "fails", "good", "toxic").mapInArrow(run, schema)
    return sizes.groupBy(*names[:3]).agg(*[F.sum(n).alias(n) for n in names[3:]])


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column] | None = None,
    repeats: str | None = "E",
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """Every part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    filters = default_filters(F.col("_text")) if filters is None else filters
    names = [*filters, *([repeats] if repeats else [])]
    rows = judged(docs, labels, filters, repeats, id_col, text_col, part_col)
    sizes = written(subset_sizes(posting_lists(rows, names)), "audit-sizes")
    steps = [
        ("".join(names[k] for k in order), i + 1, k, sum(1 << j for j in order[:i]))
        for order in permutations(range(len(names)))
        for i, k in enumerate(order)
    ]
    # fixed by the number of filters, not by the data
    steps = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    per_filter = Window.partitionBy("part", "filter")
    return (
        sizes.join(F.broadcast(steps), ["before", "filter"])
        .withColumn("_all", F.max(F.when(F.col("before") == 0, F.col("fresh"))).over(per_filter))
        .withColumn("_only", F.min("fresh").over(per_filter))
        .select(
            "part",
            "filter_order",
            "step",
            (F.col("docs") - F.col("gone") - F.col("fresh")).alias("kept"),
            F.col("fresh").alias("removed"),
            (F.col("_all") - F.col("fresh")).alias("redundant"),
            F.col("_only").alias("unique_fails"),
            F.col("fresh_good").alias("good_lost"),
            F.col("fresh_toxic").alias("toxic_lost"),
            F.sum("fresh").over(per_filter).alias("shapley"),
        )
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (
  SELECT w.*, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e,
    coalesce(l.quality, 0) = 1 AS good, coalesce(l.toxic, 0) = 1 AS toxic
  FROM w LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)
), m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
    count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM x p, x q, x r, x s, x t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31
    AND p.bit | q.bit | r.bit | s.bit | t.bit = 31
), s AS (
  SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step])::INT - bits[step] AS before
  FROM o, unnest([1, 2, 3, 4, 5]) AS u(step)
), g AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (mask & (before | own) = 0) AS kept,
    sum(n) FILTER (mask & own <> 0 AND mask & before = 0) AS removed,
    sum(n) FILTER (mask & own <> 0 AND mask & before <> 0) AS redundant,
    sum(n) FILTER (mask = own) AS unique_fails,
    sum(good) FILTER (mask & own <> 0 AND mask & before = 0) AS good_lost,
    sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0) AS toxic_lost
  FROM m, s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM g
"""


@query("op13_filter_audit", SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
