"""Removing byte strings that repeat across documents, with suffix arrays.

A byte goes if a 50-byte string of the input that covers it also starts in a document with a smaller
id. The job is cut into blocks of bounded size so that equal strings always meet:

1. Copies of whole texts lose everything, but for the one with the smallest id; the rest goes on.
2. Every 50-byte window chooses an anchor, its 24-byte gram with the smallest hash. Equal windows
   choose equal anchors. Runs of windows with one anchor are strips of 50 to 76 bytes.
3. Anchors meet in buckets by value, as sorted blocks. A bitmap of bounded size of those that
   occur in several texts thins out the strips; what it lets through by chance falls away later.
4. Equal strips are combined to their smallest id. What is left of an anchor is sorted in a suffix
   array (linear grouping, see ``suffix_array``), many anchors to a block. The windows of a strip are
   taken in four classes by the place of the gram; those of a class share a core of 44 bytes, which is one
   symbol, and windows that agree in seven symbols are equal: the smallest id among them decides. Strips
   that are alone with a core are left out before. Anchors with over 4096 different strips, as at the
   edges of a passage that very many documents share, have their windows grouped one by one by
   content instead, so that no block grows with such a group.
5. The findings go back to all texts with the strip, spans are merged per text, and cut out.

Defined results: a null or empty text has no bytes and loses none; rows without an id count as later
than all others and not as earlier than one another; rows that repeat an id are compared with
other ids only; equal texts of one id share their result; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import mix, slices, table, utf8
from emberlog.llm.registry import query
from emberlog.llm.suffix_array import suffix_array
from emberlog.llm.winnow import GRAM, WINDOW, Strips, strips
from emberlog.operators.joins import sized
from emberlog.session import written

MOST_STRIPS = 4096
BLOCK_SYMBOLS = 1 << 15
#: windows by the number of bytes before their gram: first and last of classes of one width
REACHES = [(0, 6), (7, 13), (14, 20), (20, 26)]
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
PIECE_BITS = 1 << 17
ANCHOR_BITS = 48
BLOCK_ANCHORS = 1 << 20
BUCKET_BYTES = 4 << 20
LAST = (1 << 63) - 1


def _batch_strips(column: pa.Array) -> Iterator[tuple[np.ndarray, int, Strips]]:
    """The raw bytes, the first row, and the strips of slices of a text column."""
    raw, starts = utf8(column)
    for a, b in slices(starts):
        part = raw[starts[a] : starts[b]]
        for found in strips(part, starts[a : b + 1] - starts[a]):
            yield part, a, found


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_rank, _text, and _mark, which tells apart the texts of a repeated id."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_rank"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    ).withColumn("_mark", F.xxhash64("_text"))


def _shared_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """The first 48 bits of the anchors that more than one text has.

    A task sorts the anchors of many texts and sends them on in blocks by value, as differences:
    an anchor reaches its bucket once per block, however many texts have it.
    """
    step = -(-(1 << ANCHOR_BITS) // buckets)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            owner = found // step
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            gaps = np.diff(found, prepend=found[:1])
            gaps[first] = found[first] - owner[first] * step
            wide = gaps >= 1 << 32
            several = found[counts > 1]
            at = np.searchsorted(several, owner[first] * step)
            ends = np.append(first[1:], len(found))
            data = []
            for a, b in zip(first, ends):
                # four bytes a difference, unless one of the block's is larger
                data.append((gaps[a:b] if wide[a:b].any() else gaps[a:b].astype(np.uint32)).tobytes())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(owner[first]),
                    pa.array(ends - first),
                    pa.array(data, pa.binary()),
                    pa.array([several[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(several)))], pa.binary()),
                ],
                ["bucket", "n", "gaps", "several"],
            )

        for batch in batches:
            for _, _, found in _batch_strips(batch.column(0)):
                anchor = (found.anchor >> np.uint64(64 - ANCHOR_BITS)).astype(np.int64)
                order = np.lexsort((anchor, found.text))
                text, anchor = found.text[order], anchor[order]
                new = np.append(True, (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]))
                held.append(anchor[new])
                size += int(new.sum())
            if size >= BLOCK_ANCHORS:
                yield block()
                held, size = [], 0
        if size:
            yield block()

    def meet(part: pa.Table) -> pa.Table:
        bucket = part["bucket"][0].as_py()
        found = []
        for n, gaps in zip(part["n"].to_pylist(), part["gaps"]):
            raw = gaps.as_py()
            found.append(np.cumsum(np.frombuffer(raw, dtype=np.uint32 if len(raw) == 4 * n else np.int64), dtype=np.int64))
        names, counts = np.unique(np.concatenate(found), return_counts=True)
        several = [np.frombuffer(x.as_py(), dtype=np.int64) for x in part["several"]]
        return pa.table({"anchor": np.union1d(names[counts > 1] + bucket * step, np.concatenate(several))})

    sent = texts.select("_text").mapInArrow(blocks, "bucket long, n long, gaps binary, several binary")
    return sent.groupBy("bucket").applyInArrow(meet, "anchor long")


def _slots(anchors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the bitmap for the first bits of an anchor."""
    mask, spread = np.uint64(bits - 1), mix(anchors.astype(np.uint64))
    return (spread & mask).astype(np.int64), (spread >> np.uint64(36) & mask).astype(np.int64)


def _bitmap(shared: DataFrame) -> np.ndarray:
    """Two bits for each anchor, in at most MOST_BITS; made in pieces by the executors."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 16 * shared.count()):
        bits *= 2
    piece = min(bits, PIECE_BITS)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.concatenate(_slots(batch.column(0).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots // piece), pa.array((slots % piece).astype(np.int32))], ["piece", "slot"]
            )

    def fill(part: pa.Table) -> pa.Table:
        on = np.zeros(piece, dtype=np.uint8)
        on[part["slot"].to_numpy()] = 1
        return pa.table({"piece": part["piece"][:1], "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    pieces = shared.mapInArrow(spread, "piece long, slot int").groupBy("piece").applyInArrow(fill, "piece long, bits binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for number, data in pieces.toLocalIterator():
        at = number * piece // 8
        out[at : at + piece // 8] = np.frombuffer(data, dtype=np.uint8)
    return out


def _strips_of(texts: DataFrame, bitmap) -> DataFrame:
    """_rank, _mark, begin, windows, place, anchor and strip (bytes) of the strips whose anchor the bitmap knows."""

    def known(anchors: np.ndarray) -> np.ndarray:
        bits = bitmap.value
        first, second = _slots(anchors >> np.uint64(64 - ANCHOR_BITS), len(bits) * 8)
        on = (bits[first >> 3] >> (7 - (first & 7)) & 1).astype(bool)
        on[on] = (bits[second[on] >> 3] >> (7 - (second[on] & 7)) & 1).astype(bool)
        return on

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, row, found in _batch_strips(batch.column(2)):
                at = np.flatnonzero(known(found.anchor))
                rows = pa.array(found.text[at] + row)
                length = found.windows[at] + WINDOW - 1
                ends = np.cumsum(length)
                if not len(at):
                    continue
                data = raw[np.repeat(found.raw[at] - (ends - length), length) + np.arange(ends[-1])]
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                cut = pa.Array.from_buffers(
                    pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(found.begin[at].astype(np.int32)),
                        pa.array(found.windows[at].astype(np.int32)),
                        pa.array(found.place[at].astype(np.int32)),
                        pa.array(found.anchor[at].view(np.int64)),
                        cut,
                    ],
                    ["_rank", "_mark", "begin", "windows", "place", "anchor", "strip"],
                )

    schema = "_rank long, _mark long, begin int, windows int, place int, anchor long, strip binary"
    return texts.select("_rank", "_mark", "_text").mapInArrow(run, schema)


def candidates(members: list[tuple[int, bytes, int]]) -> Iterator[tuple[int, int, tuple[int, bytes], bytes, bytes]]:
    """Parts of strips (place, bytes, rank) of one anchor whose windows another rank may have too.

    Number of the strip, first window, core, and the bytes before and behind the core. A window with q bytes
    before the gram has 26 - q behind it, so all windows with ``low`` <= q <= ``high`` hold the same core of
    44 bytes. A strip that is alone with a core shares none of the windows around it.
    """
    around = WINDOW - GRAM
    first: dict[tuple[int, bytes], int] = {}
    several = set()
    parts = []
    for number, (place, strip, rank) in enumerate(members):
        for low, high in REACHES:
            begin, end = place - low, place + GRAM + around - high
            if begin >= 0 and end <= len(strip):
                core = (low, strip[begin:end])
                cut = max(0, place - high)
                parts.append((number, cut, core, strip[cut:begin], strip[end : end + high - low]))
                if first.setdefault(core, rank) != rank:
                    several.add(core)
    return (part for part in parts if part[2] in several)


def earlier_windows(parts: list[tuple[tuple[int, bytes], bytes, bytes, int]]) -> np.ndarray:
    """For each part (core, bytes before and behind it, rank), a mask of the windows that a smaller rank has too.

    All windows of a part hold its core, which becomes one symbol of the sorted text.
    """
    width = REACHES[0][1] - REACHES[0][0] + 1
    names: dict[tuple[int, bytes], int] = {}
    symbols: list[int] = []
    for core, before, behind, _ in parts:
        symbols += before
        symbols.append(names.setdefault(core, 256 + len(names)))
        symbols += behind
    text = np.array(symbols, dtype=np.int64)
    sizes = np.array([len(before) + 1 + len(behind) for _, before, behind, _ in parts])
    counts = sizes - width + 1
    starts, begins = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(parts)), counts)
    window_at = np.arange(len(owner)) + (starts - begins)[owner]
    window_of = np.full(len(text), -1, dtype=np.int64)
    window_of[window_at] = np.arange(len(window_at))
    ranked = window_of[suffix_array(text)]
    ranked = ranked[ranked >= 0]
    # equal windows are neighbours; in them, everything up to the end of the window is equal
    views = np.lib.stride_tricks.sliding_window_view(text, width)[window_at[ranked]]
    first = np.flatnonzero(np.append(True, (views[1:] != views[:-1]).any(axis=1)))
    ranks = np.array([rank for *_, rank in parts], dtype=np.int64)[owner[ranked]]
    least = np.repeat(np.minimum.reduceat(ranks, first), np.diff(np.append(first, len(ranks))))
    gone = ranked[least < ranks]
    masks = np.zeros(len(parts), dtype=np.int64)
    np.bitwise_or.at(masks, owner[gone], np.left_shift(1, gone - begins[owner[gone]]))
    return masks


def _whole_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches sorted by anchor, cut where an anchor ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        anchors = batch.column(0).to_numpy()
        end = int(np.searchsorted(anchors, anchors[-1]))
        if held and (end or held[-1].column(0)[-1].as_py() != anchors[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, end)])
            held = []
        elif end:
            yield pa.Table.from_batches([batch.slice(0, end)])
        held.append(batch.slice(end))
    if held:
        yield pa.Table.from_batches(held)


def _sorted_blocks(distinct: DataFrame) -> DataFrame:
    """anchor, key, least and mask of the strips of anchors that aren't too frequent."""
    names = ["anchor", "key", "least", "mask"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []
        symbols = 0

        def block() -> None:
            if held:
                masks = earlier_windows([(core, before, behind, row[4]) for row, _, core, before, behind in held])
                for at in np.flatnonzero(masks).tolist():
                    row, cut, *_ = held[at]
                    out.append((row[0], row[1], row[4], int(masks[at]) << cut))

        def batch_of() -> pa.RecordBatch:
            columns = zip(*out) if out else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for part in _whole_anchors(batches):
            # all texts with a strip that several texts have are told of it, also where nothing else is equal
            repeated = part.filter(pa.compute.greater(part["texts"], 1)).select(["anchor", "key", "least"])
            repeated = repeated.append_column("mask", pa.array(np.zeros(repeated.num_rows, dtype=np.int64)))
            yield from repeated.combine_chunks().to_batches()
            anchors = part["anchor"].to_numpy()
            same = anchors[1:] == anchors[:-1]
            some = part.filter(pa.array(np.append(same, False) | np.append(False, same)))
            for _, group in groupby(zip(*(c.to_pylist() for c in some.columns)), key=lambda r: r[0]):
                members = list(group)
                for number, *part in candidates([(place, strip, least) for _, _, place, strip, least, _ in members]):
                    held.append((members[number], *part))
                    symbols += len(part[2]) + 1 + len(part[3])
                if symbols >= BLOCK_SYMBOLS:
                    block()
                    held, symbols = [], 0
                if len(out) >= 10_000:
                    yield batch_of()
                    out.clear()
        block()
        if out:
            yield batch_of()

    return (
        distinct.select("anchor", "key", "place", "strip", "least", "texts")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "key")
        .mapInArrow(run, "anchor long, key long, least long, mask long")
    )


def _grouped_windows(distinct: DataFrame) -> DataFrame:
    """The same for anchors with very many strips: their windows are grouped by content."""
    windows = distinct.select(
        "anchor", "key", "least", "strip", F.explode(F.sequence(F.lit(0), F.length("strip") - WINDOW)).alias("at")
    ).withColumn("window", F.substring(F.col("strip"), F.col("at") + 1, F.lit(WINDOW)))
    windows = windows.drop("strip")
    first = windows.groupBy("window").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("n"))
    met = windows.join(first.filter("n > 1").drop("n"), "window").filter("first < least")
    masks = met.groupBy("anchor", "key").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    return (
        distinct.join(masks, ["anchor", "key"], "left")
        .filter("mask is not null or texts > 1")
        .select("anchor", "key", "least", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    )


def _merged(spans: DataFrame) -> DataFrame:
    """Maximal removed runs of each text, as begin and end in turn."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(2):
                values = found.values
                begin, mask = values.field("begin").to_numpy(), values.field("mask").to_numpy().view(np.uint64)
                on = (mask[:, None] >> np.arange(WINDOW - GRAM + 1, dtype=np.uint64)[None, :]) & np.uint64(1)
                at = np.unique((begin[:, None] + np.arange(WINDOW - GRAM + 1)[None, :])[on.astype(bool)])
                # a window covers WINDOW bytes; a run ends where the next window begins behind its end
                split = np.flatnonzero(at[1:] > at[:-1] + WINDOW)
                lows, highs = at[np.append(0, split + 1)], at[np.append(split, len(at) - 1)] + WINDOW
                out.append(np.column_stack([lows, highs]).ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["_rank", "_mark", "_runs"]
            )

    # rows that share id and text have the same spans: one of each begin is left before a text's are gathered
    dealt = spans.repartition("_rank", "_mark").groupBy("_rank", "_mark", "begin").agg(F.bit_or("mask").alias("mask"))
    grouped = dealt.groupBy("_rank", "_mark").agg(F.collect_list(F.struct("begin", "mask")).alias("found"))
    return grouped.mapInArrow(run, "_rank long, _mark long, _runs array<int>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, spans (begin and end of each removed run in turn) and kept (bytes)."""
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    narrow = written(
        texts.select("_rank", "_mark", F.sha2("_text", 256).alias("_sha"), F.octet_length("_text").alias("_size")),
        "repeat-texts",
    )
    leaders = narrow.groupBy("_sha").agg(F.min("_rank").alias("_first"), F.max("_rank").alias("_other"))
    leaders = leaders.filter("_first <> _other").drop("_other")
    # later copies of whole texts; all their windows start in the first copy too
    copies = narrow.join(leaders, "_sha").filter("_rank > _first").select("_rank", "_mark").distinct()
    copies = written(copies.withColumn("_copy", F.lit(True)), "repeat-copies")
    copied = texts.join(sized(copies), ["_rank", "_mark"], "left")
    single = copied.filter("_copy is null").select("_rank", "_mark", "_text")

    size = narrow.agg(F.sum(F.col("_size").cast("long"))).first()[0] or 0
    shared = written(_shared_anchors(single, 1 + size // BUCKET_BYTES), "repeat-anchors")
    bitmap = spark.sparkContext.broadcast(_bitmap(shared))
    key = F.xxhash64("place", "strip").alias("key")
    found = _strips_of(single, bitmap)
    distinct = written(
        found.groupBy("anchor", "place", "strip")
        .agg(F.min("_rank").alias("least"), F.count(F.lit(1)).alias("texts"))
        .withColumn("key", key),
        "repeat-strips",
    )
    frequent = written(
        distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_STRIPS).select("anchor"),
        "repeat-frequent",
    )
    usual = _sorted_blocks(distinct.join(sized(frequent), "anchor", "left_anti"))
    findings = usual.unionByName(_grouped_windows(distinct.join(sized(frequent), "anchor", "left_semi")))
    findings = written(findings, "repeat-findings")

    everything = F.expr("shiftleft(1L, windows) - 1")
    spans = (
        found.select("_rank", "_mark", "begin", "windows", "anchor", key)
        .join(findings, ["anchor", "key"])
        .select("_rank", "_mark", "begin", F.when(F.col("_rank") > F.col("least"), everything).otherwise(F.col("mask")).alias("mask"))
        .filter("mask <> 0")
    )
    runs = written(_merged(spans), "repeat-runs")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, copy, runs in zip(batch.column(1), batch.column(2), batch.column(3)):
                raw = text.as_py().encode()
                found = runs.as_py() or []
                if copy.as_py() and len(raw) >= WINDOW:
                    found = [0, len(raw)]
                sizes.append(len(raw))
                spans.append(found)
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *found[1::2]], [*found[::2], len(raw)])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(spans, pa.list_(pa.int32())),
                    pa.array(kept, pa.binary()),
                ],
                ["_rank", "n_bytes", "spans", "kept"],
            )

    every = copied.join(sized(runs), ["_rank", "_mark"], "left").select("_rank", "_text", "_copy", "_runs")
    result = every.mapInArrow(cut, "_rank long, n_bytes long, spans array<int>, kept binary")
    own = F.when(F.col("_rank") != LAST, F.col("_rank")).cast(dict(docs.dtypes)[id_col])
    return result.select(own.alias(id_col), "n_bytes", "spans", "kept")


SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (
  SELECT doc_id, pos, substr(x, 2 * pos + 1, 100) AS s
  FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS pos FROM b)
), f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT w.doc_id, pos FROM w JOIN f USING (s) WHERE w.doc_id > first),
g AS (SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM c),
r AS (
  SELECT doc_id, min(pos) AS low, max(pos) + 50 AS high
  FROM (SELECT *, count(*) FILTER (gap > 50) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g) GROUP BY doc_id, run
), k AS (
  SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS after FROM r
), p AS (
  SELECT b.doc_id, string_agg(substr(x, 2 * after + 1, 2 * (low - after)), '' ORDER BY low)
    || substr(any_value(x), 2 * max(high) + 1) AS left_over, sum(high - low) AS n_removed, count(*) AS n_spans
  FROM k JOIN b USING (doc_id) GROUP BY b.doc_id
)
SELECT b.doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(left_over, x))) AS kept_sha256
FROM b LEFT JOIN p USING (doc_id)
"""


@query("op10_suffix_dedup", SQL)
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
