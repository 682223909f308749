"""Prefix trie of conversations, counted in shards by node tables with minimal perfect hashing.

1. Turns are dealt by ranges of (conversation, turn) and sorted there. A turn's place in its conversation is
   its place in the range plus the counts of earlier ranges, so no task needs a whole conversation.
2. A prefix is named by a chain of SHA-256 digests over its turns, 128 bits of each. Chains run
   inside bands of ``BAND`` turns; the digest of the band before starts the next band.
3. All rows of a prefix are combined to a node. They must agree on their parent and last turn, so two
   different prefixes under one digest end the job instead of being merged.
4. Conversations, band by band, are hashed to shards of bounded size. A shard holds the paths of its
   conversations and the values of the nodes whose smallest member it has. It gives every distinct
   digest a slot by a minimal perfect hash, scatters the values into flat arrays, and adds them up
   through an array of parent slots, deepest nodes first. The sums of all shards are added by node.
   Bands are taken from the deepest up; what the top of a band has gathered goes on to its parent.

A node that all conversations share is thus in every shard as one row, whatever its size.

Defined results: null roles and texts become empty; turns of a conversation are ordered by turn, role and
text, nulls first, and repeated rows are repeated turns; rows without a conversation id are left out;
c - c % 100 and c % 100 round towards zero for negative ids; texts of any length are read whole; an
empty table has no node, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import table
from emberlog.llm.perfect_hash import PerfectHash
from emberlog.llm.registry import query
from emberlog.session import written

BAND = 4096
SHARD_ROWS = 20_000
PIECE_CHARS = 1 << 16
#: what orders turns when ranges are cut; inside a range whole roles and texts decide
HEAD_CHARS = 64
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _halves(binary: Column) -> list[Column]:
    """The first 16 bytes of a digest as two numbers, which aggregate in place."""
    digits = F.hex(binary)
    return [_number(F.substring(digits, 1, 16)), _number(F.substring(digits, 17, 16))]


def _number(digits: Column) -> Column:
    # conv gives an unsigned number; two's complement makes it a long
    whole = F.conv(digits, 16, 10).cast("decimal(20,0)")
    over = whole >= F.lit("9223372036854775808").cast("decimal(20,0)")
    back = F.lit("18446744073709551616").cast("decimal(20,0)")
    return F.when(over, whole - back).otherwise(whole).cast("long")


def placed_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv, pos (from 0), th, tl (digest of role and text), chars (of the text): one row per turn."""
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).alias("_turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("_role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    )
    heads = [F.substring(c, 1, HEAD_CHARS) for c in ("_role", "_text")]
    both = F.sha2(F.concat(F.sha2("_role", 256), F.sha2("_text", 256)), 256)
    high, low = _halves(F.unhex(both))
    ordered = written(
        rows.repartitionByRange("conv", "_turn", *heads)
        .sortWithinPartitions("conv", "_turn", "_role", "_text")
        .select(
            "conv",
            F.monotonically_increasing_id().alias("_at"),
            F.spark_partition_id().alias("_range"),
            high.alias("th"),
            low.alias("tl"),
            F.length("_text").cast("long").alias("chars"),
        ),
        "trie-turns",
    )
    parts = ordered.groupBy("conv", "_range").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    # one row per range that a conversation touches
    earlier = Window.partitionBy("conv").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    pos = (F.col("_at") - F.col("_from") + F.col("_before")).alias("pos")
    return ordered.join(parts, ["conv", "_range"]).select("conv", pos, "th", "tl", "chars")


def rebuilt(placed: DataFrame, head: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``head`` turns are those of conversation ``base``; both are expressions over conv.

    ``head`` is at most ``most``. Gives the rows (conv, depth from 1, th, tl, chars, last) and the conversations
    (conv, depth: number of turns).
    """
    convs = placed.groupBy("conv").agg(F.max("pos").alias("_top"))
    convs = convs.withColumns({"_head": head, "_base": base, "_n": F.col("_top") + 1}).drop("_top")
    sizes = convs.select(F.col("conv").alias("_base"), F.col("_n").alias("_base_n"))
    convs = convs.join(sizes, "_base", "left")
    convs = convs.withColumn("_taken", F.least("_head", F.coalesce("_base_n", F.lit(0))))
    total = F.col("_taken") + F.greatest(F.col("_n") - F.col("_head"), F.lit(0))
    convs = written(convs.select("conv", "_head", "_base", "_taken", total.alias("depth")), "trie-conversations")
    firsts = placed.filter(F.col("pos") < most).withColumnRenamed("conv", "_base")
    # at most ``most`` turns of a base for each of its conversations
    heads = convs.join(firsts, "_base").filter(F.col("pos") < F.col("_taken"))
    heads = heads.select("conv", (F.col("pos") + 1).alias("d"), "th", "tl", "chars", "depth")
    own = placed.join(convs, "conv").filter(F.col("pos") >= F.col("_head"))
    own = own.select(
        "conv", (F.col("pos") - F.col("_head") + F.col("_taken") + 1).alias("d"), "th", "tl", "chars", "depth"
    )
    rows = heads.unionByName(own).withColumn("last", F.col("d") == F.col("depth")).drop("depth")
    return rows.withColumnRenamed("d", "depth"), convs.select("conv", "depth")


def _chain(before: bytes, th: int, tl: int) -> bytes:
    return hashlib.sha256(before + th.to_bytes(8, "big", signed=True) + tl.to_bytes(8, "big", signed=True)).digest()[:16]


def _pair(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


_ROOT = _pair(hashlib.sha256(b"root").digest()[:16])


def prefixes(rows: DataFrame, convs: DataFrame, band: int = BAND) -> DataFrame:
    """conv, band, depth, h, l (digest of the prefix), ph, pl (of its parent), th, tl, chars, last: one row per prefix.

    Every conversation has a row of depth 0, without parent.
    """
    names = ["conv", "band", "depth", "h", "l", "ph", "pl", "th", "tl", "chars", "last"]
    longs = names[:2] + names[2:10]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, b""
        for batch in batches:
            out = []
            for conv, number, depth, th, tl, chars, last, start in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (conv, number):
                    at, digest = (conv, number), start or b""
                parent = _pair(digest) if digest else _ROOT
                digest = _chain(digest, th, tl)
                out.append((conv, number, depth, *_pair(digest), *parent, th, tl, chars, last))
            if out:
                kinds = [pa.int64()] * 10 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = ", ".join(f"{n} long" for n in longs) + ", last boolean"
    banded = written(rows.withColumn("band", F.floor((F.col("depth") - 1) / band)), "trie-rows")
    long = banded.filter("band > 0").select("conv").distinct()
    starts = _band_starts(banded.join(long, "conv", "left_semi"))
    ordered = (
        banded.join(starts, ["conv", "band"], "left")
        .repartition("conv", "band")
        .sortWithinPartitions("conv", "band", "depth")
        .select("conv", "band", "depth", "th", "tl", "chars", "last", "start")
    )
    root = convs.select(
        "conv", F.lit(0).alias("band"), F.lit(0).alias("depth"), F.lit(_ROOT[0]).alias("h"), F.lit(_ROOT[1]).alias("l"),
        *[F.lit(None).cast("long").alias(n) for n in ("ph", "pl")],
        *[F.lit(0).cast("long").alias(n) for n in ("th", "tl", "chars")], (F.col("depth") == 0).alias("last"),
    )
    root = root.select(*[F.col(n).cast("long") for n in longs], "last")
    return ordered.mapInArrow(run, schema).unionByName(root)


def _band_starts(rows: DataFrame) -> DataFrame:
    """conv, band, start: the digest that a band begins with, for conversations of several bands.

    The digest of a prefix is a chain, so a band's turns must follow the band before: one task takes the
    bands of a conversation in order, as a stream of sorted narrow rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, b""
        for batch in batches:
            out = []
            for conv, band, th, tl in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None or at[0] != conv:
                    digest = b""
                elif at[1] != band:
                    out.append((conv, band, digest))
                at = (conv, band)
                digest = _chain(digest, th, tl)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv", "band", "start"]
                )

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "depth")
    return ordered.select("conv", "band", "th", "tl").mapInArrow(run, "conv long, band long, start binary")


def node_table(rows: DataFrame) -> DataFrame:
    """One row per distinct prefix: h, l, ph, pl, depth, chars, conv_id (smallest member), n_convs, n_children."""
    same = ["depth", "ph", "pl", "th", "tl", "chars"]
    nodes = rows.groupBy("h", "l").agg(
        F.min("conv").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        *[F.min(c).alias(c) for c in same],
        *[F.max(c).alias(f"_{c}") for c in same],
    )
    clash = F.lit(False)
    for c in same:
        clash = clash | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    seen = F.when(clash, F.raise_error(F.lit("two prefixes have one digest")).cast("long")).otherwise(F.col("depth"))
    nodes = written(nodes.select("h", "l", "ph", "pl", seen.alias("depth"), "chars", "conv_id", "n_convs"), "trie-nodes")
    children = nodes.filter("ph is not null").groupBy(F.col("ph").alias("h"), F.col("pl").alias("l"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    joined = nodes.join(children, ["h", "l"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return written(joined, "trie-nodes")


def _accumulated(rows: pa.Table) -> pa.Table:
    """h, l, ph, pl, top, leaves, saved: sums over the subtrees that a shard knows, for its nodes with any.

    Rows with a value add it to their node; rows without one only give a node's place.
    """
    high, low = (rows.column(c).to_numpy().view(np.uint64) for c in ("h", "l"))
    valued = rows.column("valued").to_numpy()
    path = np.flatnonzero(~valued)
    # a structured view sorts both halves of a digest as one key
    pairs = np.empty(len(path), dtype=[("h", np.uint64), ("l", np.uint64)])
    pairs["h"], pairs["l"] = high[path], low[path]
    distinct, first = np.unique(pairs, return_index=True)
    first = path[first]
    slots = PerfectHash(distinct["h"], distinct["l"])
    n = len(distinct)
    own = slots.find(distinct["h"], distinct["l"])
    depth = np.empty(n, dtype=np.int64)
    depth[own] = rows.column("depth").to_numpy()[first]
    parent_high, parent_low = (rows.column(c).fill_null(0).to_numpy().view(np.uint64) for c in ("ph", "pl"))
    has_parent = rows.column("ph").is_valid().to_numpy(zero_copy_only=False)
    parent = np.full(n, -1, dtype=np.int64)
    found = slots.find(parent_high[first], parent_low[first])
    parent[own] = np.where(has_parent[first], found, -1)

    at = slots.find(high[valued], low[valued])
    if (at < 0).any():
        raise ValueError("a node's value has come to a shard without the node")
    totals = [np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)]
    for total, name in zip(totals, ("leaves", "saved")):
        np.add.at(total, at, rows.column(name).to_numpy()[valued])
    order = np.argsort(depth, kind="stable")[::-1]
    bounds = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, bounds):
        up = level[parent[level] >= 0]
        for total in totals:
            np.add.at(total, parent[up], total[up])
    some = np.flatnonzero((totals[0] != 0) | (totals[1] != 0))
    row = np.empty(n, dtype=np.int64)
    row[own] = first
    taken = rows.select(["h", "l", "ph", "pl"]).take(pa.array(row[some]))
    taken = taken.append_column("top", pa.array(parent[some] < 0))
    for total, name in zip(totals, ("leaves", "saved")):
        taken = taken.append_column(name, pa.array(total[some]))
    return taken


def subtree_sums(rows: DataFrame, nodes: DataFrame, band: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """h, l, leaves, saved: sums over the nodes of each subtree, its top included."""
    deepest = nodes.agg(F.max("band")).first()[0]
    if deepest is None:
        deepest = 0
    shards = -(-rows.count() // shard_rows) + 1
    schema = "h long, l long, ph long, pl long, top boolean, leaves long, saved long"
    shard = F.pmod(F.xxhash64("conv", "band"), F.lit(shards))
    carried, parts = None, []
    values = nodes.select(
        F.col("conv_id").alias("conv"), "band", "h", "l",
        (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    for number in range(deepest, -1, -1):
        own = values.filter(F.col("band") == number)
        if carried is not None:
            own = own.unionByName(carried)
        path = rows.filter(F.col("band") == number).select("conv", "band", "h", "l", "ph", "pl", "depth")
        both = path.withColumn("valued", F.lit(False)).unionByName(
            own.filter("leaves <> 0 or saved <> 0").withColumn("valued", F.lit(True)), allowMissingColumns=True
        )
        both = both.withColumns({"shard": shard, "leaves": F.coalesce("leaves", F.lit(0)), "saved": F.coalesce("saved", F.lit(0))})
        sums = both.drop("conv", "band").groupBy("shard").applyInArrow(_accumulated, schema)
        sums = written(sums, "trie-sums")
        parts.append(sums.select("h", "l", "leaves", "saved"))
        up = sums.filter("top and ph is not null").groupBy(F.col("ph").alias("h"), F.col("pl").alias("l"))
        up = up.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        carried = up.join(nodes.select("h", "l", "conv_id", "band"), ["h", "l"]).withColumnRenamed("conv_id", "conv")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("h", "l").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _joined_ids(rows: DataFrame) -> DataFrame:
    """h, l, ends: SHA-256 of the ids (conv) of every digest, ascending, joined by commas.

    Ranges of (digest, id) write pieces of the list; the pieces of a digest are hashed as a sorted stream.
    """

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        at, first, size = None, None, 0
        out: list[tuple] = []
        for batch in batches:
            for h, l, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (at != (h, l) or size >= PIECE_CHARS):
                    out.append((*at, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    at, first = (h, l), conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if out:
                yield table_of(out)
                out = []
        if held:
            yield table_of([(*at, first, ",".join(held))])

    def table_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["h", "l", "first", "ids"])

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, group in groupby(stream(batches), key=lambda row: row[:2]):
            sha = hashlib.sha256()
            for i, (_, _, _, ids) in enumerate(group):
                sha.update(("," if i else "").encode() + ids.encode())
            out.append((*key, sha.hexdigest()))
            if len(out) == 4096:
                yield ends_of(out)
                out = []
        if out:
            yield ends_of(out)

    def ends_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["h", "l", "ends"])

    ranged = rows.select("h", "l", "conv").repartitionByRange("h", "l", "conv").sortWithinPartitions("h", "l", "conv")
    cut = ranged.mapInArrow(pieces, "h long, l long, first long, ids string")
    return (
        cut.repartition("h", "l").sortWithinPartitions("h", "l", "first").mapInArrow(hashed, "h long, l long, ends string")
    )


def prefix_trie(
    turns: DataFrame,
    head: Column | None = None,
    base: Column | None = None,
    most: int = 0,
    band: int = BAND,
    shard_rows: int = SHARD_ROWS,
    **columns: str,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    With ``head`` and ``base`` (expressions over conv) conversations are rebuilt before: their first ``head``
    turns, at most ``most``, come from conversation ``base``.
    """
    placed = written(placed_turns(turns, **columns), "trie-placed")
    head = F.lit(0) if head is None else head
    base = F.col("conv") if base is None else base
    rows, convs = rebuilt(placed, head, base, most)
    rows = written(prefixes(rows, convs, band), "trie-prefixes")
    nodes = node_table(rows).withColumn("band", F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / band))
    sums = subtree_sums(rows, nodes, band, shard_rows)
    ends = _joined_ids(rows.filter("last"))
    parents = nodes.select(F.col("h").alias("ph"), F.col("l").alias("pl"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(parents, ["ph", "pl"], "left")
        .join(sums, ["h", "l"], "left")
        .join(ends, ["h", "l"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.coalesce("leaves", F.lit(0)).alias("n_leaves"),
            F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
            F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
    )


SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda v, x: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v
    FROM (SELECT unnest(range(0, 256)) AS i))
), c AS (SELECT DISTINCT conv_id FROM conversations),
h AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_concat([4294967295], list_transform(range(1, length(conv_id::VARCHAR) + 1),
      lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda v, x: xor(v >> 8, crc[(xor(v, x) & 255) + 1])), 4294967295) % 6 AS h FROM c, bits
), o AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations GROUP BY conv_id
), r AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h::INT], []), o.turns[h.h::INT + 1:]) AS turns
  FROM h JOIN o USING (conv_id) LEFT JOIN o b ON b.conv_id = h.base
), p AS (SELECT conv_id, d AS depth, turns[1:d::INT] AS prefix, len(turns) = d AS last
  FROM r, unnest(range(0, len(turns) + 1)) AS u(d)),
n AS (
  SELECT prefix, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM p GROUP BY prefix
), k AS (
  SELECT n.prefix, count(ch.prefix) AS n_children FROM n LEFT JOIN n ch ON ch.depth = n.depth + 1
    AND ch.prefix[1:n.depth::INT] = n.prefix GROUP BY 1
), v AS (
  SELECT n.*, k.n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.prefix[n.depth::INT].t) END AS own
  FROM n JOIN k USING (prefix)
), s AS (
  SELECT u.d AS depth, v.prefix[1:u.d::INT] AS prefix, count(*) FILTER (v.n_children = 0) AS n_leaves, sum(v.own) AS saved
  FROM v, unnest(range(0, v.depth + 1)) AS u(d) GROUP BY 1, 2
)
SELECT v.conv_id, v.depth::BIGINT AS depth, CASE WHEN v.depth > 0 THEN q.conv_id END AS parent_conv_id, v.n_convs, v.n_children,
  s.n_leaves, s.saved::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN s ON s.depth = v.depth AND s.prefix = v.prefix
LEFT JOIN v q ON q.depth = v.depth - 1 AND q.prefix = v.prefix[1:q.depth::INT]
"""


@query("op12_prefix_trie", SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    head = F.crc32(conv.cast("string").cast("binary")) % 6
    return prefix_trie(table(spark, sf_dir, "conversations"), head, conv - conv % 100, most=5)
