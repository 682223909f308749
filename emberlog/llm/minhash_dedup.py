"""Near duplicates by min-max hashing, banding, and confirmation on full shingle sets.

Words are lower-cased (A-Z) runs between white space; a text's set holds its distinct five-word
shingles as 64-bit hashes. Each permutation of the hash values keeps both its smallest and its
largest value over the set: two estimators for the price of one evaluation, whose errors partly
cancel. The values are cut into bands; texts that share a band are candidates. With 25 bands of
5 values a link at the threshold of 0.85 escapes all bands with a probability of 4e-7.

A group of near copies may hold a third of all rows, so no bucket is ever paired with itself:

1. Texts with equal sets are one class, represented once.
2. Every class of a bucket is compared with one pivot of the bucket, the class that meets most others.
   Links that this confirms make components. A few rounds compare the classes outside the pivot's
   component with other members of it that meet many.
3. Buckets whose classes are still in several components are searched for further links between
   components: small ones (32 classes at most) pair by pair; the classes of larger ones join on
   shared rare shingles. By the prefix principle, two sets can only be similar enough if they
   share one of their first shingles in a common order; the order takes rare shingles first, by
   a sketch of counts of bounded size. This filter loses no link.
4. Pairs are confirmed on full sets, 100 * intersection >= 85 * union, in streams sorted by one
   partner and salted, and the components are closed over all links.

Defined results: a null text or one without words has an empty set and is linked with nothing;
rows that repeat an id are documents of their own, and a component's id is the smallest id in it;
a component without ids has a null id, and rows without an id are kept only in such a component;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import mix, one_row_each, row_keyed, seeds, table
from emberlog.llm.components import connected_components
from emberlog.llm.registry import query
from emberlog.llm.shingles import WORDS, shingle_runs, shingle_sets
from emberlog.operators.joins import sized
from emberlog.session import written

BANDS, ROWS = 25, 5
PERCENT = 85
SMALL_BUCKET = 32
PAIRS_PER_STREAM = 128
SKETCH = 1 << 16
EXTRA_STARS = 1


def signatures(x: np.ndarray, before: np.ndarray, values: int) -> np.ndarray:
    """Min-max signatures, one row per text: half of the values are minima, the others maxima of the same permutations.

    ``before`` holds the number of shingles before each text; every text has one at least.
    """
    half = -(-values // 2)
    factor, shift = seeds(half, 5 << 40) | np.uint64(1), seeds(half, 6 << 40)
    out = np.empty((len(before) - 1, 2 * half), dtype=np.uint64)
    for k in range(half):
        permuted = x * factor[k] + shift[k]
        out[:, 2 * k] = np.minimum.reduceat(permuted, before[:-1])
        out[:, 2 * k + 1] = np.maximum.reduceat(permuted, before[:-1])
    return out[:, :values]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, different in every band."""
    parts = signature.reshape(len(signature), bands, rows)
    weight = seeds(rows, 8 << 40) | np.uint64(1)
    keys = seeds(bands, 9 << 40)[None, :].repeat(len(parts), axis=0)
    for r in range(rows):
        keys = mix(keys + mix(parts[:, :, r]) * weight[r])
    return keys


def _node(members: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketched(
    docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, words: int, row_col: str | None = None
) -> DataFrame:
    """_id, _n (size of the set), _node (name of the set), _bands (keys), and _row (``row_col``) if that is given.

    Node and bands are null for empty sets.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x, before in shingle_runs(batch.column(1), words):
                n_texts = len(before) - 1
                full = np.flatnonzero(np.diff(before))
                sizes = np.zeros(n_texts, dtype=np.int64)
                nodes: list = [None] * n_texts
                for i in full:
                    members = np.unique(x[before[i] : before[i + 1]])
                    sizes[i], nodes[i] = len(members), _node(members)
                keys: list = [None] * n_texts
                if len(full):
                    found = band_keys(signatures(x, np.append(before[full], before[-1]), bands * rows), bands, rows)
                    for i, own in zip(full, found.view(np.int64)):
                        keys[i] = own
                columns = [
                    batch.column(0).slice(row, n_texts),
                    pa.array(sizes),
                    pa.array(nodes, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ]
                names = ["_id", "_n", "_node", "_bands"]
                if row_col:
                    columns.append(batch.column(2).slice(row, n_texts))
                    names.append("_row")
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = dict(docs.dtypes)
    narrow = [F.col(id_col).alias("_id"), F.col(text_col).alias("_text")]
    schema = f"_id {kinds[id_col]}, _n long, _node long, _bands array<long>"
    if row_col:
        narrow.append(F.col(row_col).alias("_row"))
        schema += f", _row {kinds[row_col]}"
    return docs.select(*narrow).mapInArrow(run, schema)


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """node and its set as bytes for every node of ``wanted`` (node, _rep: the id of one of its rows)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = list(shingle_sets(batch.column(0).slice(at, 256), words))
                names = [_node(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "members"]
                )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    chosen = rows.join(sized(wanted.select("_rep")), F.col("_id").eqNullSafe(F.col("_rep")), "left_semi")
    sets = written(chosen.select("_text").mapInArrow(run, "node long, members binary"), "near-sets")
    # an id or a text that occurs in several rows gives sets that nobody asked for, or one twice
    if sets.count() != wanted.count():
        sets = written(
            sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "near-sets"
        )
    return sets


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    per_a = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_STREAM).alias("_streams"))
    salted = pairs.join(per_a, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("_streams"))).drop("_streams")
    salted = written(salted, "near-pairs")
    # sets are dealt by their name at every size; whether pairs may be broadcast would depend on their number
    firsts = salted.select("a", "salt").distinct().hint("merge").join(sets, F.col("a") == F.col("node"))
    seconds = salted.hint("merge").join(sets, F.col("b") == F.col("node"))
    streams = (
        firsts.select("a", "salt", F.lit(None).cast("long").alias("b"), "members")
        .unionByName(seconds.select("a", "salt", "b", "members"))
        .repartition("a", "salt")
        .sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros(0, np.uint64)
        for batch in batches:
            out_a, out_b = [], []
            for a, b, members in zip(batch.column(0), batch.column(1), batch.column(2)):
                found = np.frombuffer(members.as_buffer(), dtype=np.uint64)
                if not b.is_valid:
                    first = found.copy()
                    continue
                small, large = sorted((len(first), len(found)))
                if 100 * small < percent * large:
                    continue
                both = np.sort(np.concatenate([first, found]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= percent * (small + large - shared):
                    out_a.append(a.as_py())
                    out_b.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return streams.select("a", "b", "members").mapInArrow(run, "a long, b long")


def _size_classes(largest: int) -> np.ndarray:
    """Lower bounds of set size classes, each about 3 % wide."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 103 // 100)))
    return np.array(bounds)


def _prefix_pairs(dense: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``dense`` (node, comp) from different components that may be similar enough."""
    rows = written(dense.join(sets, "node"), "near-dense")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for members in batch.column(0):
                found = np.frombuffer(members.as_buffer(), dtype=np.uint64)
                counts += np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], ["slot", "n"])

    counted = rows.select("members").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # at most SKETCH rows, whatever the input
    sketch = np.zeros(SKETCH, dtype=np.int64)
    for slot, n in counted.collect():
        sketch[slot] = n
    rarity = rows.sparkSession.sparkContext.broadcast(sketch)

    def least_shared(a: int, b: int) -> int:
        """Shingles that sets of these sizes must share: intersection >= percent / (100 + percent) of both sizes."""
        return -(-percent * (a + b) // (100 + percent))

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = rarity.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                posts: list[tuple] = []
                for node, comp, members in zip(*(part.column(i) for i in range(3))):
                    found = np.frombuffer(members.as_buffer(), dtype=np.uint64)
                    n = len(found)
                    ranked = found[np.lexsort((found, order[(found & np.uint64(SKETCH - 1)).astype(np.int64)]))]
                    bounds = _size_classes(n)
                    smallest = -(-percent * n // 100)
                    own = int(np.searchsorted(bounds, n, side="right")) - 1
                    low = int(np.searchsorted(bounds, smallest, side="right")) - 1
                    # as the smaller partner under its own class, as the larger one under all classes below
                    lists = [(own, False, n - least_shared(n, n) + 1)]
                    for c in range(low, own + 1):
                        lists.append((c, True, n - least_shared(n, max(int(bounds[c]), smallest)) + 1))
                    for size_class, larger, length in lists:
                        head = ranked[:length].view(np.int64)
                        posts.append((head, size_class, larger, n - np.arange(len(head)), node.as_py(), comp.as_py(), n))
                lengths = [len(p[0]) for p in posts]

                def column(i: int, kind=np.int64, posts=posts, lengths=lengths) -> pa.Array:
                    return pa.array(np.repeat(np.array([p[i] for p in posts], dtype=kind), lengths))

                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([p[0] for p in posts])),
                        column(1, np.int32),
                        column(2, bool),
                        pa.array(np.concatenate([p[3] for p in posts]).astype(np.int32)),
                        column(4),
                        column(5),
                        column(6, np.int32),
                    ],
                    ["shingle", "size_class", "larger", "rest", "node", "comp", "n"],
                )

    schema = "shingle long, size_class int, larger boolean, rest int, node long, comp long, n int"
    posts = rows.select("node", "comp", "members").mapInArrow(post, schema)
    key = ["shingle", "size_class"]
    meeting = (
        posts.groupBy(*key)
        .agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count_if("larger").alias("_of"),
             F.count(F.lit(1)).alias("_all"))
        .filter("_low <> _high and _of > 0 and _of < _all")
        .select(*key)
    )
    posts = written(posts.join(meeting, key, "left_semi"), "near-posts")
    small = posts.filter("not larger").select(
        *key, F.col("node").alias("a"), F.col("comp").alias("comp_a"), F.col("n").alias("n_a"),
        F.col("rest").alias("rest_a"),
    )
    large = posts.filter("larger").select(
        *key, F.col("node").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"),
        F.col("rest").alias("rest_b"),
    )
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    # what follows a shared shingle in both orders must still hold enough shingles
    needed = (100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("n_a") + F.col("n_b"))
    met = small.join(large, key).filter((F.col("comp_a") != F.col("comp_b")) & ordered & needed)
    return met.select("a", "b").distinct()


def _with_pivots(met: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (node, key, _size) of shared buckets with their node's rank ``_company`` and the bucket's pivot.

    The pivot is the class that meets most others over all of its buckets: an original is nearer to its
    copies than these are to each other. Copies decide among equals.
    """
    company = met.groupBy("node").agg(F.sum("_size").alias("_met"))
    # fewer than 2^20 copies count exactly, which is enough to decide among equals
    rank = F.col("_met") * (1 << 20) + F.least(F.col("_copies"), F.lit((1 << 20) - 1))
    ranked = written(company.join(classes.select("node", "_copies"), "node").select("node", rank.alias("_company")), "near-rank")
    rows = met.join(ranked, "node")
    pivots = rows.groupBy("key").agg(F.max_by("node", "_company").alias("pivot"), F.max("_company").alias("_lead"))
    return rows.join(pivots, "key")


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"_{side}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def _further_stars(buckets: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, round_no: int) -> DataFrame:
    """Links between components, found by comparing the classes of an open bucket with another member of its main component.

    The main component of a bucket is that of its pivot; the member is one of those that meet most
    others, another one in every round.
    """
    labelled = buckets.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    labelled = written(labelled, "near-labelled")
    main = labelled.filter("node = pivot").select("key", F.col("comp").alias("_main"))
    rows = labelled.join(main, "key")
    outside = rows.filter("comp <> _main").select("key", "node")
    open_keys = outside.select("key").distinct()
    # a different order of the members in every round
    turn = F.pmod(F.xxhash64("node", F.lit(round_no)), F.lit(1 << 10)) if round_no else F.lit(0)
    hubs = (
        rows.filter("comp = _main and node <> pivot")
        .join(open_keys, "key", "left_semi")
        .groupBy("key")
        .agg(F.max_by("node", F.col("_company") + F.col("_company") * turn / (1 << 10)).alias("hub"))
    )
    stars = outside.join(hubs, "key").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    return written(_confirmed(stars, sets, percent), "near-links")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    words: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    small_bucket: int = SMALL_BUCKET,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Links join texts with 100 * intersection >= ``percent`` * union of their sets; ``bands`` and
    ``rows`` must let such pairs meet almost surely.
    """
    result = _decided(docs, id_col, text_col, percent, words, bands, rows, small_bucket)
    return result.select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_shingles"),
        "component_id",
        F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _decided(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    percent: int = PERCENT,
    words: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    small_bucket: int = SMALL_BUCKET,
    row_col: str | None = None,
) -> DataFrame:
    """_id, _n, label (names a component, null for empty sets) and component_id of every row, and _row if asked for."""
    sketched = written(_sketched(docs, id_col, text_col, bands, rows, words, row_col), "near-sketches")
    classes = written(
        sketched.filter("_node is not null")
        .groupBy(F.col("_node").alias("node"))
        .agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies"), F.first("_bands").alias("_bands")),
        "near-classes",
    )
    members = classes.select("node", F.explode("_bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    # one plan at every size: a broadcast that ends somewhere makes the shuffles jump there
    buckets = written(members.hint("merge").join(shared, "key"), "near-met")
    buckets = written(_with_pivots(buckets, classes), "near-buckets")
    wanted = written(
        classes.select("node", "_rep").join(buckets.select("node").distinct(), "node", "left_semi"), "near-wanted"
    )
    sets = _full_sets(docs, wanted, id_col, text_col, words)

    stars = buckets.filter("node <> pivot").groupBy(F.col("pivot").alias("a"), F.col("node").alias("b"))
    stars = written(stars.agg(F.max("_lead").alias("_lead")), "near-stars")
    # first one pivot for every class, the one that meets most; others only where that leaves two components
    best = stars.groupBy("b").agg(F.max_by("a", "_lead").alias("a")).select("a", "b")
    links = written(_confirmed(best, sets, percent), "near-links")
    labels = connected_components(links)
    links = written(links.unionByName(_confirmed(_between(stars.join(best, ["a", "b"], "left_anti"), labels), sets, percent)), "near-links")
    labels = connected_components(links)
    for round_no in range(EXTRA_STARS):
        more = _further_stars(buckets, labels, sets, percent, round_no)
        if not more.limit(1).count():
            break
        links = written(links.unionByName(more), "near-links")
        labels = connected_components(links)

    labelled = buckets.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    labelled = written(labelled, "near-labelled")
    several = (
        labelled.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).filter("_low <> _high")
    )
    still_open = written(labelled.join(several.select("key"), "key", "left_semi"), "near-open")
    few = still_open.filter((F.col("_size") <= small_bucket) & (F.col("node") != F.col("pivot")))
    left = few.select("key", F.col("node").alias("a"), F.col("comp").alias("comp_a"))
    right = few.select("key", F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    within = (
        left.join(right, "key")
        .filter((F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")))
        .select("a", "b")
        .distinct()
    )
    dense = still_open.filter(F.col("_size") > small_bucket).select("node", "comp").distinct()
    further = within.unionByName(_prefix_pairs(dense, sets, percent)).distinct()
    more = written(_confirmed(further, sets, percent), "near-links")
    if more.limit(1).count():
        labels = connected_components(links.unionByName(more))

    named = classes.select("node", "_rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = written(named, "near-named")
    smallest = named.groupBy("label").agg(F.min("_rep").alias("component_id"))
    component = named.join(smallest, "label").select(F.col("node").alias("_node"), "label", "component_id")
    result = sketched.drop("_bands").join(component, "_node", "left")
    alone = F.col("_node").isNull()
    return result.withColumn("component_id", F.when(alone, F.col("_id")).otherwise(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of ``docs``: one with the smallest id, whatever ids are null or repeat; columns stay.

    Rows without words are components of their own.
    """
    keyed, key = row_keyed(docs)
    decided = _decided(keyed, id_col, text_col, row_col=key, **options)
    kept = F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")
    return one_row_each(keyed, key, decided.select("_row", F.col("label").alias("_group"), kept))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words]
    ELSE list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4]) END) AS shingle FROM w
), h AS (SELECT doc_id, hash(shingle) AS x, shingle FROM s),
n AS (SELECT doc_id, count(*) AS size FROM h GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM h a JOIN h b ON a.x = b.x AND a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * shared >= 85 * (na.size + nb.size - shared)
), r AS (
  SELECT doc_id AS node, doc_id AS reached FROM documents
  UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached
)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT node AS doc_id, min(reached) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""


@query("op2_minhash_dedup", SQL)
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
