from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.detectors import RetrievalDetector
from emberlog.operators import embeddings as emb
from emberlog.operators import retrieval as ops
from emberlog.plans.retrieval import core_set_hashed, halves

SCHEMA = "service string, hash string, cls array<double>, tokens array<array<double>>, k int"


def vectors(spark, n, seed, clusters=None, dim=6):
    """Half of the vectors belong to one service; on demand they sit in tight clusters."""
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((clusters or 1, dim)) * 5
    rows = []
    for i in range(n):
        x = rng.standard_normal(dim) if clusters is None else centers[rng.integers(clusters)] + rng.standard_normal(dim) * 0.05
        service = "hot" if rng.random() < 0.6 else ["a", "b"][rng.integers(2)]
        tokens = rng.standard_normal((1 + i % 4, dim))
        rows.append((service, f"{seed}-{i:04d}", [float(v) for v in x], [[float(v) for v in t] for t in tokens], 1 + i % 3))
    return rows, spark.createDataFrame(rows, SCHEMA)


def brute_force(queries, points, metric, k=None):
    out = {}
    for service, qid, q, _, own_k in queries:
        q = np.array(q)
        near = []
        for other, pid, p, _, _ in points:
            if other == service:
                p = np.array(p)
                d = 1 - q @ p / np.linalg.norm(q) / np.linalg.norm(p) if metric == "cosine" else np.linalg.norm(q - p)
                near.append((round(float(d), 9), pid))
        out[qid] = [pid for _, pid in sorted(near)[: k or own_k]]
    return {q: ids for q, ids in out.items() if ids}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("clusters", [None, 6])
@pytest.mark.parametrize("block_rows", [1000, 100, 12])
def test_nearest_points_is_exact(spark, metric, clusters, block_rows):
    q_rows, q = vectors(spark, 60, 1, clusters)
    p_rows, p = vectors(spark, 240, 2, clusters)
    found = {}
    for r in ops.nearest_points(q, p, "k", metric, block_rows=block_rows).orderBy("q_id", "rank").collect():
        found.setdefault(r.q_id, []).append(r.p_id)
    assert found == brute_force(q_rows, p_rows, metric)


def test_candidate_blocks_prune(spark):
    """Tight clusters: most pairs of blocks are never compared."""
    _, q = vectors(spark, 300, 3, 12)
    _, p = vectors(spark, 900, 4, 12)
    as_vec = lambda df: df.select("service", F.col("hash").alias("id"), F.col("cls").alias("vec"), F.lit(2).cast("long").alias("k"))
    from emberlog.session import written

    qb = written(ops._blocked(as_vec(q), "service", 20), "q")
    pb = written(ops._blocked(as_vec(p), "service", 20), "p")
    kept = ops._candidate_blocks(qb, pb, "service").count()
    n = lambda df: {r.service: r.n for r in df.groupBy("service").agg(F.count_distinct("block").alias("n")).collect()}
    nq, np_ = n(qb), n(pb)
    assert kept < 0.5 * sum(nq[s] * np_[s] for s in nq)


def test_k_larger_than_the_store(spark):
    q_rows, q = vectors(spark, 30, 5)
    p_rows, p = vectors(spark, 40, 6)
    got = ops.nearest_points(q, p, 500, block_rows=8).groupBy("q_id").count().collect()
    assert {r.q_id: r["count"] for r in got} == {k: len(v) for k, v in brute_force(q_rows, p_rows, "cosine", 500).items()}


def test_maxsim_golden(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 1.0]])], "q array<array<double>>, t array<array<double>>")
    assert df.select(ops.maxsim_distance("q", "t").alias("d")).first().d == pytest.approx(1 - 2**0.5)


@pytest.mark.parametrize("drop_first", [False, True])
def test_scores(spark, drop_first):
    q_rows, q = vectors(spark, 40, 7)
    p_rows, p = vectors(spark, 80, 8)
    tokens = {r[1]: np.array(r[3]) for r in q_rows + p_rows}
    core = brute_force(q_rows, p_rows, "euclidean", 3)

    def distance(a, b):
        cos = a @ b.T / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        return 1 - cos.max(axis=1).sum()

    expected = {
        qid: min(distance(tokens[qid], tokens[pid]) for pid in ids[1 if drop_first else 0 :]) for qid, ids in core.items()
    }
    got = ops.score_lines(q, p, 3, "euclidean", drop_first).collect()
    assert {r.hash: r.score for r in got} == pytest.approx(expected)
    for r in got:
        assert r.score_per_token == pytest.approx((r.score - 1) / r.n_tokens + 1)


def test_core_set_size():
    assert [ops.core_set_size(n) for n in (1, 250, 350, 1000)] == [2, 2, 4, 10]


def test_known_and_training_lines(spark):
    logs = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "service string, hash string")
    store = spark.createDataFrame([("a", "1")], "service string, hash string")
    assert {tuple(r) for r in ops.unknown_lines(logs, store).collect()} == {("a", "2"), ("b", "1")}
    services = spark.createDataFrame([("a", True), ("b", False)], "name string, is_train boolean")
    training, judged = ops.split_training(logs, services)
    assert training.count() == 2 and judged.count() == 1


def test_embedding_cache_embeds_only_misses(spark):
    lines = spark.createDataFrame([("1", "alpha beta"), ("2", "gamma"), ("2", "gamma")], "hash string, cleaned_text string")
    cache = spark.createDataFrame([("1", [9.0], [[9.0]])], "hash string, cls array<double>, tokens array<array<double>>")
    vectors_, added = emb.embed_cached(lines, cache, lambda df: emb.embed_trigrams(df, dim=4))
    assert [r.hash for r in added.collect()] == ["2"]
    assert {r.hash: r.cls for r in vectors_.collect()}["1"] == [9.0]


def test_trigram_vectors(spark):
    row = emb.embed_trigrams(spark.createDataFrame([("Ab c!",)], "cleaned_text string"), dim=8).first()
    slot = lambda a, b, c: (ord(a) * 961 + ord(b) * 31 + ord(c)) % 8
    expected = []
    for token in ("ab", "c"):
        v, framed = [0.0] * 8, f"#{token}#"
        for i in range(len(token)):
            v[slot(*framed[i : i + 3])] += 1
        expected.append(v)
    assert row.tokens == expected
    assert row.cls == [a + b for a, b in zip(*expected)]


def test_user_encoder_and_word_vectors(spark):
    lines = spark.createDataFrame([("1", "disk full"), ("2", "disk ok")], "hash string, cleaned_text string")
    encode = lambda texts: ([[float(len(t))] for t in texts], [[[1.0], [2.0]] for _ in texts])
    got = {r.hash: (r.cls, r.tokens) for r in emb.embed_with(lines, encode).collect()}
    assert got == {"1": ([9.0], [[1.0], [2.0]]), "2": ([7.0], [[1.0], [2.0]])}
    model = emb.fit_word_vectors(lines, dim=4)
    rows = emb.embed_words(lines, model, "hash").collect()
    assert all(len(r.cls) == 4 and len(r.tokens) == 2 for r in rows)
    unseen = spark.createDataFrame([("3", "never seen"), ("4", None), ("5", "disk seen")], "hash string, cleaned_text string")
    found = {r.hash: (any(r.cls), len(r.tokens)) for r in emb.embed_words(unseen, model, "hash").collect()}
    assert found == {"3": (False, 0), "4": (False, 0), "5": (True, 1)}
    assert emb.fit_word_vectors(lines, dim=4, max_words=2).getVectors().count() == 1


def test_detector_scores_unseen_lines_higher(spark):
    normal = spark.createDataFrame([(f"worker {w} finished job quickly",) for w in "abcdefgh"], "cleaned_text string")
    test = spark.createDataFrame(
        [("worker z finished job quickly",), ("worker z finished job quickly",), ("kernel panic: unknown opcode",)],
        "cleaned_text string",
    )
    rows = RetrievalDetector().fit(normal).transform(test).collect()
    by_text = {r.cleaned_text: r.score_per_token for r in rows}
    assert len(rows) == 3
    assert by_text["kernel panic: unknown opcode"] > by_text["worker z finished job quickly"]


def test_hashed_neighbours_are_close(spark):
    _, q = vectors(spark, 20, 9, 4)
    _, p = vectors(spark, 60, 10, 4)
    for r in ops.nearest_points_lsh(q, p, 2, radius=2.0, bucket_length=4.0).collect():
        assert 0 <= r.distance <= 2


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_recall_of_the_hashed_core_set(spark, sf):
    """The registered query's settings find at least nine in ten of the exact neighbours."""
    sf_dir = f"/root/testdata/sf{sf}"
    exact = ops.nearest_points(*halves(spark, sf_dir), 2).select("service", "q_id", "p_id").collect()
    hashed = core_set_hashed(spark, sf_dir).select("service", "q_id", "p_id").collect()
    assert exact and len(set(exact) & set(hashed)) >= 0.9 * len(exact)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_more_vectors_make_larger_blocks(spark, monkeypatch, metric):
    """Blocks of eight would meet in 47,000 pairs; equal vectors in several blocks are ranked by id."""
    q_rows, q = vectors(spark, 1000, 11)
    p_rows, _ = vectors(spark, 1200, 12)
    p_rows = [(s, f"{copy}{pid}", v, t, k) for copy in "ba" for s, pid, v, t, k in p_rows]
    seen, candidates = [], ops._candidate_blocks

    def counted(*args):
        pairs = candidates(*args)
        seen.append((pairs.count(), args[0].groupBy("service", "block").count().count()))
        return pairs

    monkeypatch.setattr(ops, "_candidate_blocks", counted)
    found = {}
    nearest = ops.nearest_points(q, spark.createDataFrame(p_rows, SCHEMA), "k", metric, block_rows=8)
    for r in nearest.orderBy("q_id", "rank").collect():
        found.setdefault(r.q_id, []).append(r.p_id)
    assert found == brute_force(q_rows, p_rows, metric)
    pairs, blocks = seen[0]
    assert blocks < 200 and pairs < 20_000


def test_long_core_sets_are_held_in_parts(spark, monkeypatch):
    """Few queries per task where each keeps many points; no pair of blocks hands on more than the nearest."""
    q_rows, q = vectors(spark, 100, 13)
    p_rows, p = vectors(spark, 300, 14)
    monkeypatch.setattr(ops, "BEST_ENTRIES", 200, raising=False)
    sizes, meeting = [], ops._met

    def measured(queries, *args):
        sizes.append(queries.groupBy("service", "meet").count().agg({"count": "max"}).first()[0])
        out = meeting(queries, *args)
        assert out.count() <= 40 * queries.count()
        return out

    monkeypatch.setattr(ops, "_met", measured)
    found = {}
    for r in ops.nearest_points(q, p, 40, "euclidean", block_rows=30).orderBy("q_id", "rank").collect():
        found.setdefault(r.q_id, []).append(r.p_id)
    assert found == brute_force(q_rows, p_rows, "euclidean", 40)
    assert sizes[0] <= 15


def test_hashed_search_moves_no_pairs(spark, monkeypatch):
    """All vectors share their buckets: the nearest are exact, and a table hands on k per query."""
    q_rows, q = vectors(spark, 80, 15)
    p_rows, p = vectors(spark, 200, 16)
    handed, meeting = [], ops._met

    def counted(*args):
        out = meeting(*args)
        handed.append(out.count())
        return out

    monkeypatch.setattr(ops, "_met", counted)
    found = {}
    for r in ops.nearest_points_lsh(q, p, 3, radius=3.0, bucket_length=1000.0).orderBy("q_id", "rank").collect():
        found.setdefault(r.q_id, []).append(r.p_id)
    assert found == brute_force(q_rows, p_rows, "cosine", 3)
    assert 0 < handed[0] <= 4 * 3 * 80


def test_trigram_slots_are_worked_out_once_per_token(spark):
    """Counting a slot doesn't repeat the work on the token's characters; letters beyond ASCII count as code points."""
    lines = spark.createDataFrame([("Öl ab", 1), ("", 2), (None, 3)], "cleaned_text string, n int")
    embedded = emb.embed_trigrams(lines, dim=8)
    assert "filter(transform(" not in embedded._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.n: r for r in embedded.collect()}
    slot = (ord("#") * 961 + ord("ö") * 31 + ord("l")) % 8
    assert rows[1].tokens[0][slot] >= 1 and sum(rows[1].cls) == 4 and rows[1].cls == [a + b for a, b in zip(*rows[1].tokens)]
    assert (rows[2].tokens, rows[2].cls) == ([], [0.0] * 8) and rows[3].tokens is None and rows[3].cls is None
