"""The filter audit against a brute-force version, and its merges."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, n int, _id string, part string, _good string, fresh int"
FIELDS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def made_rows():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    texts = [None, "", " \t\n\x0b\x0c\r ", "One #", "é" * 50, "A" * 20, "Aa a", "\x85\xa0 x", "x y " * 30_000]
    for _ in range(40):
        n = rng.choice([20, 99, 100, 101, 150])
        line = [rng.choice(words[: rng.choice([30, 200])]) for _ in range(n)]
        text = " ".join(line) if rng.random() < 0.5 else "\t\n".join(line).upper()
        texts.append(text + rng.choice(["", " $", " |", "  "]))
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(i, rng.choice(texts[:20]), rng.choice(["en", "de", "de"])) for i in range(100, 160)]
    rows += [(7, "hot", "en")] * 30 + [(None, "hot", "en"), (None, "One #", None), (3, "hot", "de")]
    return [(*r, 1, "x", "y", "z", 2) for r in rows]


LABELS = [(i, i % 2, (i // 2) % 2) for i in range(0, 160, 3)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (9999, 1, 1), (7, 1, 0)]


def brute(rows, labels):
    marks = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        if i is not None:
            marks[i] = [max(marks[i][0], quality or 0), max(marks[i][1], toxic or 0)]
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    judged = []
    for i, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > least[text],
        }
        judged.append((lang or "", {f for f in fails if fails[f]}, *(marks[i] if i is not None else (0, 0))))
    out = {}
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                shapley[f] += sum(f in j[1] and not j[1] & set(order[:k]) for j in own)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = [j for j in own if f in j[1] and not j[1] & set(order[:k])]
                out[part, "".join(order), k + 1] = (
                    sum(not j[1] & set(order[: k + 1]) for j in own),
                    len(gone),
                    sum(f in j[1] for j in own) - len(gone),
                    sum(j[1] == {f} for j in own),
                    sum(j[2] == 1 for j in gone),
                    sum(j[3] == 1 for j in gone),
                    shapley[f],
                )
    return out


def test_like_brute_force(spark, monkeypatch):
    rows = made_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    expected = brute(rows, LABELS)
    got = filter_audit.filter_audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[f] for f in FIELDS) for r in got} == expected
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_blocks_of_few_rows(spark):
    """Sums over blocks don't depend on how ids are cut."""
    rows = made_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    judged = filter_audit.judged(docs, labels, filter_audit.default_filters(F.col("_text")))
    names = list("ABCDE")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = filter_audit.subset_sizes(filter_audit.posting_lists(judged, names, 10)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert sorted(small) == sorted(filter_audit.subset_sizes(filter_audit.posting_lists(judged, names)).collect())


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).collect() == []


def test_own_filters(spark):
    docs = spark.createDataFrame([(1, "ab", "x"), (2, "abc", "x"), (3, "abcd", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    filters = {"long": F.length("_text") > 2, "longer": F.length("_text") > 3}
    got = {(r.filter_order, r.step): r for r in filter_audit.filter_audit(docs, labels, filters, repeats=None).collect()}
    assert got["longlonger", 1].removed == 2 and got["longlonger", 2].redundant == 1
    assert got["longerlong", 1].good_lost == 1 and got["longerlong", 2].kept == 1


@pytest.mark.parametrize("run", [1, 3, 256])
def test_merges(run):
    rng = np.random.default_rng(run)
    for _ in range(60):
        one, other = (np.unique(rng.integers(0, 400, rng.integers(0, 300))) for _ in range(2))
        assert (filter_audit.gallop(one, other, run) == np.searchsorted(one, other)).all()
        assert (filter_audit.union(one, other) == np.union1d(one, other)).all()
        assert (filter_audit.difference(one, other) == np.setdiff1d(one, other)).all()
        assert filter_audit.common(one, other) == len(np.intersect1d(one, other))
