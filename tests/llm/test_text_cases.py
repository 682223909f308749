"""Every operator on documents: nulls, empty and long texts, ties, repeats, no rows, clashing extra columns."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from emberlog.llm import (
    bpe_codec,
    exact_dedup,
    minhash_dedup,
    mixing,
    quality,
    suffix_dedup,
    token_counts,
    toxicity,
)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, _gone int,"
    " _taken_id int, _times int, node long, key string, label int, kept boolean, size int, anchor long"
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def _rows():
    rng = random.Random(4)
    prose = [" ".join(rng.choices(WORDS, k=60)) for _ in range(6)]
    texts = [
        None,
        "",
        " \t\n\x0b\x0c\r ",
        "one two",
        "One TWO",
        "Éa É",
        "éa é",
        "x" * 30_000,
        " ".join(rng.choices(WORDS, k=20_000)),
        prose[0],
        prose[0].upper(),
        prose[0] + " omega",
        prose[1],
        prose[1],
        prose[2] + " " + prose[1],
        "naïve ☃ \U0001f600 <|endoftext|> \x00 end ",
        *prose[3:],
    ]
    rows = [(i, t, "en", f"src{i % 3}" if i % 4 else None) for i, t in enumerate(texts)]
    rows += [(3, "one two", "en", "src0"), (None, "no id at all", None, None), (None, None, None, "src1")]
    return [(*r, None, "x", "y", 1, 2, 3, 4, "k", 0, True, 5, 6) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, 1 - i % 2) for i in range(18)] + [(3, 0, 1), (None, 1, 1), (5, None, None), (999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "mixing": lambda d, _: mixing.mix(d),
    "minhash": lambda d, _: minhash_dedup.near_duplicates(d),
    "quality": lambda d, t: quality.score(d, quality.train(d, t)),
    "tokens": lambda d, _: token_counts.count_tokens(d, VOCABULARY),
    "codec": lambda d, _: bpe_codec.decode(bpe_codec.encode(d, VOCABULARY), VOCABULARY),
    "exact": lambda d, _: exact_dedup.exact_duplicates(d),
    "toxicity": lambda d, t: toxicity.score(d, toxicity.train(d, t)),
    "suffix": lambda d, _: suffix_dedup.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(docs, labels, name):
    out = OPERATORS[name](docs, labels)
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())
    assert ids(out) == ids(docs)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_stages_keep_columns(docs, labels):
    for out in (
        exact_dedup.drop_exact_duplicates(docs),
        minhash_dedup.drop_near_duplicates(docs),
        mixing.take_mix(docs),
        toxicity.drop_toxic(docs, toxicity.train(docs, labels)),
    ):
        assert out.dtypes == docs.dtypes
        out.collect()


def test_exact_groups(docs):
    found = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs).collect()}
    # the null, the empty one, and the null without an id
    assert (found[0].keep_id, found[0].group_size, found[0].kept, found[1].kept) == (1, 3, False, True)
    assert (found[3].keep_id, found[3].group_size) == (4, 3)
    # A-Z only: É and é differ
    assert found[5].kept and found[6].kept and found[5].text_sha256 != found[6].text_sha256
    assert found[10].text_sha256 == hashlib.sha256(_rows()[9][1].encode()).hexdigest()


def test_exact_short_digests(docs):
    """Texts that share a digest are told apart by content."""
    def plain(df):
        return sorted(map(str, df.collect()))

    assert plain(exact_dedup.exact_duplicates(docs, digits=1)) == plain(exact_dedup.exact_duplicates(docs))


def test_codec_round_trip(docs):
    texts = {r[0]: r[1] or "" for r in _rows()}
    out = bpe_codec.decode(bpe_codec.encode(docs, VOCABULARY), VOCABULARY).filter("doc_id is not null").collect()
    assert all(r.decoded == texts[r.doc_id] for r in out)
    ids = {r.doc_id: r.ids for r in out}
    for r in bpe_codec.round_trips(docs, VOCABULARY, keep_ids=True).filter("doc_id is not null").collect():
        assert r.ids == ids[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, VOCABULARY).collect()}
    assert all(counts[r.doc_id] == len(r.ids) for r in out)


def test_decode_special_cases(spark):
    rows = [(1, None), (2, []), (3, [127]), (4, [50256, 50256])]
    encoded = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    out = {r.doc_id: r.decoded for r in bpe_codec.decode(encoded, VOCABULARY).collect()}
    assert out == {1: "", 2: "", 3: "�", 4: "<|endoftext|>" * 2}


def test_mixing_words_and_targets(docs):
    out = mixing.mix(docs).collect()
    by_id = {r[0]: r[1] for r in _rows()}
    for r in out:
        if r.doc_id is not None:
            assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", by_id[r.doc_id] or ""))
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"] and r.target <= 3 * r.source_size


def test_near_empty_sets_are_alone(docs):
    found = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs).collect()}
    for i in (0, 1, 2):
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (0, i, True)
    assert (found[4].n_shingles, found[4].component_id, found[4].kept) == (1, 3, False)
    assert found[10].component_id == found[9].component_id == found[11].component_id == 9


def test_suffix_null_ids_are_last(spark):
    text = " ".join(random.Random(1).choices(WORDS, k=40))
    docs = spark.createDataFrame([(None, text), (5, text + " end"), (None, text)], "doc_id int, text string")
    out = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert out[5, len(text) + 4].spans == [] and out[None, len(text)].spans == [0, len(text)]
    assert dict(suffix_dedup.remove_repeats(docs).dtypes)["doc_id"] == "int"


def test_scores_without_both_classes(docs, labels):
    only = labels.filter("quality = 1")
    rows = quality.score(docs, quality.train(docs, only)).collect()
    assert {r.score for r in rows} == {1.0}
    rows = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()
    assert {r.score for r in rows} == {0.0} and {r.predicted for r in rows} == {0}


def test_held_out_rows(docs, labels):
    out = quality.score(docs, quality.train(docs, labels.limit(0))).filter("doc_id is not null").select("doc_id", "held_out")
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.distinct().collect())


def test_learns_nothing_from_held_out_rows(docs, labels):
    """Labels of held-out rows may say anything."""
    turned = labels.withColumn(
        "quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    scores = lambda t: sorted((r.doc_id or -1, r.score) for r in quality.score(docs, quality.train(docs, t)).collect())
    assert scores(labels) == scores(turned)
