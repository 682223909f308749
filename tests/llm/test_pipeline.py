"""The pipeline's stages, each judged on its own input, and the whole run."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from emberlog.llm import bpe_codec, exact_dedup, minhash_dedup, mixing, toxicity
from emberlog.llm.common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").cache()
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    outputs = {}
    for name, stage in corpus_pipeline.STAGES:
        outputs[name] = out = stage(spark, docs, sf_dir).cache()
        if name != "bpe encoding":
            assert out.dtypes == docs.dtypes
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    assert ids(outputs["toxicity"]) == ids(toxicity.score(docs, model).filter("predicted = 0"))
    assert ids(outputs["exact dedup"]) == ids(exact_dedup.exact_duplicates(docs).filter("kept"))
    assert ids(outputs["minhash near-dedup"]) == ids(minhash_dedup.near_duplicates(docs, percent=80).filter("kept"))
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert ids(outputs["mixing sources"]) == copies
    vocabulary = corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")
    expected = {r.doc_id: r.ids for r in bpe_codec.encode(docs, vocabulary).collect()}
    assert {r.doc_id: r.ids for r in outputs["bpe encoding"].collect()} == expected
    docs.unpersist()


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {len(r.ids) == r.n_tokens for r in rows} == {True}
    per_id = Counter(r.doc_id for r in rows)
    assert max(per_id.values()) <= 3
