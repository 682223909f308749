"""The registered queries against their SQL, and reruns of those without."""

from __future__ import annotations

import pytest

from emberlog.llm.queries import ORACLE, QUERIES
from tests.compare import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_one_row_per_document(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    ids = sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
