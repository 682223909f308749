"""Token counts by byte-pair merging with a heap over a linked list.

A piece of text starts as one symbol per byte. The lowest-rank adjacent pair is popped from a
heap and merged until none is left; the count is the number of bytes less the number of merges,
and no token is ever written down. Counts of pieces are remembered in a table of bounded size.

Defined results: a null or empty text has no bytes and no tokens; a very long text is counted piece by
piece, and a piece without any place to cut takes some 60 bytes of memory a byte; every special string of the
vocabulary that occurs in a text is one token; rows, null ids and repeated ids are kept as they
are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.byte_bpe import ByteBPE, load
from emberlog.llm.common import table
from emberlog.llm.registry import query

REMEMBERED = 200_000
REMEMBERED_CHARS = 64
LIMIT = 1024
PLACE = (1 << 32) - 1


def merged_count(piece: bytes, bpe: ByteBPE) -> int:
    """Number of tokens of one piece."""
    symbol = [bpe.first[b] for b in piece]
    n, rank_of, pair_of, merged = len(symbol), bpe.rank_of.get, bpe.pair_of, bpe.merged
    # one number per pair, its rank before its place
    heap = [rank << 32 | i for i in range(n - 1) if (rank := rank_of((symbol[i], symbol[i + 1]))) is not None]
    after, before = range(1, n + 1), range(-1, n - 1)
    if n <= 64:
        after, before = list(after), list(before)
    else:
        # flat arrays: some 60 bytes for each byte of a long run
        symbol, after, before = array("i", symbol), array("i", after), array("i", before)
    heapify(heap)
    merges = 0
    while heap:
        entry = heappop(heap)
        rank, i = entry >> 32, entry & PLACE
        left, right = pair_of[rank]
        j = after[i]
        # a pair that has changed since it was pushed has other symbols; -1 marks a swallowed one
        if symbol[i] != left or j >= n or symbol[j] != right:
            continue
        symbol[i], symbol[j] = merged[rank], -1
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (found := rank_of((symbol[i], symbol[k]))) is not None:
                heappush(heap, found << 32 | i)
        h = before[i]
        if h >= 0 and (found := rank_of((symbol[h], symbol[i]))) is not None:
            heappush(heap, found << 32 | h)
    return n - merges


class _Counts(dict):
    """Counts of pieces, made on first use."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> int:
        count = merged_count(piece.encode(), self.bpe)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = count
        return count


def count_tokens(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row; ``vocabulary`` is the path of a byte-level BPE file."""
    content = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(content.value)
        counts = _Counts(bpe)
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                sizes.append(len(text.encode()))
                parts = bpe.segments(text)
                n = len(parts) // 2
                for part in parts[::2]:
                    n += sum(map(counts.__getitem__, bpe.find(part)))
                tokens.append(n)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_bytes", "_tokens"])

    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counted = narrow.mapInArrow(run, f"_id {kind}, _bytes long, _tokens long")
    return counted.select(
        F.col("_id").alias(id_col),
        F.col("_bytes").alias("n_bytes"),
        F.col("_tokens").alias("n_tokens"),
        (F.col("_tokens") > limit).alias("over_limit"),
    )


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
