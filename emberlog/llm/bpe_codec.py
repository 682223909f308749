"""BPE encoding and decoding with forced boundaries.

Two bytes that never stand side by side inside any token of the vocabulary can't be joined by any
merge, so a text may be cut between them before anything is merged. Each piece of the
pre-tokenisation is cut at these places, the fragments are encoded independently, and their ids
are concatenated. Ids of pieces and fragments are remembered in tables of bounded size.

Defined results: a null or empty text has no ids and decodes to the empty text; a special string
of the vocabulary inside a text is its one id, and is decoded as its string; a null list of ids
decodes to the empty text; bytes that aren't UTF-8 decode to U+FFFD; an id that the vocabulary
lacks is an error; rows, null ids and repeated ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.byte_bpe import ByteBPE, load
from emberlog.llm.common import table
from emberlog.llm.registry import query

REMEMBERED = 150_000
REMEMBERED_CHARS = 64


def joined_pairs(bpe: ByteBPE) -> frozenset[int]:
    """256 * a + b for the bytes a, b that stand side by side inside some token."""
    return frozenset(a << 8 | b for token in bpe.spell.values() for a, b in zip(token, token[1:]))


def fragments(piece: bytes, joined: frozenset[int]) -> list[bytes]:
    """The piece, cut wherever no token can reach across."""
    cuts = [i for i, (a, b) in enumerate(zip(piece, piece[1:]), 1) if a << 8 | b not in joined]
    if not cuts:
        return [piece]
    return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)])]


def merge(fragment: bytes, bpe: ByteBPE) -> tuple[int, ...]:
    """Token ids of one fragment: lowest rank first, leftmost first among equals."""
    ids = [bpe.first[b] for b in fragment]
    if len(ids) <= 64:
        rank_of, never = bpe.rank_of.get, len(bpe.merged)
        ranks = [rank_of(p, never) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            ids[i] = bpe.merged[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), never)
        return tuple(ids)
    # flat arrays and one number per queued pair, rank before place: some 60 bytes for each byte of a long run
    n, rank_of, pair_of = len(ids), bpe.rank_of.get, bpe.pair_of
    alive, right, left = array("i", ids), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    queue = [rank << 32 | i for i in range(n - 1) if (rank := rank_of((ids[i], ids[i + 1]))) is not None]
    del ids
    heapify(queue)
    while queue:
        rank, i = divmod(heappop(queue), 1 << 32)
        a, b = pair_of[rank]
        j = right[i]
        if alive[i] != a or j >= n or alive[j] != b:
            continue
        alive[i], alive[j] = bpe.merged[rank], -1
        right[i] = k = right[j]
        h = left[i]
        if k < n:
            left[k] = i
            if (found := rank_of((alive[i], alive[k]))) is not None:
                heappush(queue, found << 32 | i)
        if h >= 0 and (found := rank_of((alive[h], alive[i]))) is not None:
            heappush(queue, found << 32 | h)
    return tuple(x for x in alive if x >= 0)


class _Pieces(dict):
    """Ids of pieces, made on first use from the ids of their fragments.

    A full table becomes the older one, which is asked before anything is merged again.
    """

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe, self.joined, self.older, self.parts = bpe, joined_pairs(bpe), {}, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        out = self.older.get(piece)
        if out is None:
            parts = fragments(piece.encode(), self.joined)
            out = merge(parts[0], self.bpe) if len(parts) == 1 else tuple(chain.from_iterable(map(self.part, parts)))
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out

    def part(self, fragment: bytes) -> tuple[int, ...]:
        found = self.parts.get(fragment)
        if found is None:
            found = merge(fragment, self.bpe)
            if len(fragment) <= REMEMBERED_CHARS:
                if len(self.parts) >= REMEMBERED:
                    self.parts.clear()
                self.parts[fragment] = found
        return found


def _vocabulary(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def _ids_of(texts: pa.Array, pieces: _Pieces) -> list[np.ndarray]:
    """Ids of every text of an Arrow column."""
    bpe, out = pieces.bpe, []
    for text in texts:
        found: list[int] = []
        for n, segment in enumerate(bpe.segments(text.as_py() or "")):
            if n % 2:
                found.append(bpe.special[segment])
            else:
                found.extend(chain.from_iterable(map(pieces.__getitem__, bpe.find(segment))))
        out.append(np.array(found, dtype=np.int32))
    return out


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most some hundred rows, to hold some millions of ids at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` (array of int) of every row."""
    content = _vocabulary(docs, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(load(content.value))
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(_ids_of(batch.column(1), pieces))], ["_id", "_ids"])

    kind = dict(docs.dtypes)[id_col]
    return _narrow(docs, id_col, text_col).mapInArrow(run, f"_id {kind}, _ids array<int>").toDF(id_col, "ids")


def spelling(bpe: ByteBPE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes one after the other, and begin and length by id; a missing id has length -1."""
    size = max(bpe.spell) + 1
    length = np.full(size, -1, dtype=np.int64)
    for i, token in bpe.spell.items():
        length[i] = len(token)
    begin = np.concatenate([[0], np.cumsum(np.maximum(length, 0))[:-1]])
    return np.frombuffer(b"".join(bpe.spell[i] for i in sorted(bpe.spell)), dtype=np.uint8), begin, length


def decode_ids(ids: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> str:
    data, begin, length = tables
    if len(ids) == 0:
        return ""
    if ids.min() < 0 or ids.max() >= len(length) or (length[ids] < 0).any():
        raise ValueError("the vocabulary lacks an id")
    sizes = length[ids]
    ends = np.cumsum(sizes)
    at = np.repeat(begin[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
    return data[at].tobytes().decode("utf-8", errors="replace")


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and the text of its ids as ``text_col``."""
    content = _vocabulary(encoded, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = spelling(load(content.value))
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            values = lists.values.to_numpy(zero_copy_only=False)
            bounds = lists.offsets.to_numpy()
            texts = [
                decode_ids(values[a:b], tables) if ok else ""
                for a, b, ok in zip(bounds, bounds[1:], lists.is_valid().to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col]
            )

    fields = ", ".join(f"`{name}` {kind}" for name, kind in encoded.dtypes)
    return encoded.mapInArrow(run, f"{fields}, `{text_col}` string")


def round_trips(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every row, and its ids if asked for.

    ``encode`` and ``decode`` in one pass, without the ids and texts going through the JVM in between.
    """
    content = _vocabulary(docs, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(content.value)
        pieces, tables = _Pieces(bpe), spelling(bpe)
        written_as = [str(i) for i in range(len(tables[1]))]
        for batch in _slices(batches):
            ids = _ids_of(batch.column(1), pieces)
            decimals = [",".join(map(written_as.__getitem__, x.tolist())) for x in ids]
            columns = [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decimals]),
                pa.array([hashlib.sha256(decode_ids(x, tables).encode()).hexdigest() for x in ids]),
            ]
            names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(_lists(ids))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return _narrow(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


@query("op4_bpe_codec")
def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
