"""Chat formatting with a compiled template, and reading the formatted text back.

Turns are shuffled by conversation and sorted, and a task renders its conversations turn by
turn from the sorted stream, so its memory is bounded by one part of the output, not by a
conversation. A conversation's text is the concatenation of its parts; each part carries the spans
that the template marked as generation. Control strings inside roles and texts are escaped by a
backslash that reading back takes away.

Defined results: a null role or text counts as empty; a null conversation id is a conversation;
turns are ordered by turn, role and text with nulls first, so repeated rows are repeated turns;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import table
from emberlog.llm.registry import query
from emberlog.llm.template import compile_template

TEMPLATE = (
    "{% for turn in messages %}"
    "{{ '<s>' }}"
    "{% if turn.role == 'assistant' %}"
    "[/INST]{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}"
    "{{ turn.role | escape }}[INST]{{ turn.text | escape }}"
    "{% endif %}"
    "{{ '</s>' }}"
    "{% endfor %}"
)
PART_CHARS = 1 << 20
_SPANS = "array<struct<begin:int,end:int>>"


def escape(text: str) -> str:
    """``text`` without the control strings ``<s> </s> [INST] [/INST]``: a backslash follows the bracket."""
    return re.sub(r"([<\[])(\\*/?(?:s>|INST\]))", r"\1\\\2", text)


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return re.sub(r"([<\[])\\(\\*/?(?:s>|INST\]))", r"\1\2", text)


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterable[tuple], schema: pa.Schema, size_of) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= PART_CHARS or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def format_conversations(
    turns: DataFrame,
    template: str = TEMPLATE,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """conv, part, formatted, spans (begin and end in the part), the parts of a conversation in order."""
    span_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        render = compile_template(template, {"escape": escape, "trim": str.strip, "upper": str.upper})
        for conv, rows in groupby(_cells(batches), key=lambda row: row[0]):
            held, size, spans, number = [], 0, [], 0
            for piece, learned in render(messages=({"role": r or "", "text": t or ""} for _, _, r, t in rows)):
                if learned and piece:
                    spans.append({"begin": size, "end": size + len(piece)})
                held.append(piece)
                size += len(piece)
                if size >= part_chars:
                    yield conv, number, "".join(held), spans
                    held, size, spans, number = [], 0, [], number + 1
            if held or not number:
                yield conv, number, "".join(held), spans

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema(
            [("conv", first.schema.field(0).type), ("part", pa.int32()), ("formatted", pa.string()), ("spans", span_type)]
        )
        yield from _batches(parts(_chained(first, batches)), schema, lambda row: len(row[2]))

    narrow = turns.select(
        F.col(conv_col).alias("_conv"),
        F.col(turn_col).alias("_turn"),
        F.col(role_col).alias("_role"),
        F.col(text_col).alias("_text"),
    )
    kind = dict(narrow.dtypes)["_conv"]
    return (
        narrow.repartition("_conv")
        .sortWithinPartitions("_conv", "_turn", "_role", "_text")
        .mapInArrow(run, f"conv {kind}, part int, formatted string, spans {_SPANS}")
    )


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _turns_of(texts: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Roles and texts, read back from formatted text that arrives in parts."""
    rest = ""
    for text in texts:
        *whole, rest = (rest + text).split("</s>")
        for turn in whole:
            body = turn.removeprefix("<s>")
            if body.startswith("[/INST]"):
                yield "assistant", unescape(body[len("[/INST]") :])
            else:
                role, _, said = body.partition("[INST]")
                yield unescape(role), unescape(said)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: number and digest of the turns, size and digest of what the mask holds, formatted size.

    Takes the parts in the order in which ``format_conversations`` leaves them.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, rows in groupby(_cells(batches), key=lambda row: row[0]):
            n = chars = learned_chars = 0
            turns, learned = hashlib.sha256(), hashlib.sha256()

            def texts(rows=rows, learned=learned) -> Iterator[str]:
                nonlocal chars, learned_chars
                for _, _, text, spans in rows:
                    chars += len(text)
                    for span in spans:
                        said = unescape(text[span["begin"] : span["end"]])
                        learned_chars += len(said)
                        learned.update(said.encode())
                    yield text

            for role, said in _turns_of(texts()):
                n += 1
                turns.update(f"{role}\n{said}\n".encode())
            yield conv, n, turns.hexdigest(), learned_chars, learned.hexdigest(), chars

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema(
            [("conv", first.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string())]
            + [("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        )
        yield from _batches(read(_chained(first, batches)), schema, lambda row: 200)

    kind = dict(formatted.dtypes)["conv"]
    return formatted.mapInArrow(
        run,
        f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g'))
    + CASE WHEN role = 'assistant' THEN 14
      ELSE 13 + length(regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) END AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op7_chat_format", SQL)
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return read_back(format_conversations(turns.unionByName(probe))).withColumnRenamed("conv", "conv_id")
