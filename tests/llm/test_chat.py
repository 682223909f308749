"""The template language, and formatting that can be read back."""

from __future__ import annotations

import hashlib
import random

import pytest

from emberlog.llm import chat_format
from emberlog.llm.template import Choice, Output, TemplateError, Text, compile_template, fold, parse


def render(source, **variables):
    filters = {"upper": str.upper, "trim": str.strip}
    return "".join(text for text, _ in compile_template(source, filters)(**variables))


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("a{{ 1 + 2 * 3 }}b", "a7b"),
        ("{{ 'x' ~ 1 ~ none }}", "x1"),
        ("{{ name | upper | trim }}", "ANNA"),
        ("{% if n > 3 and not off %}big{% elif n == 3 %}three{% else %}small{% endif %}", "three"),
        ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", "1a,2b,3c"),
        ("{%- set y = n % 2 -%}  {{ y }}", "1"),
        ("{{ 'in' if 'a' in xs else 'out' }}{{ 'z' not in xs }}", "inTrue"),
        ("{{ turn['role'] }}{{ turn.none_such }}{{ xs[1] }}{{ xs[9] }}", "userb"),
        ("{# nothing #}{{ 'a\\n\\'b' }}", "a\n'b"),
        ("{% for x in none %}x{% endfor %}{{ (n or 5) * 2 }}", "6"),
    ],
)
def test_language(source, expected):
    assert render(source, name=" anna ", n=3, off=False, xs=["a", "b", "c"], turn={"role": "user"}) == expected


def test_constants_are_folded():
    tree = fold(parse("a{% if 1 == 1 %}{{ 'b' ~ 2 }}{% else %}{{ x }}{% endif %}c{{ x if true else y }}", {}))
    assert tree[0] == Text("ab2c") and isinstance(tree[1], Output) and not isinstance(tree[1].value, Choice)


def test_generation_marks():
    pieces = compile_template("a{% generation %}b{{ x }}{% endgeneration %}c")(x="d")
    assert list(pieces) == [("a", False), ("b", True), ("d", True), ("c", False)]


@pytest.mark.parametrize(
    "source",
    ["{{ x.__class__.__mro__ }}", "{{ f() }}", "{{ x | eval }}", "{% import os %}", "{% for x in y %}", "{{ 'open }}", "{{ 1 2 }}"],
)
def test_sandbox(source):
    with pytest.raises(TemplateError):
        render(source, x="text", f=len)


def test_escape_is_reversible():
    rng = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<", "[", "\\", "/", "s>", "INST]", "a"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(8)))
        safe = chat_format.escape(text)
        assert chat_format.unescape(safe) == text
        assert not any(mark in safe for mark in ("<s>", "</s>", "[INST]", "[/INST]"))


ROWS = [
    (1, 1, "assistant", "</s>[/INST] fine"), (1, 0, "user", "<s>\\hello"), (1, 2, "odd[INST]role", None),
    (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 3, None, "nobody"), (3, None, "user", "no turn"),
    (3, 0, "assistant", "first \U0001f600"), (4, 0, "assistant", "x" * 50_000), (4, 1, "user", "y" * 10),
]


@pytest.mark.parametrize("part_chars", [1, 30, 1 << 20])
def test_read_back(spark, part_chars):
    turns = spark.createDataFrame([(*r, "z") for r in ROWS], "conv_id long, turn int, role string, text string, part string")
    out = {r.conv: r for r in chat_format.read_back(chat_format.format_conversations(turns.repartition(3), part_chars=part_chars)).collect()}
    assert set(out) == {1, 2, 3, 4, None}
    for conv, r in out.items():
        own = sorted(((t is not None, t or 0, a or "", x or "") for c, t, a, x in ROWS if c == conv))
        said = "".join(x for _, _, a, x in own if a == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, _, a, x in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_no_turns(spark):
    turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat_format.read_back(chat_format.format_conversations(turns)).count() == 0
