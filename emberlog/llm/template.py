"""A small sandboxed template language, compiled to Python closures.

Text holds ``{{ expression }}`` and ``{% statement %}`` tags; ``{# … #}`` is a comment, and a ``-``
inside a tag strips the white space beside it. Statements: ``for x in e … endfor``,
``if e … elif e … else … endif``, ``set x = e`` and ``generation … endgeneration``, which marks what
a model is to learn. Expressions: strings, whole numbers, true, false, none, names, ``a.b``,
``a['b']``, ``a | filter``, ``+ - * % ~``, comparisons, ``in``, ``not``, ``and``, ``or``,
``a if b else c``. There are no calls, and ``a.b`` only looks up keys of mappings, so a
template reaches nothing but the values and filters it is given.

``compile_template`` parses to a syntax tree, folds constants, and turns the tree into closures
that yield (text, learned) pieces one by one, so that a loop may run over a stream of any length.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

Piece = tuple[str, bool]
Filters = Mapping[str, Callable[[Any], Any]]


class TemplateError(ValueError):
    """The template isn't in the language, or asks for what it may not have."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """An operation on argument expressions; ``pure`` ones of constants are folded."""

    work: Callable[..., Any]
    args: tuple


@dataclass(frozen=True)
class Choice:
    """Short-circuit ``and``, ``or`` and the conditional expression: test, value if true, value if false."""

    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    values: Any
    body: tuple


@dataclass(frozen=True)
class If:
    cases: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


def _lookup(value: Any, key: Any) -> Any:
    if isinstance(value, Mapping):
        return value.get(key)
    if isinstance(value, (list, tuple)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    raise TemplateError(f"cannot look up {key!r} in a {type(value).__name__}")


def _show(value: Any) -> str:
    return "" if value is None else str(value)


_COMPARE = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b,
}
_SUM = {"+": operator.add, "-": operator.sub, "~": lambda a, b: _show(a) + _show(b)}
_PRODUCT = {"*": operator.mul, "%": operator.mod}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_TOKEN = re.compile(
    r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)"""
    r"""|(?P<sign>==|!=|<=|>=|[-+*%~<>=|.\[\]()])|(?P<end>$))""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str, filters: Filters):
        self.filters, self.tokens, at = filters, [], 0
        while True:
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((found.lastgroup, found.group(found.lastgroup)))
            if found.lastgroup == "end":
                break
            at = found.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        kind, value = self.tokens[self.at]
        if kind in ("name", "sign") and value in wanted:
            self.at += 1
            return value
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"expected {wanted!r}, found {self.tokens[self.at][1]!r}")

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name":
            raise TemplateError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def whole(self) -> Any:
        value = self.choice()
        self.finish()
        return value

    def finish(self) -> None:
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def choice(self) -> Any:
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Choice(test, value, self.choice())
        return value

    def either(self) -> Any:
        value = self.both()
        while self.take("or"):
            value = Choice(value, value, self.both())
        return value

    def both(self) -> Any:
        value = self.negation()
        while self.take("and"):
            value = Choice(value, self.negation(), value)
        return value

    def negation(self) -> Any:
        return Apply(operator.not_, (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Any:
        value = self.sum()
        while True:
            if sign := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
                value = Apply(_COMPARE[sign], (value, self.sum()))
            elif self.tokens[self.at][1] == "not" and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                value = Apply(_COMPARE["not in"], (value, self.sum()))
            else:
                return value

    def sum(self) -> Any:
        value = self.product()
        while sign := self.take("+", "-", "~"):
            value = Apply(_SUM[sign], (value, self.product()))
        return value

    def product(self) -> Any:
        value = self.suffixed()
        while sign := self.take("*", "%"):
            value = Apply(_PRODUCT[sign], (value, self.suffixed()))
        return value

    def suffixed(self) -> Any:
        value = self.atom()
        while sign := self.take(".", "[", "|"):
            if sign == ".":
                value = Apply(_lookup, (value, Const(self.name())))
            elif sign == "[":
                value = Apply(_lookup, (value, self.choice()))
                self.need("]")
            else:
                name = self.name()
                if name not in self.filters:
                    raise TemplateError(f"unknown filter {name!r}")
                value = Apply(self.filters[name], (value,))
        return value

    def atom(self) -> Any:
        kind, value = self.tokens[self.at]
        if self.take("("):
            inner = self.choice()
            self.need(")")
            return inner
        self.at += 1
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(value))
        if kind == "name":
            return Const(_WORDS[value]) if value in _WORDS else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str, filters: Filters) -> tuple:
    """The syntax tree of a template."""
    source = re.sub(r"\{#.*?#\}", "", source, flags=re.S)
    parts = re.split(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\})", source, flags=re.S)
    for i in range(1, len(parts), 2):
        if parts[i][2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3] == "-":
            parts[i + 1] = parts[i + 1].lstrip()
    items = [(i % 2, part) for i, part in enumerate(parts) if part]
    at = 0

    def block(*ends: str) -> tuple[tuple, str, _Expression | None]:
        nonlocal at
        body: list = []
        while at < len(items):
            is_tag, part = items[at]
            at += 1
            if not is_tag:
                body.append(Text(part))
                continue
            inner = _Expression(part[2:-2].removeprefix("-").removesuffix("-"), filters)
            if part.startswith("{{"):
                body.append(Output(inner.whole()))
                continue
            word = inner.name()
            if word in ends:
                return tuple(body), word, inner
            if word == "for":
                name = inner.name()
                inner.need("in")
                values = inner.whole()
                body.append(For(name, values, block("endfor")[0]))
            elif word == "if":
                cases, test = [], inner.whole()
                while True:
                    inside, end, rest = block("elif", "else", "endif")
                    cases.append((test, inside))
                    if end == "endif":
                        break
                    test = rest.whole() if end == "elif" else Const(True)
                body.append(If(tuple(cases)))
            elif word == "set":
                name = inner.name()
                inner.need("=")
                body.append(Assign(name, inner.whole()))
            elif word == "generation":
                inner.finish()
                body.append(Generation(block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown statement {word!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]!r}")
        return tuple(body), "", None

    return block()[0]


def fold(node: Any) -> Any:
    """The same tree with constant expressions evaluated, dead branches cut and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for child in map(fold, node):
            children = child if isinstance(child, tuple) else (child,)
            for c in children:
                if isinstance(c, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + c.text)
                elif c != Text(""):
                    out.append(c)
        return tuple(out)
    if isinstance(node, Apply):
        args = tuple(map(fold, node.args))
        if all(isinstance(a, Const) for a in args):
            return Const(node.work(*(a.value for a in args)))
        return Apply(node.work, args)
    if isinstance(node, Choice):
        test, yes, no = fold(node.test), fold(node.yes), fold(node.no)
        return (yes if test.value else no) if isinstance(test, Const) else Choice(test, yes, no)
    if isinstance(node, Output):
        value = fold(node.value)
        return Text(_show(value.value)) if isinstance(value, Const) else Output(value)
    if isinstance(node, For):
        values = fold(node.values)
        return () if isinstance(values, Const) and not values.value else For(node.name, values, fold(node.body))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        cases = []
        for test, body in node.cases:
            test = fold(test)
            if isinstance(test, Const) and not test.value:
                continue
            cases.append((test, fold(body)))
            if isinstance(test, Const):
                break
        if cases and isinstance(cases[0][0], Const):
            return cases[0][1]
        return If(tuple(cases)) if cases else ()
    return node


def _value(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        constant = node.value
        return lambda env: constant
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Choice):
        test, yes, no = _value(node.test), _value(node.yes), _value(node.no)
        return lambda env: yes(env) if test(env) else no(env)
    work, args = node.work, [_value(a) for a in node.args]
    if len(args) == 1:
        only = args[0]
        return lambda env: work(only(env))
    left, right = args
    return lambda env: work(left(env), right(env))


def _steps(values: Iterable) -> Iterator[tuple[dict, Any]]:
    """Each value with its ``loop`` facts; one value is read ahead to know the last."""
    values = iter(values)
    nothing = object()
    now, index = next(values, nothing), 0
    while now is not nothing:
        following = next(values, nothing)
        yield {"index": index + 1, "index0": index, "first": index == 0, "last": following is nothing}, now
        now, index = following, index + 1


def _body(nodes: tuple) -> Callable[[dict, bool], Iterator[Piece]]:
    parts = [_statement(n) for n in nodes]

    def run(env: dict, learned: bool) -> Iterator[Piece]:
        for part in parts:
            yield from part(env, learned)

    return run


def _statement(node: Any) -> Callable[[dict, bool], Iterator[Piece]]:
    if isinstance(node, Text):
        text = node.text
        return lambda env, learned: ((text, learned),)
    if isinstance(node, Output):
        value = _value(node.value)
        return lambda env, learned: ((_show(value(env)), learned),)
    if isinstance(node, Generation):
        body = _body(node.body)
        return lambda env, learned: body(env, True)
    if isinstance(node, Assign):
        name, value = node.name, _value(node.value)

        def assign(env: dict, learned: bool) -> tuple:
            env[name] = value(env)
            return ()

        return assign
    if isinstance(node, If):
        cases = [(_value(test), _body(body)) for test, body in node.cases]

        def branch(env: dict, learned: bool) -> Iterable[Piece]:
            for test, body in cases:
                if test(env):
                    return body(env, learned)
            return ()

        return branch
    name, values, body = node.name, _value(node.values), _body(node.body)

    def loop(env: dict, learned: bool) -> Iterator[Piece]:
        for facts, value in _steps(values(env) or ()):
            yield from body({**env, name: value, "loop": facts}, learned)

    return loop


def compile_template(source: str, filters: Filters | None = None) -> Callable[..., Iterator[Piece]]:
    """A function of the template's variables that yields (text, learned) pieces."""
    body = _body(fold(parse(source, filters or {})))
    return lambda **variables: body(dict(variables), False)
