"""Column functions over log text: hashing, cleaning, dates, traces, dashboard cells."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cleaning patterns of the three public log corpora, applied in this order.
HDFS_BLOCK = r"blk_-?\d+"
HDFS_RULES = [
    (HDFS_BLOCK, "BLK"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{1,5})?", "IP"),
    (r"\d*\d", "NUM"),
]
BGL_TIME = r"\d{1,4}\-\d{1,2}\-\d{1,2}-\d{1,2}.\d{1,2}.\d{1,2}.\d{1,6}"
BGL_RULES = [
    (r"^- ", ""),
    (BGL_TIME, "DT"),
    (r"\d{1,4}\.\d{1,2}\.\d{1,2}", "DATE"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{1,5})?", "IP"),
    (r"\S+(?=.*[0-9])(?=.*[a-zA-Z])(?=[:]+)\S+", "NODE"),
    (r"\S+(?=.*[0-9])(?=.*[a-zA-Z])(?=[-])\S+", "NODE"),
    (r"[A-Z0-9]{28}", "ECID"),
    (r"[a-zA-Z0-9]{48}", "SERIAL"),
    (r"0[xX][0-9a-fA-F]\S+", "MEM"),
    (r".\S+(?=.[0-9a-zA-Z])(?=[/]).\S+", "PATH"),
    (r"[0-9a-fA-F]{8}", "IAR"),
    (r"(\d+)", "NUM"),
]
THUNDERBIRD_DATE = r"\d{2,4}\.\d{1,2}\.\d{1,2}\s"
THUNDERBIRD_TIME = r"\d{1,2}\:\d{1,2}\:\d{1,2}"
THUNDERBIRD_RULES = [
    (THUNDERBIRD_DATE, "DATE"),
    (
        r"(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?"
        r"|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+(\d{1,2})\s+",
        "DATE",
    ),
    (THUNDERBIRD_TIME, "TIME"),
    (r"DATE\s.*\sDATE", "ID"),
    (r"(\w+[\w\.]*)@(\w+[\w\.]*)\-(\w+[\w\.]*)", "ACC"),
    (r"(\w+[\w\.]*)@(\w+[\w\.]*)", "ACC"),
    (r"TIME\s\S+", "ACC"),
    (r"[a-zA-Z0-9_\-\.\/]+\/[a-zA-Z0-9_\-\.\/]+\/[a-zA-Z0-9_\-\.\/]*", "DIR"),
    (r"\/[a-zA-Z0-9_\-\.\/]+\/[a-zA-Z0-9_\-\.\/]*", "DIR"),
    (r"[0-9a-fA-F]{10}", "IAR"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{1,5})?", "IP"),
    (r"(\[\d+\])", "NUM"),
]
NORMAL_PREFIX = "- "

# Patterns above that backtrack over a whole run of characters from each of its positions,
# and ones with the same matches that do not: the test for one character comes before the
# tests that scan the line, and a run is tried from its first position only.
FASTER = {
    r"\S+(?=.*[0-9])(?=.*[a-zA-Z])(?=[:]+)\S+": r"\S+(?=:)(?=.*[0-9])(?=.*[a-zA-Z])\S+",
    r"\S+(?=.*[0-9])(?=.*[a-zA-Z])(?=[-])\S+": r"\S+(?=-)(?=.*[0-9])(?=.*[a-zA-Z])\S+",
    r"(\w+[\w\.]*)@(\w+[\w\.]*)\-(\w+[\w\.]*)": r"(?<!\w)\w[\w\.]*@\w[\w\.]*-\w[\w\.]*",
    r"(\w+[\w\.]*)@(\w+[\w\.]*)": r"(?<!\w)\w[\w\.]*@\w[\w\.]*",
}


def hash64(text: Column) -> Column:
    """First 64 bits of SHA-256 as an unsigned decimal string."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10)


def substitute(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) rules in order, each to the previous output."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, FASTER.get(pattern, pattern), replacement)
    return text


def substitute_by_column(text: Column, rules: Column) -> Column:
    """The same for rules held in an ``array<struct<pattern,replacement>>`` column."""
    return F.aggregate(rules, text, lambda acc, r: F.regexp_replace(acc, r["pattern"], r["replacement"]))


def capturing_groups(pattern: str) -> list[str | None]:
    """Name, or None, of every capturing group of a regular expression, by its syntax alone."""
    groups: list[str | None] = []
    i, in_class = 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            quoted = pattern.startswith("\\Q", i) and not in_class
            end = pattern.find("\\E", i) if quoted else -1
            i = (len(pattern) if end < 0 else end + 2) if quoted else i + 2
            continue
        if c == "[":
            # a bracket right after the opening one, or its negation, is a plain character in Python's dialect
            in_class += 1
            i += 2 if pattern.startswith("^", i + 1) else 1
            if in_class == 1 and pattern.startswith("]", i):
                i += 1
            continue
        if c == "]" and in_class:
            in_class -= 1
        elif c == "(" and not in_class:
            named = re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:])
            if named or not pattern.startswith("(?", i):
                groups.append(named.group(1) if named else None)
        i += 1
    return groups


def java_pattern(pattern: str) -> str:
    """A pattern as Java reads it: named groups become plain ones and references to them numbers."""
    names = capturing_groups(pattern)
    number = {name: str(i) for i, name in enumerate(names, 1) if name}
    pattern = re.sub(r"(?<!\\)\(\?P=(\w+)\)", lambda m: f"(?:\\{number.get(m[1], m[1])})", pattern)
    pattern = re.sub(r"(?<!\\)\\k<(\w+)>", lambda m: f"(?:\\{number.get(m[1], m[1])})", pattern)
    return FASTER.get(pattern, re.sub(r"(?<!\\)\(\?P?<([A-Za-z_]\w*)>", "(", pattern))


def java_replacement(replacement: str, pattern: str = "") -> str:
    r"""Translate a ``re.sub`` replacement (``\1``, ``\g<1>``, ``\g<name>``) to Spark's ``$1`` form.

    ``$`` is an ordinary character before and after; ``pattern`` tells the numbers of named groups.
    """
    out, i, names = [], 0, capturing_groups(pattern)
    while i < len(replacement):
        group = re.match(r"\\(?:(\d{1,2})|g<(\w+)>)", replacement[i:])
        if group:
            name = group.group(1) or group.group(2)
            if not name.isdigit() and name not in names:
                raise ValueError(f"unknown group in replacement {replacement!r}")
            out.append(f"${int(name) if name.isdigit() else names.index(name) + 1}")
            i += group.end()
            if replacement[i : i + 1].isdigit():
                # a digit after the reference isn't part of its number
                out.append("\\" + replacement[i])
                i += 1
        elif replacement.startswith("\\\\", i):
            out.append("\\\\")
            i += 2
        elif replacement[i : i + 2] in ("\\n", "\\t", "\\r"):
            out.append({"n": "\n", "t": "\t", "r": "\r"}[replacement[i + 1]])
            i += 2
        elif replacement[i] in "$\\":
            out.append("\\" + replacement[i])
            i += 1
        else:
            out.append(replacement[i])
            i += 1
    return "".join(out)


def java_rule(pattern: str | None, replacement: str | None) -> tuple[str | None, str | None]:
    """A rule of a service configuration, ready for ``regexp_replace``."""
    if pattern is None:
        return None, replacement
    return java_pattern(pattern), java_replacement(replacement or "", pattern)


def trace_group(pattern: str) -> int:
    """What ``re.findall`` returns of a match: the first group if there is one, else all of it."""
    return 1 if capturing_groups(pattern) else 0


def first_match(text: Column, pattern: str) -> Column:
    """First match, as ``re.findall`` would give it: the group if there is one; NULL if none."""
    pattern, index = java_pattern(pattern), trace_group(pattern)
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, index))


def first_match_by_column(text: Column, pattern: Column, index: Column) -> Column:
    """The same for a translated pattern and its group held in columns; NULL patterns match nothing."""
    return F.when(F.regexp_like(text, pattern), F.call_function("regexp_extract", text, pattern, index))


def is_alert(line: Column) -> Column:
    """Lines of the alert corpora are normal when they start with ``- ``."""
    return ~F.startswith(line, F.lit(NORMAL_PREFIX))


def hdfs_block(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, f"({HDFS_BLOCK})", 1), F.lit(""))


def bgl_time(line: Column) -> Column:
    stamp = F.regexp_extract(line, f"({BGL_TIME})", 1)
    # the fraction has one to six digits
    fraction = "".join(f"[.{'S' * n}]" for n in range(6, 0, -1))
    return F.try_to_timestamp(stamp, F.lit(f"yyyy-M-d-H.m.s{fraction}"))


def thunderbird_time(line: Column) -> Column:
    date = F.trim(F.regexp_extract(line, f"({THUNDERBIRD_DATE})", 1))
    time = F.regexp_extract(line, f"({THUNDERBIRD_TIME})", 1)
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("yyyy.M.d H:m:s"))


def mask_digit_tokens(text: Column) -> Column:
    """Template of a line: every blank-separated token that holds a digit becomes ``<*>``."""
    return F.regexp_replace(text, r"[^ ]*[0-9][^ ]*", "<*>")


def shorten(text: Column, limit: int = 800) -> Column:
    """Cell text: at most ``limit`` characters, then an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
