from __future__ import annotations

import datetime as dt
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from emberlog.functions import text as t
from emberlog.operators import lines as ops
from emberlog.operators.services import clean_text, with_defaults

HDFS = "081109 203615 148 INFO dfs.DataNode$PacketResponder: PacketResponder 1 for block blk_38865049064139660 terminating"
BGL_NORMAL = (
    "- 1117838570 2005.06.03 R02-M1-N0-C:J12-U11 2005-06-03-15.42.50.675872 R02-M1-N0-C:J12-U11 RAS KERNEL INFO "
    "instruction cache parity error corrected"
)
BGL_ALERT = (
    "APPREAD 1117869872 2005.06.04 R04-M1-N4-I:J18-U11 2005-06-04-00.24.32.432192 R04-M1-N4-I:J18-U11 RAS APP FATAL "
    "ciod: failed to read message prefix on control stream (CioStream socket to 172.16.96.116:33569"
)
TBIRD = (
    "- 1131566461 2005.11.09 dn228 Nov 9 12:01:01 dn228/dn228 crond(pam_unix)[2915]: session closed for user root"
)


def lines(spark, *texts):
    return spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "log_id long, line string")


def python_hash(text):
    return str(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big"))


def test_hash64(spark):
    texts = ["abc", "", "é漢字", "x" * 1000]
    got = [r.h for r in lines(spark, *texts).orderBy("log_id").select(t.hash64(F.col("line")).alias("h")).collect()]
    assert got == [python_hash(s) for s in texts]
    assert got[0] == "13436514500253700074"


def test_hdfs_golden(spark):
    row = ops.parse_hdfs(lines(spark, HDFS)).first()
    assert row.block_id == "blk_38865049064139660"
    assert row.line == "NUM NUM NUM INFO dfs.DataNode$PacketResponder: PacketResponder NUM for block BLK terminating"
    assert ops.parse_hdfs(lines(spark, HDFS), templates=True).first().line == HDFS


def test_bgl_golden(spark):
    normal, alert = ops.parse_bgl(lines(spark, BGL_NORMAL, BGL_ALERT)).orderBy("log_id").collect()
    assert normal.line == "IARNUM DATE NODE DT NODE RAS KERNEL INFO instruction cache parity error corrected"
    assert not normal.is_anomaly
    assert normal.timestamp == dt.datetime(2005, 6, 3, 15, 42, 50, 675872)
    assert alert.line == (
        "APPREAD IARNUM DATE NODE DT NODE RAS APP FATAL NODE failed to read message prefix on control stream "
        "(CioStream socket to DATE.NUM:NUM"
    )
    assert alert.is_anomaly


def test_thunderbird_golden(spark):
    row = ops.parse_thunderbird(lines(spark, TBIRD)).first()
    assert row.line == "- IAR DATEdn228 DATEACC crond(pam_unix)NUM: session closed for user root"
    assert not row.is_anomaly
    assert row.timestamp == dt.datetime(2005, 11, 9, 12, 1, 1)


def test_times_with_short_fields(spark):
    rows = lines(spark, "- x 2005-6-3-5.4.5.25 y", "- nothing here").select("log_id", t.bgl_time(F.col("line")).alias("ts"))
    first, second = rows.orderBy("log_id").collect()
    assert first.ts == dt.datetime(2005, 6, 3, 5, 4, 5, 250000)
    assert second.ts is None


@pytest.mark.parametrize("rules", [t.BGL_RULES, t.THUNDERBIRD_RULES, t.HDFS_RULES])
def test_rules_equal_python(spark, rules):
    """The faster forms of the patterns give what ``re.sub`` gives with the plain ones."""
    random.seed(5)
    pieces = [
        "a1:b", "R02-M1", "x-", ":", "-", "a:", ":1", "-a1", "no", "user@host", "user@host-x.y", "a.b@c", ".a@b-c", "@", "a@",
        "12:01:01", "2005.06.03", "/var/log/x", "0xAF12", "[12]", "10.0.0.1:80", "Nov 9", "word", "A1-B2:C3", "f" * 28, "9",
        "a-b:c9", "::", "--1a", "u@v-w@x-y", "a..b@c.d-",
    ]
    texts = [" ".join(random.choices(pieces, k=random.randint(1, 9))) for _ in range(600)]
    texts += ["".join(random.choices("a1:-@. /", k=random.randint(1, 14))) for _ in range(600)]
    got = lines(spark, *texts).orderBy("log_id").select(t.substitute(F.col("line"), rules).alias("x")).collect()
    for text, row in zip(texts, got):
        expected = text
        for pattern, replacement in rules:
            expected = re.sub(pattern, replacement, expected, flags=re.ASCII)
        assert row.x == expected, text


def test_regex_clean_by_service(spark):
    services = with_defaults(
        spark.createDataFrame(
            [("1", "a", [("[0-9]+", "N"), ("N-N", "R")]), ("2", "b", [("x(.)", r"\1y")]), ("3", "c", [])],
            "id string, name string, regex_subs array<struct<pattern:string,replacement:string>>",
        )
    )
    logs = spark.createDataFrame(
        [("a", "12-34 q"), ("b", "xz xq"), ("c", "same 1"), ("unknown", "kept 1")], "service string, original_text string"
    )
    got = {r.service: r.cleaned_text for r in clean_text(services)(logs).collect()}
    assert got == {"a": "R q", "b": "zy qy", "c": "same 1", "unknown": "kept 1"}


def test_java_replacement(spark):
    cases = {r"<\1>": "a1b", r"$\g<1>": "a2b", r"\\x": "a3b", "plain": "a4b"}
    for replacement, text in cases.items():
        got = spark.range(1).select(
            F.regexp_replace(F.lit(text), r"a(\d)", t.java_replacement(replacement)).alias("x")
        ).first().x
        assert got == re.sub(r"a(\d)", replacement, text)
    with pytest.raises(ValueError):
        t.java_replacement(r"\g<name>", r"a(\d)")


RULES = [
    (r"(\d+) b", r"<\1>"),
    (r"(?P<word>[a-z]+)=(?P<n>\d+)", r"\g<n>:\g<word>$1"),
    (r"x(\d)", r"\g<1>0"),
    (r"[()\[](q)", r"\1\\n"),
    (r"\(\?(z)", r"\1"),
    (r"(?:no)(?=t)(t)", r"\1"),
    (r"(?P<c>[uv])(?P=c)", r"double \g<c>"),
]


def test_rules_as_in_python(spark):
    text = "a 12 b(3) key=77 x5 (q [q (?z not uu vu"
    df = spark.range(1).withColumn("line", F.lit(text))
    for pattern, replacement in RULES:
        java, replaced = t.java_rule(pattern, replacement)
        assert len(t.capturing_groups(pattern)) == re.compile(pattern).groups
        assert df.select(F.regexp_replace("line", java, replaced)).first()[0] == re.sub(pattern, replacement, text), pattern


def test_first_match(spark):
    df = lines(spark, "req id=77 id=8", "none")
    rows = df.orderBy("log_id").select(
        t.first_match(F.col("line"), r"id=(\d+)").alias("group"), t.first_match(F.col("line"), r"id=\d+").alias("whole")
    ).collect()
    assert [tuple(r) for r in rows] == [("77", "id=77"), (None, None)]


def test_dashboard_text(spark):
    row = spark.range(1).select(
        t.shorten(F.lit("x" * 801)).alias("cut"), t.shorten(F.lit("x" * 800)).alias("whole"), t.basename(F.lit("/a/b.log")).alias("f")
    ).first()
    assert row.cut == "x" * 800 + "..." and row.whole == "x" * 800 and row.f == "b.log"


def test_words_move_as_numbers(spark):
    """Places and ids of words are gathered as plain numbers, and words are cut in one step; results stay as defined."""
    texts = ["", "  ", "Ab-ab ab", "é2 ß x", None, " ".join(f"w{i}" for i in range(600)), "...a...", "b b b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary = ops.build_vocabulary(df).filter("token_id < 100")
    ids = {r.token: r.token_id for r in vocabulary.collect()}
    found = ops.tokenize(df, vocabulary, "doc_id", length=512)
    for row in found.collect():
        words = [w for w in re.split(r"[\W_]+", (texts[row.doc_id] or "").lower()) if w][:510]
        expected = [2, *[ids.get(w, 1) for w in words], 3]
        assert row.tokens.input_ids == expected + [0] * (512 - len(expected))
        assert sum(row.tokens.attention_mask) == len(expected)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(named_struct" not in plan and "collect_list(CASE WHEN isnotnull(token" in plan
    assert "filter(split" not in plan
