from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from emberlog.functions import sequences as seq
from emberlog.operators import services as svc
from emberlog.operators import windows as ops
from emberlog.operators.lines import extract_traces, window_key
from tests.test_text import python_hash

START = dt.datetime(2024, 1, 1)


def make_logs(spark, n, seed=0):
    random.seed(seed)
    rows = []
    for i in range(n):
        service = random.choice(["api", "web", "db"])
        node = "hot" if random.random() < 0.5 else random.choice("xy")
        ts = START + dt.timedelta(seconds=random.randint(0, 600))
        rows.append((i, service, node, f"{service}.log", ts, f"text {i} req={i % 5}", f"line {i % 9}", 4 + i % 9, i % 11 == 0))
    random.shuffle(rows)
    schema = (
        "log_id long, service string, node string, filename string, ts timestamp, original_text string, "
        "cleaned_text string, key_id long, is_anomaly boolean"
    )
    return rows, spark.createDataFrame(rows, schema)


def config(spark):
    return svc.with_defaults(
        spark.createDataFrame(
            [("1", "api", True, 40, False, None), ("2", "web", False, 5, True, r"req=(\d+)"), ("3", "db", True, 10**6, True, r"nope=\d")],
            "id string, name string, is_train boolean, max_pretrain int, enable_trace boolean, trace_regex string",
        )
    )


@pytest.mark.parametrize("rows_per_range", [10**6, 60])
def test_train_strategy(spark, rows_per_range):
    rows, logs = make_logs(spark, 500)
    expected, seen = {}, defaultdict(int)
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        seen[r[1]] += 1
        limit = {"api": 40, "db": 10**6}.get(r[1])
        expected[r[0]] = None if limit is None else "pre-train" if seen[r[1]] - 1 <= limit else "finetune"
    got = ops.tag_train_strategy(logs, config(spark), rows_per_range).collect()
    assert {r.log_id: r.train_strategy for r in got} == expected
    given = logs.withColumn("train_strategy", F.when(F.col("log_id") == 3, "finetune"))
    kept = ops.tag_train_strategy(given, config(spark)).filter("log_id = 3").first()
    assert kept.train_strategy == "finetune"


def test_only_the_minute_of_the_cut_is_numbered(spark, monkeypatch):
    rows, logs = make_logs(spark, 500)
    seen = spark.createDataFrame([("api", 30)], "service string, seen long")
    whole = {r.log_id: r.train_strategy for r in ops.tag_train_strategy(logs, config(spark), seen=seen).collect()}
    numbered = []
    number = ops.number_rows

    def counted(df, *args):
        numbered.append(df.count())
        return number(df, *args)

    monkeypatch.setattr(ops, "number_rows", counted)
    got = ops.tag_train_strategy(logs, config(spark), 60, seen).collect()
    assert {r.log_id: r.train_strategy for r in got} == whole
    # two training services over ten minutes, a third of the logs each
    assert sum(numbered) < 100


def test_window_key_falls_back_to_node(spark):
    _, logs = make_logs(spark, 60)
    for r in window_key(extract_traces(logs, config(spark))).collect():
        assert r.key == (str(r.log_id % 5) if r.service == "web" else r.node)


@pytest.mark.parametrize("rows_per_range", [10**6, 60])
@pytest.mark.parametrize("scope", ["key", "service"])
def test_windows_and_chunks(spark, scope, rows_per_range):
    rows, logs = make_logs(spark, 700, seed=3)
    size, context = 32, 12
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        groups[(r[2],) if scope == "key" else (r[1], r[2])].append(r)
    expected = {}
    for key, group in groups.items():
        for w in range(len(group) // size):
            window = group[w * size : (w + 1) * size]
            for c, at in enumerate(range(0, size, context - 2)):
                chunk = window[at : at + context - 2]
                ids = [0, *[r[7] for r in chunk], 1]
                pad = context - len(ids)
                expected["|".join([*key, str(w), str(c)])] = (
                    [r[0] for r in chunk], ids + [2] * pad, [1] * len(ids) + [0] * pad,
                    python_hash("\n".join(r[6] for r in chunk)), chunk[0][1],
                )
    windows = ops.count_windows(logs.withColumn("key", F.col("node")), size, scope, rows_per_range=rows_per_range)
    got = {
        r.chunk_id: ([x.log_id for x in r.original_logs], r.chunk.input_ids, r.chunk.attention_mask, r.hash, r.service)
        for r in ops.chunk_windows(windows, context).collect()
    }
    assert got == expected


def test_default_window_makes_two_chunks(spark):
    logs = spark.range(600).select(
        F.col("id").alias("log_id"), F.lit("k").alias("key"), F.lit("s").alias("service"), F.lit("n").alias("node"),
        F.timestamp_seconds("id").alias("ts"), F.lit("t").alias("cleaned_text"), F.lit(7).alias("key_id"),
    )
    chunks = ops.chunk_windows(ops.count_windows(logs)).orderBy("chunk_no").collect()
    assert [r.n_logs for r in chunks] == [510, 2]
    assert [len(r.chunk.input_ids) for r in chunks] == [512, 512]
    assert [sum(r.chunk.attention_mask) for r in chunks] == [512, 4]
    assert ops.count_windows(logs, emit_partial=True).count() == 2


@pytest.mark.parametrize("rows_per_range", [10**6, 50])
def test_time_sequences(spark, rows_per_range):
    rows, logs = make_logs(spark, 300, seed=4)
    minutes = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        minutes[r[4].replace(second=0)].append(r)
    expected = {
        (m, c): ([r[7] for r in part[c * 8 : c * 8 + 8]], max(r[8] for r in part[c * 8 : c * 8 + 8]))
        for m, part in minutes.items()
        for c in range(-(-len(part) // 8))
    }
    got = ops.time_sequences(logs, "1 minute", 8, rows_per_range).collect()
    assert {(r.timestamp, r.chunk_no): (r.line, r.is_anomaly) for r in got} == expected


@pytest.mark.parametrize("rows_per_range", [10**6, 50])
def test_session_sequences(spark, rows_per_range):
    rows, logs = make_logs(spark, 300, seed=5)
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        groups[r[2]].append(r)
    for first in (None, 20):
        got = ops.session_sequences(logs, "node", first, rows_per_range).collect()
        assert {r.node: r.line for r in got} == {k: [r[7] for r in g][:first] for k, g in groups.items()}
        assert all((r.n_keys, r.is_anomaly) == (len(groups[r.node]), groups[r.node][0][8]) for r in got)
    rows = ops.session_positions(logs, "node", rows_per_range).collect()
    assert sorted(map(tuple, rows)) == sorted((k, i, r[7]) for k, g in groups.items() for i, r in enumerate(g, 1))


def test_truncated_frames(spark):
    df = spark.createDataFrame([(list(range(4, 4 + n)),) for n in (0, 3, 8, 9, 30)], "line array<int>")
    for r in df.select("line", seq.frame_truncated(F.col("line"), 10).alias("ids")).collect():
        full = [0, *r.line, 1]
        assert r.ids == (full[:9] + [1] if len(full) > 10 else full + [2] * (10 - len(full)))


@pytest.mark.parametrize("margin,cut", [(2, 0.8), (1, 0.2)])
def test_prompt_length(spark, margin, cut):
    got = spark.range(60).select("id", seq.prompt_length(F.col("id"), cut, margin).alias("n")).collect()
    for r in got:
        sequence = list(range(r.id))
        start = int(cut * len(sequence) // 1)
        if start < margin:
            prompt = sequence[:margin]
        elif start >= len(sequence) - margin:
            prompt = sequence[:-margin]
        else:
            prompt = sequence[:start]
        assert r.n == len(prompt), r.id


@pytest.mark.parametrize("rows_per_range", [10**6, 50])
def test_windows_of_repeated_ids(spark, rows_per_range):
    """Ids name messages, not rows: logs that share one fill windows as others do, in ranges as well."""
    rows, logs = make_logs(spark, 200)
    twice = logs.unionByName(logs).withColumn("key", F.lit("k"))
    windows = ops.count_windows(twice, 20, scope="key", rows_per_range=rows_per_range).collect()
    assert len(windows) == 20 and all(len(w.logs) == 20 for w in windows)
    ordered = [log for w in sorted(windows, key=lambda w: w.window_no) for log in w.logs]
    assert [log.log_id for log in ordered] == [r[0] for r in sorted(rows, key=lambda r: (r[4], r[0])) for _ in range(2)]


def test_rows_of_sessions_are_made_once(spark, tmp_path):
    """However many steps it takes to number them."""
    calls = tmp_path / "calls"
    calls.touch()

    def named(i):
        with open(calls, "a") as file:
            file.write("x")
        return f"s{i % 2}"

    logs = spark.range(200).select(
        F.udf(named, "string")("id").alias("sid"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("log_id"),
        (F.col("id") % 7).alias("key_id"),
    )
    found = ops.session_positions(logs, "sid", rows_per_range=20).collect()
    assert {(r.sid, r.pos, r.key_id) for r in found} == {(f"s{i % 2}", i // 2 + 1, i % 7) for i in range(200)}
    assert len(calls.read_text()) == 200
