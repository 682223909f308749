"""Control messages, repeated deliveries, silent sources and verdicts over time."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from emberlog.operators import services as svc
from emberlog.sources.tables import PartTable
from emberlog.streaming import control
from emberlog.streaming.ensemble import POLICY, deliver_once, final_verdicts, watermark_policy, windows_of_sources

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def message(i, text="a 1", service="web"):
    ts = (START + dt.timedelta(seconds=i)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return json.dumps({"log_id": i, "service": service, "node": "n", "filename": "f", "ts": ts, "original_text": text})


def topic(spark, messages):
    return spark.createDataFrame([(m, i) for i, m in enumerate(messages)], "value string, position long")


def services(spark):
    subs = "array<struct<pattern:string,replacement:string>>"
    made = [("1", "web", [("[0-9]+", "NUM")], 1.5), ("2", "api", [], 2.5)]
    return svc.with_defaults(spark.createDataFrame(made, f"id string, name string, regex_subs {subs}, threshold double"))


@pytest.fixture
def stream(spark, tmp_path):
    seen = PartTable(spark, str(tmp_path / "seen"))

    def judge(logs, state, batch_id):
        threshold = state.services.select(F.col("name").alias("service"), "threshold")
        n_marks = state.marked.count()
        rows = logs.join(threshold, "service").withColumns({"n_marks": F.lit(n_marks), "version": F.lit(state.model_version).cast("int")})
        seen.write(rows.select("log_id", "service", "threshold", "n_marks", "version"), batch_id)

    return control.ControlStream(spark, str(tmp_path / "control"), services(spark), judge), seen


def facts(table, number):
    return sorted(tuple(r) for r in table._read([number]).collect())


def test_controls_hold_from_their_batch_on(spark, stream):
    made, seen = stream
    change = lambda service, **config: json.dumps({"kind": "config-change", "service": service, "config": config})
    mark = json.dumps({"kind": "mark-normal", "service": "web", "hash": "7", "cleaned_text": "a NUM"})
    batches = [
        ([message(0), message(1, service="api")], []),
        ([message(2), "{broken"], [change("web", threshold=9.0, top_k=3), change("web", threshold=8.0), "not json", mark, mark]),
        ([message(3), message(4, service="api")], [json.dumps({"kind": "model-update", "version": n}) for n in (3, 2)]),
        ([message(5)], [json.dumps({"kind": "model-update"}), change("no such service", threshold=1.0)]),
    ]
    merged = [control.merged(topic(spark, logs), topic(spark, controls)) for logs, controls in batches]
    for number, messages in enumerate(merged):
        made.process(messages, number)
    expected = [
        [(0, "web", 1.5, 0, None), (1, "api", 2.5, 0, None)],
        [(2, "web", 8.0, 1, None)],
        [(3, "web", 8.0, 1, 2), (4, "api", 2.5, 1, 2)],
        [(5, "web", 8.0, 1, 2)],
    ]
    assert [facts(seen, n) for n in range(4)] == expected
    assert made.state(3).services.filter("name = 'web'").first().top_k == 3
    # batches that run again find what they found before, though later controls have come since
    for number in (1, 0, 2):
        made.process(merged[number], number)
        assert facts(seen, number) == expected[number]


def logs(spark, rows):
    df = spark.createDataFrame(rows, "log_id long, second long, node string")
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("second"))).drop("second")


def run(stream, out, state):
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", out)
    query = writer.option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def test_copies_are_dropped_within_the_delay(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    steps = [[(1, 0, "a"), (1, 0, "a"), (2, 5, "a")], [(2, 5, "a"), (3, 60, "a"), (2, 5, "b")], [(3, 60, "a"), (4, 61, "a")]]
    for step in steps:
        logs(spark, step).coalesce(1).write.mode("append").parquet(source)
        records = spark.readStream.schema("log_id long, node string, ts timestamp").parquet(source)
        run(deliver_once(records, ("log_id", "node"), "1 minute"), out, state)
    found = [(r.log_id, r.node) for r in spark.read.parquet(out).collect()]
    assert sorted(found) == [(1, "a"), (2, "a"), (2, "b"), (3, "a"), (4, "a")]


@pytest.mark.parametrize("slowest", [True, False])
def test_silent_source(spark, tmp_path, slowest):
    """The furthest source closes windows of a silent one; under the other policy it holds them open."""
    sources, out, state = [str(tmp_path / n) for n in "ab"], str(tmp_path / "out"), str(tmp_path / "state")
    steps = [[(1, 0, "a"), (2, 1, "b")], [(3, 60, "a")], [(4, 120, "a")]]
    before = spark.conf.get(POLICY)
    for step in steps:
        for source, node in zip(sources, "ab"):
            logs(spark, [r for r in step if r[2] == node] or [(0, 0, "x")]).filter("node <> 'x'").write.mode("append").parquet(source)
        streams = [spark.readStream.schema("log_id long, node string, ts timestamp").parquet(s) for s in sources]
        with watermark_policy(spark, slowest):
            run(windows_of_sources([s.withColumn("key", F.col("node")) for s in streams]), out, state)
    assert spark.conf.get(POLICY) == before
    closed = {(r.key, r.n_logs, r.first_ts.minute) for r in spark.read.parquet(out).collect()}
    base = dt.datetime.fromtimestamp(1_700_000_000).minute
    expected = {("a", 1, base), ("b", 1, base), ("a", 1, base + 1)}
    assert closed == (set() if slowest else expected)


def test_final_verdicts(spark, tmp_path):
    lines, sequences, out, state = (str(tmp_path / n) for n in ("lines", "sequences", "out", "state"))
    bad = {1, 2, 5}
    schema = "original_logs array<struct<log_id:long,ts:timestamp>>, is_anomaly boolean"

    def step(line_rows, chunks):
        made = logs(spark, [(i, s, "n") for i, s in line_rows]).withColumn("is_anomaly", F.col("log_id").isin(bad)).drop("node")
        made.write.mode("append").parquet(lines)
        at = lambda s: dt.datetime.fromtimestamp(1_700_000_000 + s)
        rows = [([(i, at(s)) for i, s in chunk], flag) for chunk, flag in chunks]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(sequences)
        left = spark.readStream.schema("log_id long, ts timestamp, is_anomaly boolean").parquet(lines)
        right = spark.readStream.schema(schema).parquet(sequences)
        with watermark_policy(spark, slowest=True):
            run(final_verdicts(left, right, "1 minute"), out, state)

    step([(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)], [])
    step([(6, 30)], [([(1, 0), (3, 2)], True), ([(2, 1), (4, 3)], False)])
    assert {(r.log_id, r.verdict) for r in spark.read.parquet(out).collect()} == {(1, "confirmed"), (2, "refuted"), (3, "added")}
    step([(7, 200)], [([(7, 200)], False)])
    assert {(r.log_id, r.verdict) for r in spark.read.parquet(out).collect()} == {
        (1, "confirmed"), (2, "refuted"), (3, "added"), (5, "unconfirmed")
    }
