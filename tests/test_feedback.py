from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberlog.operators import feedback as ops
from emberlog.operators.lines import dashboard_rows
from emberlog.plans import catalog, streams, views
from emberlog.plans.feed import Predictions

T0 = dt.datetime(2024, 1, 1, 12)
LOG = "struct<log_id:long,service:string,node:string,filename:string,ts:timestamp,original_text:string>"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def line(i, minute, anomalous, service="api", node="n1"):
    return (str(i), "rapid", f"h{i}", service, node, f"/var/{service}.log", at(minute), f"text {i}", anomalous)


@pytest.fixture(scope="module")
def predictions(spark):
    lines = spark.createDataFrame(
        [line(1, 5, True), line(2, 1, False), line(3, 9, True)],
        "id string, type string, hash string, service string, node string, filename string, ts timestamp, "
        "original_text string, is_anomaly boolean",
    )
    logs = [(10, "web", "n2", "b.log", at(0), "first"), (11, "api", "n1", "a.log", at(2), "second"), (12, "api", "n2", "b.log", at(7), "third")]
    sequences = spark.createDataFrame(
        [("s1", "log_gpt", "hs", "wrong", True, None, logs), ("s2", "log_gpt", "ht", "api", False, "pre-train", logs[1:2])],
        f"id string, type string, hash string, service string, is_anomaly boolean, train_strategy string, original_logs array<{LOG}>",
    )
    return lines, sequences


def test_routes_and_feed(predictions):
    lines, sequences = ops.route_lines(predictions[0]), ops.route_sequences(predictions[1])
    assert {r.id for r in lines.collect()} == {"1", "3"}
    assert {(r.id, r.service, r.train_strategy, r.prompt_user) for r in sequences.collect()} == {
        ("s1", "web", "ignore", True), ("s2", "api", "pre-train", True)
    }
    feed = ops.anomaly_feed(lines, sequences).collect()
    assert [r.id for r in feed] == ["3", "s1", "1"]
    entry = feed[1]
    assert (entry.nodes, entry.filenames, entry.text) == (["n2", "n1"], ["b.log", "a.log"], "first\nsecond\nthird")
    assert (entry.start_ts, entry.end_ts) == (at(0), at(7))
    rows = {r.log: r for r in dashboard_rows(ops.anomaly_feed(lines, sequences)).collect()}
    assert rows["text 1"].filename == "api.log" and rows["text 1"].time == "2024-01-01 12:05:00"


def test_feedback(spark, predictions):
    lines, sequences = ops.route_lines(predictions[0]), ops.route_sequences(predictions[1])
    actions = spark.createDataFrame(
        [("rapid", "1", "normal"), ("rapid", "3", "confirm"), ("log_gpt", "s1", "normal"), ("rapid", "77", "normal"), ("log_gpt", "1", "normal")],
        "type string, id string, action string",
    )
    assert {(r.id, r.is_anomaly) for r in ops.mark_normal_lines(lines, actions).collect()} == {("1", False), ("3", True)}
    marked = {r.id: r for r in ops.mark_normal_sequences(sequences, actions).collect()}
    assert (marked["s1"].is_anomaly, marked["s1"].train_strategy) == (False, "finetune")
    assert marked["s2"].train_strategy == "pre-train"
    assert [r.hash for r in ops.marked_lines(lines, actions).collect()] == ["h1"]
    assert {(r.id, r.prompt_user) for r in ops.confirm(lines, actions, "rapid").collect()} == {("1", True), ("3", False)}
    assert {(r.type, r.id) for r in ops.unmatched_feedback(actions, lines, sequences).collect()} == {("rapid", "77"), ("log_gpt", "1")}


@pytest.mark.parametrize("minutes", [0, 45, 500, 9000])
def test_context_lookup(spark, minutes):
    """Short and long entries use buckets of different widths; the rows are those of a plain range join."""
    feed = spark.createDataFrame(
        [("a", "api", ["n1", "n2"], ["f"], at(10), at(10 + minutes)), ("b", "api", ["n1"], ["f", "g"], at(20), at(20))],
        "id string, service string, nodes array<string>, filenames array<string>, start_ts timestamp, end_ts timestamp",
    )
    rows = [(i, ["api", "web"][i % 7 == 0], f"n{i % 3}", "fg"[i % 2], at(i * 7 % 10000)) for i in range(2000)]
    logs = spark.createDataFrame(rows, "log_id long, service string, node string, filename string, ts timestamp")
    got = [(r.anomaly_id, r.log_id) for r in ops.context_lookup(feed, logs, 2).collect()]
    expected = {
        (r.id, i)
        for r in feed.collect()
        for i, service, node, filename, ts in rows
        if service == r.service and node in r.nodes and filename in r.filenames
        and r.start_ts - dt.timedelta(minutes=2) <= ts <= r.end_ts + dt.timedelta(minutes=2)
    }
    assert len(got) == len(set(got)) and set(got) == expected and expected


def test_ensemble(spark, predictions):
    verdicts = spark.createDataFrame([(10, True), (11, False), (99, True)], "log_id long, is_anomaly boolean")
    got = {r.log_id: r.verdict for r in ops.ensemble(verdicts, predictions[1]).collect()}
    assert got == {10: "confirmed", 11: "sequence_only", 12: "sequence_only", 99: "line_only"}
    assert predictions[1].filter(F.col("id") == "s1").count() == 1


@pytest.mark.parametrize("radius", [2, 5000])
def test_context_lookup_plans_agree(spark, monkeypatch, radius):
    """Broadcast buckets and joined ones give the same rows; a log that is there twice is returned twice."""
    feed = spark.createDataFrame(
        [("a", "api", ["n0", "n1"], ["f", "g"], at(0), at(30)), ("b", "api", ["n1"], ["f"], at(40), at(40))],
        "id string, service string, nodes array<string>, filenames array<string>, start_ts timestamp, end_ts timestamp",
    )
    rows = [(i // 2, "api", f"n{i // 2 % 3}", "fg"[i // 2 % 2], at(i // 2), f"text {i // 2}") for i in range(400)]
    fields = "log_id long, service string, node string, filename string, ts timestamp, original_text string"
    logs = spark.createDataFrame(rows, fields)
    small = ops.context_lookup(feed, logs, radius)
    monkeypatch.setattr(ops, "is_small", lambda df: False)
    large = ops.context_lookup(feed, logs, radius).select(*small.columns)
    assert sorted(small.collect()) == sorted(large.collect())
    assert {n for (n,) in small.groupBy("anomaly_id", "log_id").count().select("count").collect()} == {2}


def test_context_lookup_of_an_empty_feed(spark):
    feed = "id string, service string, nodes array<string>, filenames array<string>, start_ts timestamp, end_ts timestamp"
    logs = spark.createDataFrame([(1, "api", "n", "f", at(0))], "log_id long, service string, node string, filename string, ts timestamp")
    found = ops.context_lookup(spark.createDataFrame([], feed), logs)
    assert found.columns[-1] == "anomaly_id" and not found.count()


def test_context_lookup_stores_no_pairs(spark, monkeypatch):
    """Every entry meets every log: only the buckets, at most ten per entry, are stored; repeated nodes count once."""
    stored, keep = [], ops.written

    def measured(df, label):
        out = keep(df, label)
        stored.append(out.count())
        return out

    monkeypatch.setattr(ops, "written", measured)
    monkeypatch.setattr(ops, "is_small", lambda df: False)
    feed = spark.createDataFrame(
        [(str(i), "api", ["n", "n"], ["f"], at(i), at(i)) for i in range(50)],
        "id string, service string, nodes array<string>, filenames array<string>, start_ts timestamp, end_ts timestamp",
    )
    rows = [(i, "api", "n", "f", at(i % 50)) for i in range(500)]
    logs = spark.createDataFrame(rows, "log_id long, service string, node string, filename string, ts timestamp")
    found = ops.context_lookup(feed, logs, 60)
    assert found.count() == 50 * 500 and max(stored) <= 50 * 10


@pytest.mark.parametrize("name", ["H5_marked_normals", "H5_mark_normal_lines"])
def test_feedback_on_lines_needs_no_chunks(spark, sf_dir, monkeypatch, name):
    def made(self):
        raise AssertionError("chunks were made")

    monkeypatch.setattr(views.LogTables, "stored_chunks", property(made))
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_live_feed_cleans_and_stores_logs_once(spark, sf_dir, monkeypatch):
    """Predictions of lines come from the cleaned logs that the chunks are made of."""
    p, labels, keep = Predictions(spark, sf_dir), [], views.written

    def noted(df, label):
        labels.append(label)
        return keep(df, label)

    assert "regexp_replace" not in p.line_predictions._jdf.queryExecution().optimizedPlan().toString()
    for module in (views, streams):
        monkeypatch.setattr(module, "written", noted)
    catalog.QUERIES["H7_live_feed"](spark, sf_dir)
    assert sorted(labels) == ["chunks", "cleaned", "services"]
