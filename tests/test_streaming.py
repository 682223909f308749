from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from emberlog.operators import lines as line_ops
from emberlog.operators import services as service_ops
from emberlog.operators import nextkey
from emberlog.operators.services import with_defaults
from emberlog.operators.template_tree import tree_keyed
from emberlog.operators.templates import keyed
from emberlog.operators.windows import chunk_windows, count_windows, tag_train_strategy
from emberlog.session import new_shared_path
from emberlog.sources.files import tail_files
from emberlog.sources.loki import decode_logs, encode, valid_logs
from emberlog.sources.tables import PartTable
from emberlog.sources.topics import read_topic, write_topic
from emberlog.streaming.feed import FeedWriter, prediction_stream
from emberlog.streaming.lines import RetrievalStream
from emberlog.streaming.sequences import CountWindows, SequenceStream, TrainTags

START = dt.datetime(2024, 1, 1)
SCHEMA = "log_id long, service string, node string, filename string, ts timestamp, original_text string"


def rows(n, seed=0):
    random.seed(seed)
    return [
        (
            i, random.choice(["api", "web"]), "hot" if random.random() < 0.6 else "cold", "f.log",
            START + dt.timedelta(seconds=i), f"{random.choice(['get', 'put', 'list'])} item {random.choice('abc')} in {i} ms",
        )
        for i in range(n)
    ]


def config(spark, **changes):
    base = spark.createDataFrame(
        [("1", "api", True, 40, 2, [("[0-9]+", "N")]), ("2", "web", False, 40, 2, [("[0-9]+", "N")])],
        "id string, name string, is_train boolean, max_pretrain int, top_k int, "
        "regex_subs array<struct<pattern:string,replacement:string>>",
    )
    services = with_defaults(base)
    return services.withColumns(changes) if changes else services


def slices(data, sizes):
    at = 0
    for size in sizes:
        yield data[at : at + size]
        at += size


def test_train_tags_go_on_over_batches(spark):
    data = rows(200)
    services = config(spark)
    path = new_shared_path(spark, "tags")
    tags = TrainTags(spark, path, rows_per_range=30)
    got = {}
    for n, part in enumerate(slices(data, [50, 1, 99, 50])):
        df = spark.createDataFrame(part, SCHEMA)
        for _ in range(2):  # a repeated batch changes nothing
            found = {r.log_id: r.train_strategy for r in tags.process(df, n, services).collect()}
        got.update(found)
    batch = tag_train_strategy(spark.createDataFrame(data, SCHEMA), services).collect()
    assert got == {r.log_id: r.train_strategy for r in batch}


@pytest.mark.parametrize("compact_every", [2, 100])
def test_count_windows_over_batches(spark, compact_every):
    """Random batches, each run twice, equal a loop in arrival order."""
    random.seed(3)
    data = rows(300, seed=3)
    sizes = [7, 60, 1, 100, 40, 92]
    windows = CountWindows(spark, new_shared_path(spark, "windows"), 16, "key", 25, compact_every)
    got, held, expected = {}, defaultdict(list), {}
    for n, part in enumerate(slices(data, sizes)):
        df = spark.createDataFrame(part, SCHEMA).withColumn("key", F.col("node"))
        for _ in range(2):
            found = {(r.key, r.window_no): [x.log_id for x in r.logs] for r in windows.process(df, n).collect()}
        got.update(found)
        for r in part:
            held[r[2]].append(r[0])
    for key, ids in held.items():
        for w in range(len(ids) // 16):
            expected[key, w] = ids[w * 16 : w * 16 + 16]
    assert got == expected


def publish(spark, topic, part):
    encode(spark.createDataFrame(part, SCHEMA)).write.mode("append").text(topic)


@pytest.mark.parametrize("mine", [False, True])
def test_sequence_stream_equals_batch(spark, mine):
    data = rows(400, seed=5)
    services = config(spark)
    topic = new_shared_path(spark, "topic")
    mode = {"services": services}
    stream = SequenceStream(spark, new_shared_path(spark, "seq"), lambda: mode["services"], context=12, window=20, mine=mine)

    def run(part):
        publish(spark, topic, part)
        logs = valid_logs(decode_logs(read_topic(spark, topic)))
        stream.start(logs, availableNow=True).awaitTermination()

    first, second = list(slices(data, [230, 170]))
    run(first)
    cleaned = line_ops.clean(spark.createDataFrame(data, SCHEMA), services)
    logs = tree_keyed(cleaned)[0] if mine else keyed(cleaned)
    tagged = tag_train_strategy(logs, services).withColumn("key", F.col("node"))
    batch = chunk_windows(count_windows(tagged, 20), 12)
    early = stream.chunks.all()
    assert {r.chunk_id for r in early.collect()} < {r.chunk_id for r in batch.collect()}
    # before training, the training service passes its chunks as normal and the other one nothing
    assert {(r.service, r.is_anomaly) for r in stream.predictions.all().collect()} == {("api", False)}

    stream.retrain(early.withColumn("train_strategy", F.lit("pre-train")))
    run(second)
    facts = lambda df: {r.chunk_id: (r.hash, r.chunk.input_ids, r.train_strategy) for r in df.collect()}
    assert facts(stream.chunks.all()) == facts(batch)

    late = stream.chunks.latest().withColumn("input_ids", F.col("chunk.input_ids"))
    top_k = services.select(F.col("name").alias("service"), "top_k")
    bad = {r.chunk_id for r in nextkey.detect(late, stream.models.latest(), top_k).filter("is_anomaly AND service = 'web'").collect()}
    told = {r.chunk_id for r in stream.predictions.latest().filter("is_anomaly").collect()}
    assert told == bad and bad

    mode["services"] = config(spark, is_train=F.lit(True))  # a changed configuration holds from the next batch
    run(rows(600, seed=6)[400:])
    assert {(r.service, r.is_anomaly) for r in stream.predictions.latest().collect()} == {("api", False), ("web", False)}

    feed = FeedWriter(spark, new_shared_path(spark, "feed"))
    feed.start(prediction_stream(spark, stream.predictions), "log_gpt", availableNow=True).awaitTermination()
    assert {r.id for r in feed.feed().collect()} == {r.chunk_id for r in stream.predictions.all().collect()}
    feed.process_sequences(stream.predictions.all(), 50)  # delivered again
    assert feed.feed().count() == stream.predictions.all().count()
    assert stream.models.parts() == [0]
    stream.retrain(stream.chunks.all().withColumn("train_strategy", F.lit("pre-train")))
    total = lambda: stream.models.latest().filter("size(context) = 0").agg(F.sum("n")).first()[0]
    before = total()
    stream.extend_model(late.withColumn("train_strategy", F.lit("finetune")))
    assert stream.models.parts() == [0, 1, 2]
    added = late.select(F.sum(F.size(F.filter("input_ids", lambda x: x != 2)) - 1)).first()[0]
    assert total() == before + added


def one_hot(df):
    """Vectors by the letter of the item, so that scores are easy to follow."""
    hit = lambda x: F.when(F.contains("cleaned_text", F.lit(f"item {x}")), 1.0).otherwise(0.1)
    vector = F.array(hit("a"), hit("b"), hit("c"))
    return df.withColumns({"cls": vector, "tokens": F.array(vector)})


def test_marked_lines_are_worked_out_once(spark):
    services = config(spark, threshold=F.lit(0.5), coreset_size=F.lit(2))
    stream = RetrievalStream(spark, new_shared_path(spark, "marked"), lambda: services, embed=one_hot)
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def dear(text):
        made.add(1)
        return text

    logs = spark.createDataFrame(rows(100, seed=9), SCHEMA)
    expected = {(r.service, r.hash) for r in line_ops.clean(logs, services).select("service", "hash").distinct().collect()}
    stream.mark_normal(line_ops.clean(logs.withColumn("original_text", dear("original_text")), services))
    assert {(r.service, r.hash) for r in stream.store().collect()} == expected
    assert made.value == 100


def test_retrieval_stream(spark):
    """Batches against a plain loop over the batch rule."""
    data = rows(240, seed=8)
    services = config(spark, threshold=F.lit(0.5), coreset_size=F.lit(2))
    path = new_shared_path(spark, "lines")
    stream = RetrievalStream(spark, path, lambda: services, embed=one_hot, block_rows=4)
    clean = lambda df: line_ops.clean(df, services)

    first = spark.createDataFrame([data[0][:1] + ("web",) + data[0][2:5] + ("get item a in 5 ms",)], SCHEMA)
    stream.mark_normal(clean(first))
    store = {("web", clean(first).first().hash): "a"}
    expected, got = {}, {}
    for n, part in enumerate(slices(data, [5, 60, 175])):
        df = spark.createDataFrame(part, SCHEMA)
        for _ in range(2):  # a repeated batch changes nothing
            stream.process(df, n)
        for r in stream.predictions.latest().collect():
            got[r.log_id] = (round(r.score, 6), r.is_anomaly)

        snapshot, reported = dict(store), set()
        for r in clean(df).orderBy("ts", "log_id").collect():
            key, item = (r.service, r.hash), r.original_text.split("item ")[1][0]
            if key in snapshot:
                continue
            if r.service == "api":
                store[key] = item
                continue
            normal = {i for (s, _), i in snapshot.items() if s == r.service}
            if not normal:
                continue
            if item in normal:  # the same letter: cosine 1
                if key not in reported:
                    expected[r.log_id] = (0.0, False)
                    reported.add(key)
                store[key] = item
            else:
                cosine = (2 * 1.0 * 0.1 + 0.01) / (1 + 2 * 0.01)
                expected[r.log_id] = (round(1 - cosine, 6), True)
    assert got == expected and {a for _, a in expected.values()} == {True, False}
    learned = {(r.service, r.hash) for r in stream.store().collect()}
    assert learned == set(store)
    assert stream.cache.all().groupBy("hash").count().filter("count > 1").count() == 0


def test_line_feed(spark):
    predictions = spark.createDataFrame(
        [(*rows(1)[0], "h", True, "rapid"), (1, "api", "n", "f", START, "ok", "g", False, "rapid")],
        SCHEMA + ", hash string, is_anomaly boolean, type string",
    )
    feed = FeedWriter(spark, new_shared_path(spark, "feed"))
    feed.process_lines(predictions, 0)
    feed.process_lines(predictions, 1)
    assert [r.id for r in feed.feed().collect()] == ["0"]
    logs = line_ops.clean(spark.createDataFrame(rows(12, seed=2), SCHEMA), config(spark))
    chunks = chunk_windows(count_windows(keyed(logs).withColumn("key", F.col("node")), 2), 12)
    feed.process_sequences(chunks.withColumn("type", F.lit("log_gpt")), 0)  # the same number as a batch of lines
    assert {(r.type, r.n) for r in feed.feed().groupBy("type").agg(F.count("*").alias("n")).collect()} == {
        ("rapid", 1), ("log_gpt", chunks.count())
    }


def test_tailed_files(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "service1.log").write_text("one\ntwo\n")
    labels = spark.createDataFrame(
        [("service1", "node_a", "service1.log"), ("service2", "node_b", "service2.log")],
        "service string, node string, filename string",
    )
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = tail_files(spark, str(folder), labels)
        write_topic(encode(stream), out, check).trigger(availableNow=True).start().awaitTermination()

    run()
    (folder / "service2.log").write_text("three\n")
    (folder / "unlabelled.log").write_text("four\n")
    run()
    got = spark.read.text(out).select(F.from_json("value", "service string, node string, original_text string").alias("r"))
    assert {tuple(r.r) for r in got.collect()} == {
        ("service1", "node_a", "one"), ("service1", "node_a", "two"), ("service2", "node_b", "three")
    }


def test_event_time_windows_drop_rows_behind_the_watermark(spark):
    from emberlog.operators.windows import event_time_windows

    topic, path = new_shared_path(spark, "topic"), new_shared_path(spark, "windows")
    late = [(900, "api", "hot", "f.log", START, "late", )]
    for part in (rows(30), rows(60)[30:], late, rows(90)[60:]):
        publish(spark, topic, part)
        logs = valid_logs(decode_logs(read_topic(spark, topic))).withColumn("key", F.col("node"))
        windows = event_time_windows(logs, "5 seconds", "1 second")
        query = windows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c")
        query.trigger(availableNow=True).start().awaitTermination()
    total = spark.read.parquet(f"{path}/out").agg(F.sum("n_logs")).first()[0]
    assert total == 85  # seconds 0-84; the last window is still open and the late row is gone


def test_traces_by_joined_patterns(spark, monkeypatch):
    services = with_defaults(
        spark.createDataFrame(
            [("1", "a", True, r"req=(\d+)"), ("2", "b", True, r"id\(\d"), ("3", "c", False, r"x")],
            "id string, name string, enable_trace boolean, trace_regex string",
        )
    )
    logs = spark.createDataFrame(
        [("a", "req=12 req=3"), ("a", "none"), ("b", "id(7"), ("c", "x")], "service string, original_text string"
    )
    facts = lambda: sorted((r.service, r.original_text, r.trace_id or "") for r in line_ops.extract_traces(logs, services).collect())
    plain = facts()
    monkeypatch.setattr(service_ops, "MAX_LITERAL_SERVICES", 0)
    assert facts() == plain == [("a", "none", ""), ("a", "req=12 req=3", "12"), ("b", "id(7", "id(7"), ("c", "x", "")]


def test_prediction_topic_is_a_part_table(spark, tmp_path):
    table = PartTable(spark, str(tmp_path / "p"))
    table.write(spark.range(3), 0)
    query = prediction_stream(spark, table).writeStream.format("parquet").option("path", str(tmp_path / "o"))
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3
