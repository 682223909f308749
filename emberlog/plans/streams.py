"""Streams replayed from ``events``: each slice of days is one restart of the stream."""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.nextkey import detect, sequence_predictions
from emberlog.operators.ordering import number_rows
from emberlog.operators.windows import event_time_windows
from emberlog.plans import views as v
from emberlog.plans.feed import LINE_FEED, SEQUENCE_FEED, Predictions, feed_rows
from emberlog.plans.ingest import pushes
from emberlog.plans.nextkeys import KeyExperiment
from emberlog.plans.registry import ORACLE, query
from emberlog.plans.retrieval import TOKENS, TRIGRAMS
from emberlog.plans.windows import EVENT_TIME_SQL, STRATEGY_SQL, _window_rows, event_time_rows
from emberlog.session import new_shared_path, written
from emberlog.operators.lines import clean
from emberlog.sources.files import tail_files
from emberlog.sources.loki import decode_logs, encode, flatten_pushes, valid_logs
from emberlog.sources.tables import PartTable
from emberlog.sources.topics import read_topic, write_topic
from emberlog.streaming.feed import FeedWriter, prediction_stream
from emberlog.streaming.lines import RetrievalStream
from emberlog.streaming.sequences import CountWindows, SequenceStream, TrainTags

SLICE_DAYS = [(1, 10), (11, 20), (21, 31)]
TOPIC_FIELDS = ["log_id", "service", "node", "filename", "ts", "original_text"]


def replay(spark: SparkSession, sf_dir: str, start: Callable[[DataFrame], object]) -> None:
    """Append the logs to a topic, slice by slice, and run the stream after each until it has caught up.

    ``start`` gives a query to wait for, or None if it has waited itself.
    """
    topic = new_shared_path(spark, "topic")
    logs = v.logs(spark, sf_dir).select(*TOPIC_FIELDS)
    for first, last in SLICE_DAYS:
        encode(logs.filter(F.dayofmonth("ts").between(first, last))).write.mode("append").text(topic)
        query = start(valid_logs(decode_logs(read_topic(spark, topic))))
        if query is not None:
            query.awaitTermination()


def drain(writer) -> None:
    """Run a stream until it has caught up, and once more for what its last watermark completes.

    Sources without an end of their own, such as growing files, make ``availableNow`` stop before that.
    """
    query = writer.trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def run_batches(process, path: str) -> Callable[[DataFrame], object]:
    def start(stream: DataFrame):
        return (
            stream.writeStream.foreachBatch(process)
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )

    return start


@query(
    "A4_A6_topics",
    v.with_views("logs") + "SELECT log_id, service, node, filename, epoch_us(ts) AS ts_us, original_text FROM logs",
)
def topics(spark, sf_dir):
    path = new_shared_path(spark, "processed")

    def start(stream):
        return write_topic(encode(stream), f"{path}/topic", f"{path}/checkpoint").trigger(availableNow=True).start()

    replay(spark, sf_dir, start)
    back = valid_logs(decode_logs(spark.read.text(f"{path}/topic")))
    return back.select("log_id", "service", "node", "filename", v.micros("ts").alias("ts_us"), "original_text")


@query("E1_train_strategy_stream", STRATEGY_SQL)
def strategy(spark, sf_dir):
    path = new_shared_path(spark, "strategy")
    config = written(v.services(spark, sf_dir), "services")
    tags, out = TrainTags(spark, path), PartTable(spark, f"{path}/tagged")
    replay(
        spark, sf_dir, run_batches(lambda df, n: out.write(tags.process(df, n, config), n), path)
    )
    return out.all().select("log_id", "train_strategy")


@query(
    "E3_count_windows_stream",
    v.with_views("logs")
    + """SELECT key, window_no, count(*) AS n_logs, min(log_id) AS first_id, max(log_id) AS last_id, sum(log_id) AS id_sum FROM (
          SELECT *, pos // 64 AS window_no FROM (
            SELECT log_id, node AS key, row_number() OVER (PARTITION BY node ORDER BY ts, log_id) - 1 AS pos,
            count(*) OVER (PARTITION BY node) AS total FROM logs))
        WHERE (window_no + 1) * 64 <= total GROUP BY key, window_no""",
)
def count_windows(spark, sf_dir):
    path = new_shared_path(spark, "windows")
    windows, out = CountWindows(spark, path, 64, "key"), PartTable(spark, f"{path}/full")
    process = lambda df, n: out.write(windows.process(df.withColumn("key", F.col("node")), n), n)
    replay(spark, sf_dir, run_batches(process, path))
    return _window_rows(out.all(), ["key"])


@query(
    "E8_event_time_stream",
    f"""SELECT * FROM ({EVENT_TIME_SQL}) WHERE window_us + 5000000 <= (SELECT max(epoch_us(ts)) - 1000000 FROM events)""",
)
def event_time(spark, sf_dir):
    path = new_shared_path(spark, "event-time")

    def start(stream):
        windows = event_time_windows(stream.withColumn("key", F.col("node")), delay="1 second")
        writer = windows.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
        drain(writer.option("checkpointLocation", f"{path}/checkpoint"))

    replay(spark, sf_dir, start)
    return event_time_rows(spark.read.parquet(f"{path}/out"))


#: between the scores of these lines, so that both verdicts occur
LINE_THRESHOLD = -12


def _retrieval_sql() -> str:
    """Slice by slice: unknown lines against the store so far, verdicts, and the store that they leave."""
    known = "service IN ('view', 'signup')"
    texts = f"""texts AS (SELECT DISTINCT service, hash, cleaned_text FROM cleaned WHERE {known}),
      tokens AS (SELECT service, hash, unnest({TOKENS.format('cleaned_text')}) AS token,
        generate_subscripts({TOKENS.format('cleaned_text')}, 1) AS pos FROM texts),
      vecs AS MATERIALIZED (SELECT token, {TRIGRAMS.format(t='token')} AS vec FROM (SELECT DISTINCT token FROM tokens)),
      tv AS MATERIALIZED (SELECT t.*, vec FROM tokens t JOIN vecs USING (token)),
      dims AS (SELECT service, hash, d, sum(vec[d]) AS x FROM tv, range(1, 33) r(d) GROUP BY ALL),
      cls AS MATERIALIZED (SELECT service, hash, list(x ORDER BY d) AS cls FROM dims GROUP BY ALL),
      store0 AS MATERIALIZED (SELECT DISTINCT service, hash FROM cleaned WHERE NOT is_anomaly AND {known})"""
    steps = [
        f"""unknown{i} AS (SELECT * FROM cleaned WHERE {known} AND day(ts) BETWEEN {first} AND {last}
            AND (service, hash) NOT IN (SELECT (service, hash) FROM store{i - 1})),
          query{i} AS MATERIALIZED (SELECT service, hash, cls FROM cls WHERE (service, hash) IN (SELECT (service, hash) FROM unknown{i})),
          core{i} AS (SELECT * FROM (SELECT service, q.hash AS q_id, p.hash AS p_id, row_number() OVER (PARTITION BY service, q.hash
              ORDER BY round(1 - list_cosine_similarity(q.cls, p.cls), 9), p.hash) AS rank
            FROM query{i} q JOIN (SELECT * FROM cls JOIN store{i - 1} USING (service, hash)) p USING (service)) WHERE rank <= 2),
          pairs{i} AS (SELECT service, q_id, p_id, 1 - sum(best) AS distance FROM (
            SELECT c.service, q_id, p_id, q.pos, max(list_cosine_similarity(q.vec, p.vec)) AS best FROM core{i} c
            JOIN tv q ON q.service = c.service AND q.hash = q_id JOIN tv p ON p.service = c.service AND p.hash = p_id GROUP BY ALL)
            GROUP BY ALL),
          verdict{i} AS MATERIALIZED (SELECT service, q_id AS hash, min(distance) AS score,
            min(distance) > {LINE_THRESHOLD} AS is_odd FROM pairs{i} GROUP BY service, q_id),
          store{i} AS MATERIALIZED (SELECT * FROM store{i - 1} UNION ALL SELECT service, hash FROM verdict{i} WHERE NOT is_odd),
          found{i} AS (SELECT log_id, service, hash, score, is_odd AS is_anomaly FROM (
            SELECT *, row_number() OVER (PARTITION BY service, hash ORDER BY ts, log_id) AS nth FROM unknown{i} JOIN verdict{i} USING (service, hash))
            WHERE is_odd OR nth = 1)"""
        for i, (first, last) in enumerate(SLICE_DAYS, 1)
    ]
    found = " UNION ALL ".join(
        f"SELECT log_id, service, hash, round(score, 6) AS score, is_anomaly FROM found{i}" for i in range(1, len(SLICE_DAYS) + 1)
    )
    return v.with_views("cleaned") + ", " + ",\n".join([texts, *steps]) + "\n" + found


@query("F14_retrieval_stream", _retrieval_sql())
def retrieval(spark, sf_dir):
    config = written(v.services(spark, sf_dir).withColumn("threshold", F.lit(float(LINE_THRESHOLD))), "services")
    stream = RetrievalStream(spark, new_shared_path(spark, "retrieval"), lambda: config)
    stream.mark_normal(v.cleaned(spark, sf_dir).filter("NOT is_anomaly AND service IN ('view', 'signup')"))
    replay(spark, sf_dir, lambda logs: stream.start(logs, availableNow=True))
    return stream.predictions.all().select("log_id", "service", "hash", F.round("score", 6).alias("score"), "is_anomaly")


@query("H7_live_feed", v.with_views("cleaned", "chunks") + f"{LINE_FEED} UNION ALL {SEQUENCE_FEED}")
def live_feed(spark, sf_dir):
    """Predictions of both kinds, each a stream of its own, in one feed; some are delivered twice."""
    p = Predictions(spark, sf_dir)
    feed = FeedWriter(spark, new_shared_path(spark, "live"))
    for kind, predictions, number in (
        ("rapid", p.line_predictions, F.col("log_id")),
        ("log_gpt", p.sequence_predictions, F.col("window_no")),
    ):
        table = PartTable(spark, new_shared_path(spark, f"predictions-{kind}"))
        # lines and chunks are stored, so each part is cut out of what was made once
        predictions = predictions.drop("id")
        for part in (number % 3 == 0, number % 3 == 1, number % 3 != 1):
            table.write(predictions.filter(part))
            feed.start(prediction_stream(spark, table), kind, availableNow=True).awaitTermination()
    return feed_rows(feed.feed())


@query("H7_live_predictions")
def live_predictions(spark, sf_dir):
    """Sequence stream → nightly training → predictions → feed."""
    path = new_shared_path(spark, "sequences")
    config = written(v.services(spark, sf_dir), "services")
    stream = SequenceStream(spark, path, lambda: config, context=v.CONTEXT, window=v.WINDOW)
    days = iter(SLICE_DAYS)

    def start(logs):
        if next(days) != SLICE_DAYS[0]:
            stored = stream.chunks.all().withColumn("train_strategy", F.coalesce("train_strategy", F.lit("pre-train")))
            stream.retrain(stored)
        return stream.start(logs, availableNow=True)

    replay(spark, sf_dir, start)
    feed = FeedWriter(spark, f"{path}/live")
    feed.start(prediction_stream(spark, stream.predictions), "log_gpt", availableNow=True).awaitTermination()
    return feed.feed().select("type", "id", "service", v.micros("start_ts").alias("start_us"), v.micros("end_ts").alias("end_us"))


@query(
    "B5_live_config",
    v.with_views("logs")
    + """SELECT log_id, CASE WHEN day(ts) <= 10 THEN 'first' WHEN day(ts) <= 20 THEN 'second' ELSE 'third' END
         || regexp_replace(original_text, CASE WHEN day(ts) <= 10 THEN 'blk_[0-9]+' ELSE 'user=[0-9]+' END,
           CASE WHEN day(ts) <= 20 THEN 'A' ELSE 'B' END, 'g') AS cleaned_text FROM logs""",
)
def live_config(spark, sf_dir):
    """Each slice of the stream finds another configuration of the services."""
    config, out = {}, PartTable(spark, new_shared_path(spark, "live-config"))
    rules = iter([("first", "blk_[0-9]+", "A"), ("second", "user=[0-9]+", "A"), ("third", "user=[0-9]+", "B")])

    def process(logs, batch_id):
        out.write(clean(logs, config["services"]).select("log_id", "cleaned_text"), batch_id)

    path = new_shared_path(spark, "live")

    def start(logs):
        name, pattern, replacement = next(rules)
        subs = F.array(
            *[F.struct(F.lit(p).alias("pattern"), F.lit(r).alias("replacement")) for p, r in (("^", name), (pattern, replacement))]
        )
        config["services"] = v.services(spark, sf_dir).withColumn("regex_subs", subs)
        return run_batches(process, path)(logs)

    replay(spark, sf_dir, start)
    return out.all()


@query(
    "A5_shipped_records",
    v.with_views("logs")
    + """SELECT service, node, filename, original_text, epoch_us(ts) // 10 * 10 AS ts_us, true AS has_id, true AS is_repeatable
         FROM logs""",
)
def shipped_records(spark, sf_dir):
    """Pushes → records as the shipper sends them, integer times and no ids → topic → both readings of it."""
    topic, path = new_shared_path(spark, "shipped"), new_shared_path(spark, "received")
    flat = flatten_pushes(pushes(v.logs(spark, sf_dir)))
    encode(flat.select("node", "filename", "timestamp", "service", "original_text")).write.text(topic)
    out = []
    for n in (0, 1):
        received = PartTable(spark, f"{path}/{n}")
        stream = valid_logs(decode_logs(read_topic(spark, topic, format="lines")))
        run_batches(lambda df, i, table=received: table.write(df, i), f"{path}/state-{n}")(stream).awaitTermination()
        out.append(received.all())
    again = out[1].select("log_id", "original_text", F.lit(True).alias("_again")).distinct()
    return (
        out[0]
        .join(again, ["log_id", "original_text"], "left")
        .select(
            "service", "node", "filename", "original_text", v.micros("ts").alias("ts_us"),
            F.col("log_id").isNotNull().alias("has_id"), F.coalesce("_again", F.lit(False)).alias("is_repeatable"),
        )
    )


def grow_files(logs: DataFrame, folder: str, sizes: dict[str, int]) -> dict[str, int]:
    """Append the lines of every service, in order, to its file; ``sizes`` are the files' bytes so far, the new ones are returned.

    A file is cut back to its size before it grows, so a repeated task appends once.
    """
    root = folder.removeprefix("file:")

    def append(batches):
        file, service = None, None
        for batch in batches:
            for name, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                if name != service:
                    if file:
                        yield closed(service, file)
                    service, path = name, f"{root}/{name}/app.log"
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    file = open(path, "ab")
                    file.truncate(sizes.get(name, 0))
                file.write(text.encode() + b"\n")
        if file:
            yield closed(service, file)

    def closed(service, file):
        file.close()
        return pa.RecordBatch.from_pydict({"service": [service], "bytes": [os.path.getsize(file.name)]})

    ordered = logs.repartition("service").sortWithinPartitions("service", "ts", "log_id")
    grown = ordered.select("service", "original_text").mapInArrow(append, "service string, bytes long")
    # one row per file
    return {**sizes, **{r.service: r.bytes for r in grown.collect()}}


@query(
    "A8_tailed_files",
    v.with_views("logs")
    + """SELECT service, 'n_' || service AS node, service || '/app.log' AS filename, regexp_extract(original_text, '^[a-z]+ [a-z]+ [a-z]+') AS original_text,
         row_number() OVER (PARTITION BY service ORDER BY ts, log_id) AS line_no, true AS has_own_id FROM logs""",
)
def tailed(spark, sf_dir):
    """Files that grow while they are tailed; most of their lines are repeated. Ids give the order of the lines."""
    path, out = new_shared_path(spark, "tailed"), PartTable(spark, new_shared_path(spark, "tailed-rows"))
    short = F.regexp_extract("original_text", "^[a-z]+ [a-z]+ [a-z]+", 0)
    logs = written(v.logs(spark, sf_dir).select("log_id", "ts", "service", short.alias("original_text")), "short-logs")
    services = v.services(spark, sf_dir).select(F.col("name").alias("service"))
    labels = services.select(
        F.concat("service", F.lit("/app.log")).alias("filename"), "service", F.concat(F.lit("n_"), "service").alias("node")
    )
    labels, state, sizes = written(labels, "file-labels"), new_shared_path(spark, "tail"), {}
    for first, last in SLICE_DAYS:
        sizes = grow_files(logs.filter(F.dayofmonth("ts").between(first, last)), path, sizes)
        # small pieces, so that lines are cut out of the middle of files
        stream = tail_files(spark, path, labels, split_bytes=1 << 16)
        run_batches(lambda df, i: out.write(df, i), state)(stream).awaitTermination()
    found = written(out.all(), "tailed-lines")
    owners = found.groupBy("log_id").agg(F.count(F.lit(1)).alias("_n"))
    numbered = number_rows(found, ["ts", "log_id"], ["filename"], "line_no").join(owners, "log_id")
    return numbered.select("service", "node", "filename", "original_text", "line_no", (F.col("_n") == 1).alias("has_own_id"))


@query("A7_prediction_topic", ORACLE["G10_sequence_predictions"])
def prediction_topic(spark, sf_dir):
    """Predictions stored as a part → stream → topic of JSON messages → read back."""
    path = new_shared_path(spark, "predictions")
    e = KeyExperiment(spark, sf_dir, "cleaned_text")
    stored = PartTable(spark, f"{path}/stored")
    stored.write(sequence_predictions(e.test, detect(e.test, e.model, e.top_k), e.services))
    messages = encode(prediction_stream(spark, stored))
    write_topic(messages, f"{path}/topic", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = "type string, chunk_id string, service string, hash string, is_anomaly boolean"
    sent = spark.read.text(f"{path}/topic")
    return sent.select(F.from_json("value", schema).alias("m")).select("m.*")
