"""Streams of several inputs, replayed from ``events``: controls, repeated deliveries, silent sources, late verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from emberlog.operators.lines import clean
from emberlog.plans import views as v
from emberlog.plans.feed import Predictions
from emberlog.plans.registry import query
from emberlog.plans.streams import SLICE_DAYS, TOPIC_FIELDS, drain
from emberlog.plans.windows import event_time_rows
from emberlog.session import new_shared_path, written
from emberlog.sources.loki import decode_logs, encode, valid_logs
from emberlog.sources.tables import PartTable
from emberlog.sources.topics import read_topic
from emberlog.streaming.control import CONFIG_CHANGE, CONTROL, MARK_NORMAL, MODEL_UPDATE, ControlStream
from emberlog.streaming.ensemble import deliver_once, final_verdicts, first_verdicts, watermark_policy, windows_of_sources
from emberlog.streaming.feed import prediction_stream


def _slices(spark, sf_dir):
    logs = v.logs(spark, sf_dir).select(*TOPIC_FIELDS)
    return [logs.filter(F.dayofmonth("ts").between(first, last)) for first, last in SLICE_DAYS]


def _control(df, kind, **fields):
    """Rows of ``df`` as messages of the control topic."""
    given = {"kind": F.lit(kind), **fields}
    columns = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CONTROL.fields]
    return encode(df.select(*columns))


# the last messages win: rules change after the first slice, lines are marked then, a model comes after the second
@query(
    "H5_control_stream",
    v.with_views("logs")
    + """, texts AS (SELECT log_id, service, ts, regexp_replace(original_text, '[0-9]+',
             CASE WHEN day(ts) <= 10 THEN 'NUM' ELSE 'N' || length(service) END, 'g') AS cleaned_text FROM logs),
           marks AS (SELECT DISTINCT service, cleaned_text FROM texts WHERE day(ts) BETWEEN 11 AND 20 AND log_id % 7 = 0)
         SELECT log_id, cleaned_text, day(ts) > 10 AND m.service IS NOT NULL AS is_marked,
           CASE WHEN day(ts) > 20 THEN 5 END AS model_version
         FROM texts t LEFT JOIN marks m USING (service, cleaned_text)""",
)
def control_stream(spark, sf_dir):
    """Configurations, marks and a model version arrive between slices of logs; each holds from then on."""
    logs_topic, controls_topic, path = (new_shared_path(spark, n) for n in ("logs", "controls", "control-stream"))
    rule = lambda to: F.array(F.struct(F.lit("[0-9]+").alias("pattern"), to.alias("replacement")))
    services = written(v.services(spark, sf_dir).withColumn("regex_subs", rule(F.lit("NUM"))), "services")
    out = PartTable(spark, f"{path}/judged")

    def judge(logs, state, batch_id):
        cleaned = clean(logs, state.services)
        marked = state.marked.select("service", "hash", F.lit(True).alias("_marked"))
        found = cleaned.join(marked, ["service", "hash"], "left")
        version = F.lit(state.model_version).cast("int").alias("model_version")
        out.write(found.select("log_id", "cleaned_text", F.coalesce("_marked", F.lit(False)).alias("is_marked"), version), batch_id)

    stream = ControlStream(spark, path, services, judge)
    parts = _slices(spark, sf_dir)
    later = services.withColumn("regex_subs", rule(F.concat(F.lit("N"), F.length("name").cast("string"))))
    seen = clean(parts[1].filter("log_id % 7 = 0"), later).select("service", "hash", "cleaned_text").distinct()
    config_type = CONTROL["config"].dataType
    config = F.struct(*[(F.col(f.name) if f.name == "regex_subs" else F.lit(None)).cast(f.dataType).alias(f.name) for f in config_type.fields])
    stale = services.withColumn("regex_subs", rule(F.lit("STALE")))
    one = spark.range(1)
    messages = [
        one.select(F.lit('{"kind": "unheard-of"}').alias("value")).unionByName(one.select(F.lit("{broken").alias("value"))),
        _control(stale, CONFIG_CHANGE, service=F.col("name"), config=config)
        .unionByName(_control(later, CONFIG_CHANGE, service=F.col("name"), config=config))
        .unionByName(_control(seen, MARK_NORMAL, service=F.col("service"), hash=F.col("hash"), cleaned_text=F.col("cleaned_text"))),
        reduce(lambda a, b: a.unionByName(b), [_control(one, MODEL_UPDATE, version=F.lit(n)) for n in (4, 5)]),
    ]
    for logs, controls in zip(parts, messages):
        encode(logs).write.mode("append").text(logs_topic)
        # one file, so that the messages keep their order
        controls.coalesce(1).write.mode("append").text(controls_topic)
        topics = [read_topic(spark, topic, format="lines") for topic in (logs_topic, controls_topic)]
        stream.start(*topics, availableNow=True).awaitTermination()
    return out.all()


@query(
    "A6_repeated_deliveries",
    v.with_views("logs") + "SELECT log_id, service, node, filename, epoch_us(ts) AS ts_us, original_text, 1 AS n FROM logs",
)
def repeated_deliveries(spark, sf_dir):
    """Every message is sent twice, and those of the last two days of a slice once more with the next one."""
    topic, path = new_shared_path(spark, "twice"), new_shared_path(spark, "once")
    last = None
    for logs in _slices(spark, sf_dir):
        for part in (logs, logs, last):
            if part is not None:
                encode(part).write.mode("append").text(topic)
        end = logs.agg(F.max("ts")).first()[0]
        last = logs.filter(F.col("ts") > F.lit(end) - F.expr("INTERVAL 2 DAYS"))
        once = deliver_once(valid_logs(decode_logs(read_topic(spark, topic))), delay="3 days")
        writer = once.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append")
        writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/out").withColumn("ts_us", v.micros("ts"))
    return rows.groupBy("log_id", "service", "node", "filename", "ts_us", "original_text").agg(F.count(F.lit(1)).alias("n"))


HEARD = "SELECT * FROM events WHERE user_id % 4 <> 0 OR day(ts) <= 10"


@query(
    "E9_silent_source",
    f"""WITH heard AS ({HEARD}) SELECT * FROM (
          SELECT epoch_us(time_bucket(INTERVAL '5 seconds', ts)) AS window_us, 'node_' || (user_id % 4) AS key,
            count(*) AS n_logs, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM heard GROUP BY 1, 2)
        WHERE window_us + 5000000 <= (SELECT max(epoch_us(ts)) - 1000000 FROM heard)""",
)
def silent_source(spark, sf_dir):
    """One topic per node; one node says nothing after the first slice, and windows of the others go on closing."""
    path, nodes = new_shared_path(spark, "nodes"), [f"node_{n}" for n in range(4)]
    for number, logs in enumerate(_slices(spark, sf_dir)):
        for node in nodes:
            if node != "node_0" or number == 0:
                encode(logs.filter(F.col("node") == node)).write.mode("append").text(f"{path}/topics/{node}")
        streams = [valid_logs(decode_logs(read_topic(spark, f"{path}/topics/{node}"))) for node in nodes]
        windows = windows_of_sources([s.withColumn("key", F.col("node")) for s in streams])
        writer = windows.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
        with watermark_policy(spark, slowest=False):
            drain(writer.option("checkpointLocation", f"{path}/state"))
    return event_time_rows(spark.read.parquet(f"{path}/out"))


@query(
    "H9_verdicts_over_time",
    v.with_views("cleaned", "chunks")
    + """, s AS (SELECT unnest(log_ids) AS log_id, (window_no + chunk_no) % 2 = 0 AS bad, end_ts FROM chunks WHERE day(end_ts) <= 20),
         l AS (SELECT log_id, ts, is_anomaly AS bad FROM cleaned),
         upto AS (SELECT least((SELECT max(ts) FROM l), (SELECT max(c.ts) FROM s JOIN cleaned c USING (log_id))) - INTERVAL 12 DAY AS ts)
         SELECT log_id, 'suspected' AS verdict FROM l WHERE bad
         UNION ALL SELECT log_id, CASE WHEN l.bad AND s.bad THEN 'confirmed' WHEN l.bad AND s.log_id IS NOT NULL THEN 'refuted'
           WHEN l.bad THEN 'unconfirmed' ELSE 'added' END FROM l LEFT JOIN s USING (log_id)
         WHERE (l.bad OR s.bad) AND (s.log_id IS NOT NULL OR ts < (SELECT ts FROM upto))""",
)
def verdicts_over_time(spark, sf_dir):
    """Line verdicts come slice by slice, those of sequences one slice later; what no sequence judges stays unconfirmed."""
    p = Predictions(spark, sf_dir)
    path = new_shared_path(spark, "verdicts")
    lines, sequences = PartTable(spark, f"{path}/lines"), PartTable(spark, f"{path}/sequences")
    all_lines = written(p.line_predictions.select("log_id", "ts", "is_anomaly"), "line-verdicts")
    ends = F.dayofmonth(F.array_max(F.transform("original_logs", lambda x: x["ts"])))
    all_sequences = written(p.sequence_predictions.select("original_logs", "is_anomaly", ends.alias("day")), "sequence-verdicts")
    before = (0, -1)
    for days in SLICE_DAYS:
        lines.write(all_lines.filter(F.dayofmonth("ts").between(*days)))
        # sequences of the last slice are still open when the replay ends
        sequences.write(all_sequences.filter(F.col("day").between(*before)).drop("day"))
        before = days
        line_stream, sequence_stream = prediction_stream(spark, lines), prediction_stream(spark, sequences)
        for name, rows in (
            ("first", first_verdicts(line_stream)),
            ("final", final_verdicts(line_stream, sequence_stream, "12 days")),
        ):
            writer = rows.writeStream.format("parquet").outputMode("append").option("path", f"{path}/{name}")
            with watermark_policy(spark, slowest=True):
                query = writer.option("checkpointLocation", f"{path}/state-{name}").trigger(availableNow=True).start()
            query.awaitTermination()
    first, final = (spark.read.parquet(f"{path}/{n}").select("log_id", "verdict") for n in ("first", "final"))
    return first.unionByName(final)
