"""Routing, the anomaly feed, feedback, context lookup, ensemble and the flagship query."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from emberlog.operators import feedback as ops
from emberlog.operators import nextkey
from emberlog.operators.lines import dashboard_rows
from emberlog.plans import views as v
from emberlog.plans.nextkeys import LOOKUP, MODEL, POSITIONS, Experiment
from emberlog.plans.registry import query
from emberlog.sources.files import spread


class Predictions(Experiment):
    """Line and sequence predictions, and the stores they are routed to."""

    #: whether the query reads chunks as well, which need the cleaned logs stored
    with_sequences = True

    @cached_property
    def line_predictions(self):
        """One per log; slow values are anomalies."""
        logs = self.stored if self.with_sequences else self.cleaned
        return logs.withColumns({"type": F.lit("rapid"), "id": F.col("log_id").cast("string")})

    @cached_property
    def sequence_predictions(self):
        """One per chunk; every second one is an anomaly."""
        return self.stored_chunks.withColumns(
            {
                "type": F.lit("log_gpt"),
                "id": F.col("chunk_id"),
                "is_anomaly": (F.col("window_no") + F.col("chunk_no")) % 2 == 0,
            }
        )

    @cached_property
    def lines(self):
        return ops.route_lines(self.line_predictions)

    @cached_property
    def sequences(self):
        return ops.route_sequences(self.sequence_predictions)

    @cached_property
    def line_feedback(self):
        """Actions of users on every tenth line, also on ones that do not exist."""
        events = spread(v.table(self.spark, self.sf_dir, "events"), "event_id")
        number = F.col("event_id")
        return events.filter("event_id % 10 < 3").select(
            F.lit("rapid").alias("type"),
            F.when(number % 10 == 2, number + 1_000_000_000).otherwise(number).cast("string").alias("id"),
            F.when(number % 10 == 1, "confirm").otherwise("normal").alias("action"),
        )

    @cached_property
    def feedback(self):
        """Actions on lines and on first chunks; what asks about lines only takes ``line_feedback``, which needs no chunks."""
        on_chunks = self.stored_chunks.filter("chunk_no < 2").select(
            F.lit("log_gpt").alias("type"),
            F.col("chunk_id").alias("id"),
            F.when(F.col("chunk_no") == 0, "normal").otherwise("confirm").alias("action"),
        )
        return self.line_feedback.unionByName(on_chunks)


class LinePredictions(Predictions):
    """Of queries about lines only, which read the cleaned logs once and store none."""

    with_sequences = False


LINE_FEED = """SELECT 'rapid' AS type, CAST(log_id AS VARCHAR) AS id, hash, service, node AS nodes, filename AS filenames,
  epoch_us(ts) AS start_us, epoch_us(ts) AS end_us, original_text AS text FROM cleaned WHERE is_anomaly"""
SEQUENCE_FEED = f"""SELECT 'log_gpt' AS type, chunk_id AS id, {v.sql_hash64('joined')} AS hash, service, nodes, filename AS filenames,
  epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us, text FROM chunks JOIN (
    SELECT service, key, window_no, chunk_no, string_agg(node, ',' ORDER BY first_pos) AS nodes FROM (
      SELECT service, key, window_no, chunk_no, node, min(pos) AS first_pos FROM positioned GROUP BY ALL) GROUP BY ALL)
    USING (service, key, window_no, chunk_no)"""


def feed_rows(feed):
    return feed.select(
        "type", "id", "hash", "service", v.text_of("nodes").alias("nodes"), v.text_of("filenames").alias("filenames"),
        v.micros("start_ts").alias("start_us"), v.micros("end_ts").alias("end_us"), "text",
    )


@query(
    "H1_routed_predictions",
    v.with_views("cleaned", "chunks")
    + """SELECT 'rapid' AS type, service, 'ignore' AS train_strategy, count(*) AS n FROM cleaned WHERE is_anomaly GROUP BY ALL
         UNION ALL SELECT 'log_gpt', service, coalesce(train_strategy, 'ignore'), count(*) FROM chunks GROUP BY ALL""",
)
def routed(spark, sf_dir):
    p = Predictions(spark, sf_dir)
    both = p.lines.select("type", "service", F.lit("ignore").alias("train_strategy")).unionByName(
        p.sequences.select("type", "service", "train_strategy")
    )
    return both.groupBy("type", "service", "train_strategy").agg(F.count(F.lit(1)).alias("n"))


@query("H2_line_feed", v.with_views("cleaned") + LINE_FEED)
def line_feed(spark, sf_dir):
    return feed_rows(ops.unify_lines(LinePredictions(spark, sf_dir).lines))


@query("H3_sequence_feed", v.with_views("chunks") + SEQUENCE_FEED)
def sequence_feed(spark, sf_dir):
    return feed_rows(ops.unify_sequences(Predictions(spark, sf_dir).sequences))


@query(
    "H4_anomaly_feed",
    v.with_views("cleaned", "chunks")
    + f"{LINE_FEED} UNION ALL {SEQUENCE_FEED} WHERE (window_no + chunk_no) % 2 = 0 ORDER BY end_us DESC, id",
)
def feed(spark, sf_dir):
    p = Predictions(spark, sf_dir)
    return feed_rows(ops.anomaly_feed(p.lines, p.sequences))


@query(
    "C11_dashboard_rows",
    v.with_views("cleaned")
    + """SELECT service, node, filename, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS time, original_text AS log
         FROM cleaned WHERE is_anomaly""",
)
def dashboard(spark, sf_dir):
    return dashboard_rows(ops.unify_lines(LinePredictions(spark, sf_dir).lines))


@query(
    "H5_mark_normal_lines",
    v.with_views("cleaned") + "SELECT CAST(log_id AS VARCHAR) AS id, log_id % 10 <> 0 AS is_anomaly FROM cleaned WHERE is_anomaly",
)
def mark_normal_lines(spark, sf_dir):
    p = LinePredictions(spark, sf_dir)
    return ops.mark_normal_lines(p.lines, p.line_feedback).select("id", "is_anomaly")


@query(
    "H5_mark_normal_sequences",
    v.with_views("chunks")
    + """SELECT chunk_id AS id, chunk_no <> 0 AND (window_no + chunk_no) % 2 = 0 AS is_anomaly,
         CASE WHEN chunk_no = 0 THEN 'finetune' ELSE coalesce(train_strategy, 'ignore') END AS train_strategy FROM chunks""",
)
def mark_normal_sequences(spark, sf_dir):
    p = Predictions(spark, sf_dir)
    return ops.mark_normal_sequences(p.sequences, p.feedback).select("id", "is_anomaly", "train_strategy")


@query(
    "H5_marked_normals",
    v.with_views("cleaned") + "SELECT DISTINCT service, hash FROM cleaned WHERE is_anomaly AND log_id % 10 = 0",
)
def marked(spark, sf_dir):
    p = LinePredictions(spark, sf_dir)
    return ops.marked_lines(p.lines, p.line_feedback).select("service", "hash").distinct()


@query(
    "H5_unmatched_feedback",
    """SELECT 'rapid' AS type, CAST(CASE WHEN event_id % 10 = 2 THEN event_id + 1000000000 ELSE event_id END AS VARCHAR) AS id,
       CASE WHEN event_id % 10 = 1 THEN 'confirm' ELSE 'normal' END AS action, 'No document found' AS message
       FROM events WHERE event_id % 10 = 2 OR (event_id % 10 < 2 AND value < 60)""",
)
def unmatched(spark, sf_dir):
    p = Predictions(spark, sf_dir)
    return ops.unmatched_feedback(p.feedback, p.lines, p.sequences).select("type", "id", "action", "message")


@query(
    "H6_confirm_anomalies",
    v.with_views("cleaned", "chunks")
    + """SELECT 'rapid' AS type, CAST(log_id AS VARCHAR) AS id, log_id % 10 <> 1 AS prompt_user FROM cleaned WHERE is_anomaly
         UNION ALL SELECT 'log_gpt', chunk_id, chunk_no <> 1 FROM chunks""",
)
def confirmed(spark, sf_dir):
    p = Predictions(spark, sf_dir)
    return ops.confirm(p.lines, p.feedback, "rapid").select("type", "id", "prompt_user").unionByName(
        ops.confirm(p.sequences, p.feedback, "log_gpt").select("type", "id", "prompt_user")
    )


LOOKUP_SQL = """SELECT f.id AS anomaly_id, l.log_id FROM feed f JOIN logs l ON f.service = l.service
  AND list_contains(string_split(f.nodes, ','), l.node) AND f.filenames = l.filename
  AND epoch_us(l.ts) BETWEEN f.start_us - {us} AND f.end_us + {us}"""


@query(
    "H8_line_context",
    v.with_views("cleaned") + f", feed AS ({LINE_FEED}) " + LOOKUP_SQL.format(us=30 * 60_000_000),
)
def line_context(spark, sf_dir):
    entries = ops.unify_lines(ops.pending(LinePredictions(spark, sf_dir).lines))
    return ops.context_lookup(entries, v.logs(spark, sf_dir), 30).select("anomaly_id", "log_id")


@query(
    "H8_sequence_context",
    v.with_views("cleaned", "chunks") + f", feed AS ({SEQUENCE_FEED} WHERE (window_no + chunk_no) % 2 = 0) "
    + LOOKUP_SQL.format(us=60_000_000),
)
def sequence_context(spark, sf_dir):
    entries = ops.unify_sequences(ops.pending(Predictions(spark, sf_dir).sequences))
    return ops.context_lookup(entries, v.logs(spark, sf_dir)).select("anomaly_id", "log_id")


@query(
    "H9_ensemble",
    v.with_views("cleaned", "chunks")
    + """, l AS (SELECT log_id FROM cleaned WHERE is_anomaly),
         s AS (SELECT DISTINCT unnest(log_ids) AS log_id FROM chunks WHERE (window_no + chunk_no) % 2 = 0)
         SELECT coalesce(l.log_id, s.log_id) AS log_id, CASE WHEN l.log_id IS NULL THEN 'sequence_only'
           WHEN s.log_id IS NULL THEN 'line_only' ELSE 'confirmed' END AS verdict FROM l FULL JOIN s ON l.log_id = s.log_id""",
)
def ensemble(spark, sf_dir):
    p = Predictions(spark, sf_dir)
    return ops.ensemble(p.line_predictions, p.sequence_predictions)


def flagship(spark, sf_dir):
    """Chunks of even windows train the next-key model; anomalies among the others form the feed, newest first."""
    p = Predictions(spark, sf_dir)
    verdicts = nextkey.detect(p.test, p.model, p.top_k)
    predicted = nextkey.sequence_predictions(p.test, verdicts, p.services).withColumn("id", F.col("chunk_id"))
    return feed_rows(ops.anomaly_feed(p.lines, ops.route_sequences(predicted)))


@query(
    "H4_flagship_feed",
    v.with_views("cleaned", "chunks", "services") + f""", {POSITIONS}, {MODEL}, {LOOKUP},
      verdicts AS (SELECT chunk_id, count(*) FILTER (rank IS NULL OR rank > top_k) > 0 AS bad FROM looked GROUP BY 1),
      flagged AS (SELECT chunk_id AS id FROM verdicts JOIN chunks USING (chunk_id) JOIN services ON service = name
        WHERE bad AND NOT is_train)
      {LINE_FEED} UNION ALL SELECT * FROM ({SEQUENCE_FEED}) WHERE id IN (SELECT id FROM flagged)""",
)
def flagship_query(spark, sf_dir):
    return flagship(spark, sf_dir)
