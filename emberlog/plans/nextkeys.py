"""Next-key model: training, detection, costs, updates. Even windows train, odd ones are judged."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from emberlog.detectors import NextKeyDetector
from emberlog.operators import nextkey as ops
from emberlog.operators.lines import extract_traces, window_key
from emberlog.operators.policy import initial_policy, policy_step
from emberlog.operators.templates import vocabulary_size
from emberlog.operators.windows import ORDER, chunk_windows, count_windows, tag_train_strategy
from emberlog.plans import views as v
from emberlog.plans.registry import query
from emberlog.plans.windows import SESSIONS, positioned_sessions, sessions
from emberlog.session import new_shared_path, written
from emberlog.sources.tables import PartTable

POSITIONS = """positions AS (SELECT chunk_id, service, window_no, train_strategy, len(ids) AS n_ids, i - 1 AS pos,
    ids[greatest(i - 2, 1):i - 1] AS context, ids[i] AS next_id FROM (
    SELECT *, unnest(range(2, len(ids) + 1)) AS i FROM chunks)),
  suffixes AS (SELECT *, context[len(context) - m + 1:len(context)] AS suffix FROM (
    SELECT *, unnest(range(0, len(context) + 1)) AS m FROM positions)),
  counts AS (SELECT service, suffix AS context, next_id, count(*) AS n FROM suffixes WHERE window_no % 2 = 0 GROUP BY ALL)"""
MODEL = """model AS (SELECT *, row_number() OVER (PARTITION BY service, context ORDER BY n DESC, next_id) AS rank,
  sum(n) OVER (PARTITION BY service, context) AS total FROM counts)"""
LOOKUP = """contexts AS (SELECT DISTINCT service, context, total FROM model),
  resolved AS (SELECT chunk_id, s.service, n_ids, pos, next_id, max(m) AS used, arg_max(suffix, m) AS seen, arg_max(total, m) AS total
    FROM suffixes s JOIN contexts c ON s.service = c.service AND s.suffix = c.context WHERE window_no % 2 = 1 GROUP BY ALL),
  looked AS (SELECT r.*, m.rank, m.n, length(r.service) - 2 AS top_k FROM resolved r LEFT JOIN model m
    ON r.service = m.service AND r.seen = m.context AND r.next_id = m.next_id)"""


class Experiment(v.LogTables):
    """Chunks split into training and test, and what the detector needs per service."""

    @cached_property
    def training(self):
        return self.stored_chunks.filter("window_no % 2 = 0")

    @cached_property
    def test(self):
        return self.stored_chunks.filter("window_no % 2 = 1")

    @cached_property
    def model(self):
        return written(ops.train(self.training), "model")

    @cached_property
    def top_k(self):
        return self.services.select(F.col("name").alias("service"), "top_k")

    @cached_property
    def settings(self):
        return written(self.top_k.join(vocabulary_size(self.dictionary), "service"), "settings")


class KeyExperiment(Experiment):
    """The same for queries that read key sequences and no logs.

    The chunks keep ``kept`` of their logs, and no text is stored or moved for them unless it is named.
    """

    def __init__(self, spark, sf_dir, *kept: str):
        super().__init__(spark, sf_dir)
        self.kept = ["key_id", *kept]

    @cached_property
    def stored(self):
        rows = window_key(extract_traces(self.cleaned, self.services))
        return written(rows.select("service", "key", *ORDER, "cleaned_text"), "cleaned-keys")

    @cached_property
    def windowed_input(self):
        return tag_train_strategy(self.keyed, self.services) if "train_strategy" in self.kept else self.keyed

    @cached_property
    def chunks(self):
        windows = count_windows(self.windowed_input, v.WINDOW, kept=self.kept)
        chunks = chunk_windows(windows, v.CONTEXT).withColumn("input_ids", F.col("chunk.input_ids"))
        # what the texts of a chunk tell of it is their hash
        told = ["hash" if c == "cleaned_text" else c for c in self.kept[1:]]
        return chunks.select("chunk_id", "service", "window_no", "input_ids", *told)


@query(
    "G1_training_sets",
    v.with_views("chunks")
    + """SELECT coalesce(train_strategy, 'ignore') AS train_strategy, service, count(*) AS n_chunks, sum(len(ids)) AS n_ids
         FROM chunks GROUP BY 1, 2""",
)
def training_sets(spark, sf_dir):
    return ops.training_set_sizes(v.chunks(spark, sf_dir))


@query(
    "G1_pretrain_chunks",
    v.with_views("chunks")
    + "SELECT service, chunk_id, array_to_string(input_ids, ',') AS input_ids FROM chunks WHERE train_strategy = 'pre-train'",
)
def pretrain_chunks(spark, sf_dir):
    return ops.training_sets(v.chunks(spark, sf_dir), "pre-train").select(
        "service", "chunk_id", v.text_of("input_ids").alias("input_ids")
    )


def model_rows(model):
    return model.select("service", v.text_of("context").alias("context"), "next_id", "n", "rank", "total")


@query(
    "G2_next_key_model",
    v.with_views("chunks") + f", {POSITIONS}, {MODEL} "
    "SELECT service, array_to_string(context, ',') AS context, next_id, n, rank, CAST(total AS BIGINT) AS total FROM model",
)
def model(spark, sf_dir):
    return model_rows(ops.train(KeyExperiment(spark, sf_dir).training))


@query(
    "G3_top_k_detection",
    v.with_views("chunks") + f""", {POSITIONS}, {MODEL}, {LOOKUP}
      SELECT chunk_id, service, count(*) AS n_positions, count(*) FILTER (rank IS NULL OR rank > top_k) AS n_miss,
      min(pos) FILTER (rank IS NULL OR rank > top_k) AS first_miss_pos,
      count(*) FILTER (rank IS NULL OR rank > top_k) > 0 AS is_anomaly FROM looked GROUP BY 1, 2""",
)
def detect(spark, sf_dir):
    e = KeyExperiment(spark, sf_dir)
    return ops.detect(e.test, e.model, e.top_k)


SIZES = "sizes AS (SELECT service, count(*) + 3 AS vocab_size FROM mined_dictionary GROUP BY service)"


@query(
    "G4_policy_cost",
    v.with_views("chunks") + f""", {POSITIONS}, {MODEL}, {LOOKUP}, {SIZES}
      SELECT chunk_id, reward, prompt_len, round(log_prob, 6) AS log_prob, round(0.0 - reward * log_prob, 6) AS cost FROM (
        SELECT chunk_id, CAST(CASE WHEN floor(0.8 * n_ids) < 2 THEN 2 WHEN floor(0.8 * n_ids) >= n_ids - 2 THEN n_ids - 2
          ELSE floor(0.8 * n_ids) END AS INTEGER) AS prompt_len,
          sum(CASE WHEN rank <= top_k THEN 1 ELSE -1 END) AS reward,
          sum(ln((coalesce(n, 0) + 1) / (total + vocab_size))) AS log_prob
        FROM looked JOIN sizes USING (service) WHERE pos >= floor(0.8 * n_ids) GROUP BY 1, 2)""",
)
def policy_cost(spark, sf_dir):
    e = KeyExperiment(spark, sf_dir)
    cost = ops.policy_cost(e.test, e.model, e.settings)
    return cost.select(
        "chunk_id", "reward", "prompt_len", F.round("log_prob", 6).alias("log_prob"), F.round("cost", 6).alias("cost")
    )


@query(
    "G6_fine_tuned_model",
    v.with_views("chunks") + f", {POSITIONS.replace('counts AS', 'base AS')}" + """,
      extra AS (SELECT service, suffix AS context, next_id, 2 * count(*) AS n FROM suffixes
        WHERE train_strategy = 'finetune' GROUP BY ALL),
      counts AS (SELECT service, context, next_id, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY ALL), """ + MODEL
    + " SELECT service, array_to_string(context, ',') AS context, next_id, n, rank, CAST(total AS BIGINT) AS total FROM model",
)
def fine_tuned(spark, sf_dir):
    e = KeyExperiment(spark, sf_dir, "train_strategy")
    return model_rows(ops.update(e.model, ops.training_sets(e.stored_chunks, "finetune"), weight=2))


@query(
    "G6_reward_step",
    v.with_views("chunks") + f""", {POSITIONS}, {MODEL}, {LOOKUP}, {SIZES},
      played AS (SELECT chunk_id, service, seen, next_id, CASE WHEN rank <= top_k THEN 1 ELSE -1 END AS gain
        FROM looked WHERE pos >= floor(0.8 * n_ids)),
      rewards AS (SELECT chunk_id, service, sum(gain) AS reward FROM played GROUP BY ALL),
      sequences AS (SELECT service, count(*) AS n_sequences FROM rewards GROUP BY 1),
      by_key AS (SELECT p.service, seen, next_id, sum(reward) AS got FROM played p JOIN rewards USING (chunk_id) GROUP BY ALL),
      by_context AS (SELECT service, seen, sum(got) AS whole FROM by_key GROUP BY ALL),
      weights AS (SELECT service, context, next_id, 1 AS n_keys, ln((n + 1) / (total + vocab_size)) AS w FROM model JOIN sizes USING (service)
        UNION ALL SELECT service, context, NULL, any_value(vocab_size) - count(*), any_value(ln(1 / (total + vocab_size)))
        FROM model JOIN sizes USING (service) GROUP BY ALL),
      fresh AS (SELECT k.service, seen AS context, k.next_id FROM by_key k ANTI JOIN model m
        ON m.service = k.service AND m.context = k.seen AND m.next_id = k.next_id),
      given AS (SELECT * FROM weights UNION ALL
        SELECT f.service, f.context, f.next_id, 1, w.w FROM fresh f JOIN weights w ON w.service = f.service AND w.context = f.context AND w.next_id IS NULL)
      SELECT g.service, array_to_string(g.context, ',') AS context, g.next_id,
        CASE WHEN g.next_id IS NULL THEN g.n_keys - (SELECT count(*) FROM fresh f WHERE f.service = g.service AND f.context = g.context)
          ELSE g.n_keys END AS n_keys,
        round(g.w + coalesce(0.5 / n_sequences * (coalesce(got, 0) - whole * exp(g.w)), 0), 6) AS weight
      FROM given g LEFT JOIN by_context c ON c.service = g.service AND c.seen = g.context
        LEFT JOIN by_key k ON k.service = g.service AND k.seen = g.context AND k.next_id = g.next_id
        LEFT JOIN sequences s ON s.service = g.service""",
)
def reward_step(spark, sf_dir):
    """One step of the model's policy on the sequences that are judged."""
    e = KeyExperiment(spark, sf_dir)
    stepped = policy_step(e.test, written(initial_policy(e.model, e.settings), "policy"), e.settings, rate=0.5)
    return stepped.select("service", v.text_of("context").alias("context"), "next_id", "n_keys", F.round("weight", 6).alias("weight"))


@query(
    "G7_training_summary",
    """WITH history AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS episode, max(value) AS loss FROM events GROUP BY 1, 2),
       stalls AS (SELECT *, sum(CASE WHEN last - loss <= 0.01 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY episode) AS stalls
         FROM (SELECT *, lag(loss, 1, 0.0) OVER (PARTITION BY user_id ORDER BY episode) AS last FROM history))
       SELECT user_id, min(episode) FILTER (stalls > 3) AS stopped_at,
         arg_min(episode, (loss, episode)) FILTER (stalls <= 3) AS best_step,
         min(loss) FILTER (stalls <= 3) AS best_loss, count(*) FILTER (stalls <= 3) AS steps_kept FROM stalls GROUP BY 1""",
)
def summary(spark, sf_dir):
    """Loss histories made from ``events``: a user's largest value per day."""
    events = v.table(spark, sf_dir, "events")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("long")
    history = events.groupBy("user_id", day.alias("episode")).agg(F.max("value").alias("loss"))
    return ops.training_summary(history, "user_id")


@query(
    "G8_held_out_loss",
    v.with_views("chunks") + f""", {POSITIONS}, {MODEL}, {LOOKUP}, {SIZES}
      SELECT service, count(*) AS n_positions, round(avg(-ln((coalesce(n, 0) + 1) / (total + vocab_size))), 6) AS loss
      FROM looked JOIN sizes USING (service) GROUP BY service""",
)
def held_out(spark, sf_dir):
    e = KeyExperiment(spark, sf_dir)
    loss = ops.held_out_loss(e.test, e.model, e.settings)
    return loss.select("service", "n_positions", F.round("loss", 6).alias("loss"))


@query(
    "G10_sequence_predictions",
    v.with_views("chunks", "services") + f""", {POSITIONS}, {MODEL}, {LOOKUP},
      verdicts AS (SELECT chunk_id, count(*) FILTER (rank IS NULL OR rank > top_k) > 0 AS bad FROM looked GROUP BY 1)
      SELECT 'log_gpt' AS type, c.chunk_id, c.service, {v.sql_hash64('joined')} AS hash, NOT is_train AND coalesce(bad, false) AS is_anomaly
      FROM chunks c JOIN services s ON c.service = s.name LEFT JOIN verdicts USING (chunk_id)
      WHERE window_no % 2 = 1 AND (is_train OR bad)""",
)
def predictions(spark, sf_dir):
    e = KeyExperiment(spark, sf_dir, "cleaned_text")
    found = ops.sequence_predictions(e.test, ops.detect(e.test, e.model, e.top_k), e.services)
    return found.select("type", "chunk_id", "service", "hash", "is_anomaly")


@query(
    "G9_model_versions",
    v.with_views("chunks") + f", {POSITIONS.replace('WHERE window_no % 2 = 0 GROUP BY ALL', 'GROUP BY ALL')}, {MODEL} "
    "SELECT service, array_to_string(context, ',') AS context, next_id, n, rank, CAST(total AS BIGINT) AS total FROM model",
)
def model_versions(spark, sf_dir):
    """The first version has seen the even windows; the second adds the odd ones."""
    e = KeyExperiment(spark, sf_dir)
    versions = PartTable(spark, new_shared_path(spark, "models"))
    versions.write(ops.train(e.training))
    versions.write(ops.update(versions.latest(), e.test))
    return model_rows(versions.latest())


SESSION_CHUNKS = """chunks AS (SELECT block_id AS chunk_id, '' AS service, CAST(NULL AS VARCHAR) AS train_strategy,
  CAST(substr(block_id, 5) AS BIGINT) % 2 AS window_no, list_concat([0], ids, [1]) AS ids FROM sessions)"""


@query(
    "G11_next_key_detector",
    v.with_views("keyed") + f""", {SESSIONS}, {SESSION_CHUNKS.replace('ids, [1])', 'ids[1:254], [1])')}, {POSITIONS}, {MODEL},
      {LOOKUP.replace('length(r.service) - 2', '20')}
      SELECT chunk_id AS sid, count(*) AS n_positions, count(*) FILTER (rank IS NULL OR rank > top_k) AS n_miss,
      count(*) FILTER (rank IS NULL OR rank > top_k) > 0 AS is_predicted FROM looked GROUP BY 1""",
)
def detector(spark, sf_dir):
    rows = written(sessions(spark, sf_dir, first=256), "sessions").withColumnRenamed("block_id", "sid")
    even = F.substring("sid", 5, 20).cast("long") % 2 == 0
    fitted = NextKeyDetector(top_k=20).fit(rows.filter(even))
    return fitted.transform(rows.filter(~even), "sid").select("sid", "n_positions", "n_miss", "is_predicted")


@query(
    "G11_sliding_detector",
    v.with_views("keyed") + f""", {SESSIONS}, {SESSION_CHUNKS.replace('list_concat([0], ids, [1]) AS ids', 'ids')}, {POSITIONS}, {MODEL},
      {LOOKUP.replace('length(r.service) - 2', '20')}
      SELECT chunk_id AS sid, count(*) AS n_positions, count(*) FILTER (rank IS NULL OR rank > top_k) AS n_miss,
      count(*) FILTER (rank IS NULL OR rank > top_k) > 0 AS is_predicted FROM looked GROUP BY 1""",
)
def sliding_detector(spark, sf_dir):
    """The same sessions as bare windows of keys, whole and without begin and end."""
    rows = written(positioned_sessions(spark, sf_dir), "sessions").withColumnRenamed("block_id", "sid")
    even = F.substring("sid", 5, 20).cast("long") % 2 == 0
    fitted = NextKeyDetector(top_k=20, sliding=True).fit_positions(rows.filter(even), "sid")
    found = fitted.judge_positions(rows.filter(~even), "sid")
    return found.select("sid", "n_positions", "n_miss", "is_predicted")
