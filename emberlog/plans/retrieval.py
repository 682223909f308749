"""Retrieval scoring over the pseudo lines of ``embeddings`` and over cleaned logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.detectors import RetrievalDetector
from emberlog.operators import retrieval as ops
from emberlog.operators.embeddings import embed_cached, embed_trigrams, embed_words, fit_word_vectors
from emberlog.plans import views as v
from emberlog.plans.registry import query
from emberlog.session import written

BLOCKS = 8  # tiny blocks, so that the blocked path runs on the test tables


def halves(spark, sf_dir):
    lines = v.pseudo_logs(spark, sf_dir)
    return lines.filter("NOT is_normal"), lines.filter("is_normal")


def _core_sql(k: str, distance: str, group: str = "service") -> str:
    return f"""core AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {group}, q_id ORDER BY distance, p_id) AS rank
      FROM (SELECT q.service, q.hash AS q_id, p.hash AS p_id, q.line_id, round({distance}, 9) AS distance
            FROM lines q JOIN lines p ON {'true' if group != 'service' else 'q.service = p.service'}
            AND NOT q.is_normal AND p.is_normal)) WHERE rank <= {k})"""


COSINE = "1 - list_cosine_similarity(q.cls, p.cls)"
EUCLID = "list_distance(q.cls, p.cls)"
MAXSIM = """maxsim AS (SELECT service, q_id, p_id, rank, n_tokens, 1 - sum(best) AS distance FROM (
  SELECT service, q_id, p_id, rank, n_tokens, qi, max(list_cosine_similarity(qt, pt)) AS best FROM (
    SELECT *, unnest(p.tokens) AS pt FROM (
      SELECT c.service, c.q_id, c.p_id, c.rank, len(q.tokens) AS n_tokens, unnest(q.tokens) AS qt,
        generate_subscripts(q.tokens, 1) AS qi FROM core c JOIN lines q ON q.hash = c.q_id) x
    JOIN lines p ON p.hash = x.p_id) GROUP BY ALL) GROUP BY ALL)"""
SCORES = """scores AS (SELECT service, q_id AS hash, min(distance) AS score, max(n_tokens) AS n_tokens FROM maxsim GROUP BY 1, 2)"""


def _core_rows(core, group="service"):
    return core.select("q_id", "p_id", F.round("distance", 6).alias("distance"), "rank", *([group] if group else []))


CORE_ONLINE = (
    v.with_views("lines") + f", {_core_sql('2 + line_id % 3', COSINE)} "
    "SELECT service, q_id, p_id, round(distance, 6) AS distance, rank FROM core"
)


@query("F5_core_set", CORE_ONLINE)
def core_set(spark, sf_dir):
    queries, points = halves(spark, sf_dir)
    sized = queries.withColumn("coreset_size", 2 + F.col("line_id") % 3)
    return _core_rows(ops.nearest_points(sized, points, "coreset_size"))


@query("F5_core_set_blocked", CORE_ONLINE)
def core_set_blocked(spark, sf_dir):
    queries, points = halves(spark, sf_dir)
    sized = queries.withColumn("coreset_size", 2 + F.col("line_id") % 3)
    return _core_rows(ops.nearest_points(sized, points, "coreset_size", block_rows=BLOCKS))


@query("F5_core_set_hashed")
def core_set_hashed(spark, sf_dir):
    queries, points = halves(spark, sf_dir)
    return _core_rows(ops.nearest_points_lsh(queries, points, 2, radius=1.5, bucket_length=2.0))


@query(
    "F6_core_set_offline",
    v.with_views("lines") + ", n AS (SELECT greatest(2, round_even(0.01 * count(*), 0)) AS n FROM lines WHERE is_normal), "
    + _core_sql("(SELECT n FROM n)", EUCLID, "q_id")
    + " SELECT q_id, p_id, round(distance, 6) AS distance, rank FROM core WHERE rank > 1",
)
def core_set_offline(spark, sf_dir):
    queries, points = halves(spark, sf_dir)
    corpus = lambda df: df.withColumn("corpus", F.lit(0))
    k = ops.core_set_size(points.count())
    core = ops.nearest_points(corpus(queries), corpus(points), k, "euclidean", "corpus", block_rows=BLOCKS)
    return _core_rows(core.filter("rank > 1"), None)


@query(
    "F7_maxsim",
    v.with_views("lines") + f", {_core_sql('2', COSINE)}, {MAXSIM} "
    "SELECT service, q_id, p_id, rank, n_tokens, round(distance, 6) AS maxsim FROM maxsim",
)
def maxsim(spark, sf_dir):
    queries, points = halves(spark, sf_dir)
    scored = ops.score_pairs(ops.nearest_points(queries, points, 2), queries, points)
    return scored.select("service", "q_id", "p_id", "rank", "n_tokens", F.round("maxsim", 6).alias("maxsim"))


@query(
    "F8_line_scores",
    v.with_views("lines") + f", {_core_sql('2', COSINE)}, {MAXSIM}, {SCORES} "
    "SELECT service, hash, n_tokens, round(score, 6) AS score, round((score - 1) / n_tokens + 1, 6) AS score_per_token FROM scores",
)
def scores(spark, sf_dir):
    queries, points = halves(spark, sf_dir)
    scored = ops.score_lines(queries, points, 2)
    return scored.select(
        "service", "hash", "n_tokens", F.round("score", 6).alias("score"),
        F.round("score_per_token", 6).alias("score_per_token"),
    )


def line_services(spark, sf_dir):
    """One service per group of pseudo lines; the threshold and mode follow from its number."""
    number = F.substring("service", 2, 9).cast("int")
    return v.pseudo_logs(spark, sf_dir).select("service").distinct().select(
        F.col("service").alias("name"),
        (-0.2 - number / 10).alias("threshold"),
        (number == 2).alias("is_train"),
    )


@query(
    "F9_threshold",
    v.with_views("lines") + f", {_core_sql('2', COSINE)}, {MAXSIM}, {SCORES} "
    "SELECT service, hash, score > -0.2 - CAST(substr(service, 2) AS INTEGER) / 10 AS is_anomaly FROM scores",
)
def threshold(spark, sf_dir):
    queries, points = halves(spark, sf_dir)
    judged = ops.judge(ops.score_lines(queries, points, 2), line_services(spark, sf_dir))
    return judged.select("service", "hash", "is_anomaly")


@query(
    "F2_upsert_normals",
    v.with_views("lines")
    + """SELECT service, hash, max(version) AS version, round(arg_max(first, version), 6) AS first FROM (
           SELECT service, hash, 0 AS version, cls[1] AS first FROM lines WHERE is_normal
           UNION ALL SELECT service, hash, 1, cls[2] FROM lines WHERE line_id % 3 = 0) GROUP BY service, hash""",
)
def upsert(spark, sf_dir):
    lines = v.pseudo_logs(spark, sf_dir)
    store = lines.filter("is_normal").select("service", "hash", F.lit(0).alias("version"), F.get("cls", F.lit(0)).alias("first"))
    added = lines.filter("line_id % 3 = 0").select("service", "hash", F.lit(1).alias("version"), F.get("cls", F.lit(1)).alias("first"))
    return ops.upsert_normals(store, added).select("service", "hash", "version", F.round("first", 6).alias("first"))


NORMALS = "normals AS (SELECT DISTINCT service, hash FROM cleaned WHERE day(ts) <= 2 AND NOT is_anomaly)"


@query(
    "F3_unknown_lines",
    v.with_views("cleaned")
    + f", {NORMALS} SELECT log_id, hash FROM cleaned WHERE (service, hash) NOT IN (SELECT (service, hash) FROM normals)",
)
def unknown(spark, sf_dir):
    logs = v.cleaned(spark, sf_dir)
    store = logs.filter((F.dayofmonth("ts") <= 2) & ~F.col("is_anomaly")).select("service", "hash").distinct()
    return ops.unknown_lines(logs, store).select("log_id", "hash")


@query(
    "F10_training_seeds",
    v.with_views("cleaned", "services")
    + f""", {NORMALS}, seeds AS (SELECT c.service, hash, arg_min(log_id, (ts, log_id)) AS log_id FROM cleaned c JOIN services s
            ON s.name = c.service AND s.is_train WHERE (service, hash) NOT IN (SELECT (service, hash) FROM normals) GROUP BY 1, 2)
          SELECT service, hash, log_id FROM seeds""",
)
def seeds(spark, sf_dir):
    logs = v.cleaned(spark, sf_dir)
    store = logs.filter((F.dayofmonth("ts") <= 2) & ~F.col("is_anomaly")).select("service", "hash").distinct()
    training, _ = ops.split_training(ops.unknown_lines(logs, store), v.services(spark, sf_dir))
    return ops.first_occurrences(training, ["service", "hash"]).select("service", "hash", "log_id")


TOKENS = r"[x for x in string_split(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ') if x <> '']"
TRIGRAMS = """[CAST(len([s for s in [(ascii(substr('#' || {t} || '#', i, 1)) * 961 + ascii(substr('#' || {t} || '#', i + 1, 1)) * 31
  + ascii(substr('#' || {t} || '#', i + 2, 1))) % 32 for i in range(1, length({t}) + 1)] if s = d]) AS DOUBLE) for d in range(0, 32)]"""


@query(
    "F1_trigram_vectors",
    f"""WITH t AS (SELECT conv_id, turn, unnest({TOKENS.format('text')}) AS token FROM conversations),
        x AS MATERIALIZED (SELECT token, {TRIGRAMS.format(t='token')} AS vec FROM (SELECT DISTINCT token FROM t)),
        n AS (SELECT conv_id, turn, token, count(*) AS n FROM t GROUP BY ALL),
        s AS (SELECT conv_id, turn, d, CAST(sum(n * vec[d]) AS BIGINT) AS x FROM n JOIN x USING (token), range(1, 33) r(d) GROUP BY ALL)
        SELECT conv_id, turn, string_agg(CAST(x AS VARCHAR), ',' ORDER BY d) AS cls,
          (SELECT sum(n.n) FROM n WHERE n.conv_id = s.conv_id AND n.turn = s.turn) AS n_tokens FROM s GROUP BY conv_id, turn""",
)
def trigram_vectors(spark, sf_dir):
    embedded = embed_trigrams(v.table(spark, sf_dir, "conversations"), "text")
    return embedded.select(
        "conv_id", "turn", F.size("tokens").alias("n_tokens"),
        v.text_of(F.transform("cls", lambda x: x.cast("long"))).alias("cls"),
    )


OFFLINE = f"""texts AS (SELECT cleaned_text, hash, bool_or(day(ts) <= 15 AND NOT is_anomaly) AS is_normal,
    bool_or(day(ts) > 15) AS is_test FROM cleaned GROUP BY 1, 2),
  tokens AS (SELECT hash, is_normal, is_test, unnest({TOKENS.format('cleaned_text')}) AS token,
    generate_subscripts({TOKENS.format('cleaned_text')}, 1) AS pos FROM texts),
  vecs AS MATERIALIZED (SELECT token, {TRIGRAMS.format(t='token')} AS vec FROM (SELECT DISTINCT token FROM tokens)),
  tv AS MATERIALIZED (SELECT t.*, vec FROM tokens t JOIN vecs USING (token)),
  dims AS (SELECT hash, is_normal, is_test, d, sum(vec[d]) AS x FROM tv, range(1, 33) r(d) GROUP BY ALL),
  cls AS MATERIALIZED (SELECT hash, is_normal, is_test, list(x ORDER BY d) AS cls FROM dims GROUP BY ALL),
  size AS (SELECT greatest(2, round_even(0.01 * count(*), 0)) AS n FROM cls WHERE is_normal),
  core AS (SELECT * FROM (SELECT q.hash AS q_id, p.hash AS p_id, row_number() OVER (PARTITION BY q.hash
      ORDER BY round(list_distance(q.cls, p.cls), 9), p.hash) AS rank FROM cls q JOIN cls p ON q.is_test AND p.is_normal)
    WHERE rank > 1 AND rank <= (SELECT n FROM size)),
  pairs AS (SELECT q_id, p_id, 1 - sum(best) AS distance FROM (
    SELECT q_id, p_id, q.pos, max(list_cosine_similarity(q.vec, p.vec)) AS best FROM core
    JOIN tv q ON q.hash = q_id JOIN tv p ON p.hash = p_id GROUP BY ALL) GROUP BY ALL),
  best AS (SELECT q_id AS hash, min(distance) AS score FROM pairs GROUP BY 1)"""


@query(
    "F12_unique_scores",
    v.with_views("cleaned")
    + f", {OFFLINE} SELECT log_id, round(score, 6) AS score FROM cleaned JOIN best USING (hash) WHERE day(ts) > 15",
)
def unique_scores(spark, sf_dir):
    logs = v.cleaned(spark, sf_dir)
    detector = RetrievalDetector().fit(logs.filter((F.dayofmonth("ts") <= 15) & ~F.col("is_anomaly")))
    scored = detector.transform(logs.filter(F.dayofmonth("ts") > 15))
    return scored.select("log_id", F.round("score", 6).alias("score"))


@query(
    "F4_embedding_cache",
    v.with_views("cleaned")
    + """, cached AS (SELECT DISTINCT hash FROM cleaned WHERE day(ts) <= 2 AND NOT is_anomaly)
         SELECT hash, hash NOT IN (SELECT hash FROM cached) AS is_new, count(*) AS n FROM cleaned GROUP BY 1""",
)
def embedding_cache(spark, sf_dir):
    logs = written(v.cleaned(spark, sf_dir), "cleaned")
    early = logs.filter((F.dayofmonth("ts") <= 2) & ~F.col("is_anomaly")).select("hash", "cleaned_text").distinct()
    cache = written(embed_trigrams(early).select("hash", "cls", "tokens"), "cache")
    vectors, added = embed_cached(logs, cache, embed_trigrams)
    known = vectors.select("hash").join(added.select("hash", F.lit(True).alias("is_new")), "hash", "left")
    counts = logs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "hash").select("hash", F.coalesce("is_new", F.lit(False)).alias("is_new"), "n")


@query(
    "F11_grown_normals",
    v.with_views("lines") + f", {_core_sql('2', COSINE)}, {MAXSIM}, {SCORES} "
    "SELECT service, hash FROM lines WHERE is_normal UNION ALL "
    "SELECT service, hash FROM scores WHERE score <= -0.2 - CAST(substr(service, 2) AS INTEGER) / 10",
)
def grown_normals(spark, sf_dir):
    queries, points = halves(spark, sf_dir)
    judged = ops.judge(ops.score_lines(queries, points, 2), line_services(spark, sf_dir))
    learned = judged.filter("NOT is_anomaly").select("service", "hash", F.lit(1).alias("version"))
    store = points.select("service", "hash", F.lit(0).alias("version"))
    return ops.upsert_normals(store, learned).select("service", "hash")


@query(
    "F1_word_vectors",
    """WITH w AS (SELECT conv_id || '/' || turn AS key, [x for x in string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ')
         if x <> ''] AS words FROM conversations),
       c AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM w) GROUP BY word),
       f AS (SELECT n, sum(count(*)) OVER (ORDER BY n DESC) AS upto FROM c GROUP BY n),
       known AS (SELECT word FROM c WHERE n >= (SELECT min(n) FROM f WHERE upto <= 2000))
       SELECT w.key, 8 AS dim, count(known.word) AS n_tokens, count(known.word) = 0 AS is_zero
       FROM (SELECT key, unnest(CASE WHEN len(words) = 0 THEN [''] ELSE words END) AS word FROM w) w LEFT JOIN known USING (word) GROUP BY w.key""".replace("\\\\", "\\"),
)
def word_vectors(spark, sf_dir):
    talk = v.table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    model = fit_word_vectors(talk, "text", dim=8, max_words=2000)
    rows = embed_words(talk.select("key", "text"), model, "key", "text")
    zero = F.forall("cls", lambda x: x == 0)
    return rows.select("key", F.size("cls").alias("dim"), F.size("tokens").cast("long").alias("n_tokens"), zero.alias("is_zero"))
