"""Views over the provided tables that the registered queries start from, in Spark and in SQL.

Logs are made from ``events`` and services from the event types. Arrays and timestamps
leave a query as text or microseconds, so that two engines can be compared.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.text import hash64
from emberlog.operators.lines import clean, extract_traces, window_key
from emberlog.operators.services import with_defaults
from emberlog.operators.template_tree import assign, dictionary, mine
from emberlog.operators.templates import masked_templates
from emberlog.operators.windows import chunk_windows, count_windows, tag_train_strategy
from emberlog.session import written
from emberlog.sources.files import spread

WINDOW, CONTEXT = 20, 10
ANOMALY_VALUE = 60

_LOG_COLUMNS = """event_id AS log_id, event_type AS service,
  concat('node_', CAST(user_id % 4 AS STRING)) AS node,
  concat(event_type, '.log') AS filename, {ts} AS ts,
  concat(CASE user_id % 5 WHEN 0 THEN 'auth' WHEN 1 THEN 'cache' WHEN 2 THEN 'disk' WHEN 3 THEN 'net' ELSE 'sched' END,
    ' ', event_type, ' ',
    CASE WHEN value < 5 THEN 'fast' WHEN value < 20 THEN 'ok' WHEN value < 60 THEN 'slow' ELSE 'stalled' END,
    ' user=', CAST(user_id AS STRING), ' took ', CAST(CAST(value AS DECIMAL(10,2)) AS STRING),
    ' ms from 10.0.', CAST(user_id % 256 AS STRING), '.', CAST(event_id % 256 AS STRING), ':',
    CAST(1024 + event_id % 1000 AS STRING), ' blk_', CAST(event_id % 500 AS STRING), ' ', props) AS original_text,
  value >= 60 AS is_anomaly"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # the tables hold times without a zone; both engines read them as UTC
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_columns(spread(table(spark, sf_dir, "events"), "event_id"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def log_columns(events: DataFrame) -> DataFrame:
    return events.selectExpr(*_split_columns(_LOG_COLUMNS.format(ts="CAST(ts AS TIMESTAMP)")))


def _split_columns(text: str) -> list[str]:
    """Cut a select list at its top-level commas."""
    parts, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "()":
            depth += 1 if c == "(" else -1
        elif not quoted and c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One service per event type; its settings follow from the length of the name."""
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    rule = lambda p, r: F.struct(F.lit(p).alias("pattern"), F.lit(r).alias("replacement"))
    base = [
        rule("blk_-?[0-9]+", "BLK"),
        rule(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(:[0-9]{1,5})?", "IP"),
        rule("[0-9]+", "NUM"),
    ]
    size = F.length("name")
    traced = size > 5
    return with_defaults(
        names.select(
            F.concat(F.lit("svc_"), "name").alias("id"),
            "name",
            (size % 4 == 1).alias("is_train"),
            traced.alias("enable_trace"),
            F.lit("blk_([0-9]+)").alias("trace_regex"),
            (size - 2).alias("top_k"),
            (size * 100).alias("max_pretrain"),
            (-size / 2).alias("threshold"),
            F.when(traced, F.array(*base, rule('"k": NUM', "K"))).otherwise(F.array(*base)).alias("regex_subs"),
        )
    )


class LogTables:
    """The tables of one query run, each made once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def services(self) -> DataFrame:
        return written(services(self.spark, self.sf_dir), "services")

    @cached_property
    def cleaned(self) -> DataFrame:
        return clean(logs(self.spark, self.sf_dir), self.services)

    @cached_property
    def stored(self) -> DataFrame:
        return written(self.cleaned, "cleaned")

    @cached_property
    def mined(self) -> tuple[DataFrame, DataFrame]:
        """Distinct lines with their mined keys, and the tree of templates."""
        return mine(self.stored)

    @property
    def dictionary(self) -> DataFrame:
        return dictionary(self.mined[1])

    @cached_property
    def keyed(self) -> DataFrame:
        return assign(self.stored, self.mined[0])

    @cached_property
    def windowed_input(self) -> DataFrame:
        """Keyed logs with train strategy, trace id and window key."""
        tagged = tag_train_strategy(self.keyed, self.services)
        return window_key(extract_traces(tagged, self.services))

    @cached_property
    def chunks(self) -> DataFrame:
        windows = count_windows(self.windowed_input, WINDOW)
        return chunk_windows(windows, CONTEXT).withColumn("input_ids", F.col("chunk.input_ids"))

    @cached_property
    def stored_chunks(self) -> DataFrame:
        return written(self.chunks, "chunks")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LogTables(spark, sf_dir).cleaned


def templated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_templates(cleaned(spark, sf_dir))


def keyed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LogTables(spark, sf_dir).keyed


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LogTables(spark, sf_dir).chunks


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def text_of(array: str | Column) -> Column:
    """Array as comma-separated text."""
    column = F.col(array) if isinstance(array, str) else array
    return F.array_join(column.cast("array<string>"), ",")


def pseudo_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded lines from ``embeddings``: eight vectors each, the first for the line, the rest for its tokens.

    Even lines are normal points, odd ones queries.
    """
    vectors = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 8).cast("long").alias("line_id"), (F.col("vec_id") % 8).alias("slot"), "embedding"
    )
    gathered = vectors.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("slot", "embedding"))).alias("v"))
    every = F.transform("v", lambda x: x["embedding"].cast("array<double>"))
    return gathered.select(
        "line_id",
        F.concat(F.lit("s"), (F.floor(F.col("line_id") / 2) % 3).cast("string")).alias("service"),
        F.lpad(F.col("line_id").cast("string"), 9, "0").alias("hash"),
        (F.col("line_id") % 2 == 0).alias("is_normal"),
        every[0].alias("cls"),
        F.slice(every, 2, 8).alias("tokens"),
    ).filter(F.size("tokens") > 0)


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation frame: y = toxic label, score = length of the document."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(
        labels, "doc_id"
    )


# --- the same views in SQL -------------------------------------------------------------

HASH64 = "CAST(CAST(concat('0x', substr(sha256({0}), 1, 16)) AS UBIGINT) AS VARCHAR)"

SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "logs": ([], f"SELECT {_LOG_COLUMNS.format(ts='ts')} FROM events"),
    "services": (
        [],
        """SELECT DISTINCT event_type AS name, length(event_type) % 4 = 1 AS is_train,
           length(event_type) > 5 AS enable_trace, length(event_type) - 2 AS top_k,
           100 * length(event_type) AS max_pretrain, -length(event_type) / 2.0 AS threshold FROM events""",
    ),
    "cleaned_base": (
        ["logs"],
        r"""SELECT *, regexp_replace(regexp_replace(regexp_replace(original_text, 'blk_-?[0-9]+', 'BLK', 'g'),
           '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(:[0-9]{1,5})?', 'IP', 'g'), '[0-9]+', 'NUM', 'g') AS c0
           FROM logs""",
    ),
    "cleaned": (
        ["cleaned_base"],
        f"""SELECT *, {HASH64.format('cleaned_text')} AS hash FROM (
           SELECT * EXCLUDE (c0), CASE WHEN length(service) > 5 THEN replace(c0, '"k": NUM', 'K') ELSE c0 END
           AS cleaned_text FROM cleaned_base)""",
    ),
    "templated": (
        ["cleaned"],
        "SELECT *, regexp_replace(cleaned_text, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS template FROM cleaned",
    ),
    "dictionary": (
        ["templated"],
        """SELECT service, template, size, row_number() OVER (PARTITION BY service ORDER BY first_ts, first_id) + 3 AS key_id
           FROM (SELECT service, template, count(*) AS size, min(ts) AS first_ts, arg_min(log_id, (ts, log_id)) AS first_id
                 FROM templated GROUP BY service, template)""",
    ),
    # in these logs the lines of a group (service, token count, leading token) are alike enough for one template
    "mined_lines": (
        ["cleaned"],
        """SELECT *, len(string_split(cleaned_text, ' ')) AS _n, CASE WHEN regexp_matches(string_split(cleaned_text, ' ')[1], '[0-9]')
           THEN '<*>' ELSE string_split(cleaned_text, ' ')[1] END AS _head FROM cleaned""",
    ),
    "mined_dictionary": (
        ["mined_lines"],
        """SELECT service, _n, _head, template, size, 3 + row_number() OVER (PARTITION BY service ORDER BY first_ts, first_id) AS key_id
           FROM (SELECT service, _n, _head, string_agg(word, ' ' ORDER BY i) AS template FROM (
               SELECT service, _n, _head, i, CASE WHEN count(DISTINCT word) = 1 THEN min(word) ELSE '<*>' END AS word FROM (
                 SELECT DISTINCT service, _n, _head, unnest(range(1, _n + 1)) AS i, unnest(string_split(cleaned_text, ' ')) AS word
                 FROM mined_lines) GROUP BY ALL) GROUP BY ALL)
           JOIN (SELECT service, _n, _head, count(*) AS size, min(ts) AS first_ts, arg_min(log_id, (ts, log_id)) AS first_id
               FROM mined_lines GROUP BY ALL) USING (service, _n, _head)""",
    ),
    "keyed": (
        ["mined_lines", "mined_dictionary"],
        """SELECT l.* EXCLUDE (_n, _head), d.template, d.key_id FROM mined_lines l JOIN mined_dictionary d USING (service, _n, _head)""",
    ),
    "masked_keyed": (
        ["templated", "dictionary"],
        "SELECT t.*, d.key_id FROM templated t JOIN dictionary d USING (service, template)",
    ),
    "tagged": (
        ["keyed", "services"],
        """SELECT k.*, s.enable_trace, CASE WHEN s.is_train THEN CASE WHEN row_number() OVER
           (PARTITION BY k.service ORDER BY ts, log_id) - 1 <= s.max_pretrain THEN 'pre-train' ELSE 'finetune' END END
           AS train_strategy FROM keyed k JOIN services s ON k.service = s.name""",
    ),
    "window_input": (
        ["tagged"],
        """SELECT *, CASE WHEN enable_trace THEN coalesce(trace_id, node) ELSE node END AS key FROM (
           SELECT *, CASE WHEN enable_trace THEN nullif(regexp_extract(original_text, 'blk_([0-9]+)', 1), '') END
           AS trace_id FROM tagged)""",
    ),
    "positioned": (
        ["window_input"],
        f"""SELECT *, pos // {WINDOW} AS window_no, (pos % {WINDOW}) // {CONTEXT - 2} AS chunk_no FROM (
            SELECT *, row_number() OVER (PARTITION BY service, key ORDER BY ts, log_id) - 1 AS pos,
            count(*) OVER (PARTITION BY service, key) AS total FROM window_input)""",
    ),
    "chunks": (
        ["positioned"],
        f"""SELECT concat(service, '|', key, '|', window_no, '|', chunk_no) AS chunk_id, service, key,
            window_no, chunk_no, count(*) AS n_logs,
            string_agg(cleaned_text, chr(10) ORDER BY pos) AS joined,
            list_concat([0], list(CAST(key_id AS INTEGER) ORDER BY pos), [1],
              [2 for x in range({CONTEXT - 2} - count(*))]) AS input_ids,
            list_concat([0], list(CAST(key_id AS INTEGER) ORDER BY pos), [1]) AS ids,
            arg_min(train_strategy, pos) FILTER (train_strategy IS NOT NULL) AS train_strategy,
            string_agg(original_text, chr(10) ORDER BY pos) AS text, min(ts) AS start_ts, max(ts) AS end_ts,
            list(log_id ORDER BY pos) AS log_ids, min(node) AS any_node, list(node ORDER BY pos) AS all_nodes,
            min(filename) AS filename
            FROM positioned WHERE (window_no + 1) * {WINDOW} <= total
            GROUP BY service, key, window_no, chunk_no""",
    ),
    "lines": (
        [],
        """SELECT line_id, 's' || ((line_id // 2) % 3) AS service, lpad(CAST(line_id AS VARCHAR), 9, '0') AS hash,
           line_id % 2 = 0 AS is_normal, cls, tokens FROM (
           SELECT vec_id // 8 AS line_id, list(embedding ORDER BY vec_id)[1]::DOUBLE[] AS cls,
           list(embedding::DOUBLE[] ORDER BY vec_id)[2:8] AS tokens FROM embeddings GROUP BY vec_id // 8)
           WHERE len(tokens) > 0""",
    ),
    "scored": (
        [],
        "SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS score, l.toxic AS y FROM documents d JOIN labels l USING (doc_id)",
    ),
}


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the named views and what they need, in order."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in SQL_VIEWS[name][0]:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in needed) + "\n"


def sql_hash64(expression: str) -> str:
    return HASH64.format(expression)


def spark_hash64(column: str) -> Column:
    return hash64(F.col(column))
