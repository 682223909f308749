"""Template mining and log keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import template_tree as tree
from emberlog.operators import templates as ops
from emberlog.plans import views as v
from emberlog.plans.registry import query
from emberlog.session import written


@query("D1_masked_templates", v.with_views("templated") + "SELECT log_id, template FROM templated")
def masked(spark, sf_dir):
    return v.templated(spark, sf_dir).select("log_id", "template")


# in these logs all lines of a leaf (service, token count, leading token) are alike enough for one template
@query(
    "D1_mined_templates",
    v.with_views("cleaned")
    + """, words AS (SELECT service, cleaned_text, string_split(cleaned_text, ' ') AS w FROM (SELECT DISTINCT service, cleaned_text FROM cleaned)),
         cells AS (SELECT service, len(w) AS n, w[1] AS head, unnest(range(1, len(w) + 1)) AS i, w FROM words),
         merged AS (SELECT service, n, head, i, CASE WHEN count(DISTINCT w[i]) = 1 THEN any_value(w[i]) ELSE '<*>' END AS word
           FROM cells GROUP BY ALL),
         templates AS (SELECT service, n, head, string_agg(word, ' ' ORDER BY i) AS template FROM merged GROUP BY ALL)
         SELECT t.service, template, count(*) AS size FROM cleaned c JOIN templates t ON c.service = t.service
           AND len(string_split(cleaned_text, ' ')) = n AND string_split(cleaned_text, ' ')[1] = head GROUP BY ALL""",
)
def mined(spark, sf_dir):
    logs = v.cleaned(spark, sf_dir)
    fitted = ops.fit_templates(logs)
    found = ops.assign_fitted(logs, fitted)
    return found.groupBy("service", "template").agg(F.count(F.lit(1)).alias("size"))


MINED = """words AS (SELECT *, string_split(cleaned_text, ' ') AS w FROM cleaned),
  leaves AS (SELECT *, len(w) AS n, CASE WHEN regexp_matches(w[1], '[0-9]') THEN '<*>' ELSE w[1] END AS head FROM words),
  cells AS (SELECT DISTINCT service, n, head, unnest(range(1, n + 1)) AS i, unnest(w) AS word FROM leaves),
  texts AS (SELECT service, n, head, string_agg(word, ' ' ORDER BY i) AS template FROM (
    SELECT service, n, head, i, CASE WHEN count(*) = 1 THEN any_value(word) ELSE '<*>' END AS word FROM cells GROUP BY ALL) GROUP BY ALL),
  facts AS (SELECT service, n, head, min(ts) AS f_ts, arg_min(log_id, (ts, log_id)) AS f_id, min(day(ts)) AS f_day, count(*) AS size
    FROM leaves GROUP BY ALL),
  numbered AS (SELECT *, 3 + row_number() OVER (PARTITION BY service ORDER BY f_day > 10, f_ts, f_id) AS key_id FROM facts)"""


@query(
    "D5_grow_mined_templates",
    v.with_views("cleaned") + f", {MINED} SELECT service, template, key_id, size FROM numbered JOIN texts USING (service, n, head)",
)
def grown_mined(spark, sf_dir):
    """Mined from the first days, then grown by the others."""
    logs = written(v.cleaned(spark, sf_dir), "cleaned")
    _, known = ops.mined_keys(logs.filter(F.dayofmonth("ts") <= 10))
    return ops.mined_keys(logs.filter(F.dayofmonth("ts") > 10), known)[1]


@query(
    "D2_assign_mined_keys",
    v.with_views("cleaned")
    + f", {MINED.replace('f_day > 10, ', '')} SELECT log_id, key_id FROM leaves JOIN numbered USING (service, n, head)",
)
def mined_keys(spark, sf_dir):
    return ops.mined_keys(v.cleaned(spark, sf_dir))[0].select("log_id", "key_id")


@query("D2_assign_keys", v.with_views("masked_keyed") + "SELECT log_id, key_id FROM masked_keyed")
def keys(spark, sf_dir):
    return ops.keyed(v.cleaned(spark, sf_dir)).select("log_id", "key_id")


@query("D2_tree_keys", v.with_views("keyed") + "SELECT log_id, template, key_id FROM keyed")
def tree_keys(spark, sf_dir):
    """The keys that windows, sequences and the feed are made of."""
    return v.keyed_logs(spark, sf_dir).select("log_id", "template", "key_id")


def varied_lines(spark, sf_dir):
    """Lines of six words of which groups share two, too few for one template."""
    words = F.split("original_text", " ")
    text = F.concat_ws(" ", F.lit("log"), "service", words[2], words[0], "node", F.regexp_replace(words[3], "=", ""))
    return v.logs(spark, sf_dir).select("log_id", "service", "ts", text.alias("cleaned_text"))


# groups, their split, the parts, and the templates of the parts; ``{late}`` puts later days behind
SPLIT = """WITH logs AS ({logs}), lines AS (
  SELECT log_id, ts, service, string_split('log ' || service || ' ' || w[3] || ' ' || w[1] || ' ' || node || ' ' || replace(w[4], '=', ''), ' ') AS w
  FROM (SELECT *, string_split(original_text, ' ') AS w FROM logs)
), cells AS (SELECT DISTINCT service, unnest(range(1, 7)) AS i, unnest(w) AS word FROM lines),
ways AS (SELECT service, i, count(*) AS n, count(DISTINCT CASE WHEN regexp_matches(word, '[0-9]') THEN '<*>' ELSE word END) AS ways
  FROM cells GROUP BY ALL),
cuts AS (SELECT service, CASE WHEN count(*) FILTER (n = 1) >= 0.4 * 6 THEN 0 ELSE
  coalesce(arg_min(i, (ways, i)) FILTER (ways > 1), 0) END AS place FROM ways GROUP BY ALL),
parts AS (SELECT l.*, CASE WHEN place = 0 THEN '' WHEN regexp_matches(w[place], '[0-9]') THEN '<*>' ELSE w[place] END AS part
  FROM lines l JOIN cuts USING (service)),
words AS (SELECT service, part, i, CASE WHEN count(DISTINCT word) = 1 THEN min(word) ELSE '<*>' END AS word
  FROM (SELECT service, part, unnest(range(1, 7)) AS i, unnest(w) AS word FROM parts) GROUP BY ALL),
texts AS (SELECT service, part, string_agg(word, ' ' ORDER BY i) AS template FROM words GROUP BY ALL),
facts AS (SELECT service, part, count(*) AS size, min((ts, log_id)) AS first, min(day(ts)) > 10 AS late FROM parts GROUP BY ALL)
SELECT service, template, 3 + row_number() OVER (PARTITION BY service ORDER BY {late} first) AS key_id, size
FROM facts JOIN texts USING (service, part)"""
LOGS_SQL = v.SQL_VIEWS["logs"][1]


@query("D1_split_templates", SPLIT.format(logs=LOGS_SQL, late=""))
def split_templates(spark, sf_dir):
    """Templates from two levels of the tree."""
    return tree.dictionary(tree.mine(written(varied_lines(spark, sf_dir), "varied"))[1])


@query("D5_grow_split_templates", SPLIT.format(logs=LOGS_SQL, late="late,"))
def grown_split(spark, sf_dir):
    """A tree from the first days, gone down and widened by the lines of the others."""
    logs = written(varied_lines(spark, sf_dir), "varied")
    _, known = tree.mine(logs.filter(F.dayofmonth("ts") <= 10))
    return tree.dictionary(tree.mine(logs.filter(F.dayofmonth("ts") > 10), known)[1])


@query(
    "D3_template_stats",
    v.with_views("dictionary")
    + """SELECT service, template, size, rank, n_templates FROM (
           SELECT *, row_number() OVER (PARTITION BY service ORDER BY size DESC, template) AS rank,
           count(*) OVER (PARTITION BY service) AS n_templates FROM dictionary) WHERE rank <= 5""",
)
def stats(spark, sf_dir):
    dictionary = ops.template_keys(v.templated(spark, sf_dir))
    return ops.template_stats(dictionary).select("service", "template", "size", "rank", "n_templates")


@query(
    "D4_vocabulary_size",
    v.with_views("dictionary") + "SELECT service, count(*) + 3 AS vocab_size FROM dictionary GROUP BY service",
)
def vocabulary_size(spark, sf_dir):
    return ops.vocabulary_size(ops.template_keys(v.templated(spark, sf_dir)))


@query(
    "D5_grow_templates",
    v.with_views("templated")
    + """, early AS (SELECT * FROM templated WHERE day(ts) <= 1), late AS (SELECT * FROM templated WHERE day(ts) > 1),
         k AS (SELECT service, template, count(*) AS size, row_number() OVER (PARTITION BY service
               ORDER BY arg_min((ts, log_id), (ts, log_id))) + 3 AS key_id FROM early GROUP BY service, template),
         f AS (SELECT service, template, count(*) AS size, row_number() OVER (PARTITION BY service
               ORDER BY arg_min((ts, log_id), (ts, log_id))) AS no FROM late
               WHERE (service, template) NOT IN (SELECT (service, template) FROM k) GROUP BY service, template)
         SELECT k.service, k.template, k.key_id, k.size + coalesce(l.n, 0) AS size FROM k LEFT JOIN
           (SELECT service, template, count(*) AS n FROM late GROUP BY ALL) l USING (service, template)
         UNION ALL SELECT f.service, f.template, f.no + coalesce(m.last, 3), f.size FROM f LEFT JOIN
           (SELECT service, max(key_id) AS last FROM k GROUP BY service) m USING (service)""",
)
def grown(spark, sf_dir):
    logs = v.templated(spark, sf_dir)
    known = ops.template_keys(logs.filter(F.dayofmonth("ts") <= 1))
    return ops.template_keys(logs.filter(F.dayofmonth("ts") > 1), known)
