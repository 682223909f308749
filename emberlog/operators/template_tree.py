"""Mined templates and log keys from a tree of splits.

Distinct lines begin in groups of one service, token count and leading token. A group whose lines agree
in at least ``SIMILARITY`` of their positions is one template; any other is split at the position with
the fewest different tokens, and its parts are looked at in the next round. A round is a few aggregations
over (group, position, token), so a group of any size is spread over tasks, and the result depends on
the lines only, not on their order or partitions.

The tree stays. Later lines go down it by lookups; those that reach a template may widen it, and those
that find no way on make new groups, which are split by the same rule. Templates keep their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.sequences import RESERVED_IDS
from emberlog.operators.joins import sized
from emberlog.operators.ordering import number_rows, position
from emberlog.operators.templates import SIMILARITY, WILDCARD
from emberlog.session import written

#: one row per group: ``at`` is where it is split (from 1), or 0 where it is a template with a key
TREE = "service string, node string, at int, template string, key_id long, size long"


def routed(token: Column) -> Column:
    """Tokens with digits are one branch."""
    return F.when(token.rlike("[0-9]"), WILDCARD).otherwise(token)


def _below(node: Column, at: Column, token: Column) -> Column:
    return F.md5(F.concat_ws("\x01", node, at.cast("string"), routed(token)))


def _tokens() -> Column:
    return F.split("line", " ")


def distinct_lines(logs: DataFrame) -> DataFrame:
    """service, line, first_seen, n_logs, node: every distinct cleaned line and the group that it begins in."""
    lines = logs.groupBy("service", F.col("cleaned_text").alias("line")).agg(
        F.min(position()).alias("first_seen"), F.count(F.lit(1)).alias("n_logs")
    )
    start = F.md5(F.concat_ws("\x01", "service", F.size(_tokens()).cast("string"), routed(_tokens()[0])))
    return lines.withColumn("node", start)


def _cells(lines: DataFrame) -> DataFrame:
    """node, pos, token: the different tokens of every position of a group."""
    return lines.select("node", F.posexplode(_tokens()).alias("pos", "token")).distinct()


def _judged(lines: DataFrame) -> DataFrame:
    """node, at: whether a group is a template (0), or where it is split."""
    positions = (
        _cells(lines)
        .groupBy("node", "pos")
        .agg(F.count(F.lit(1)).alias("_tokens"), F.count_distinct(routed(F.col("token"))).alias("_ways"))
    )
    # the fewest ways, then the leftmost position
    choice = F.when(F.col("_ways") > 1, F.col("_ways") * F.lit(1 << 31) + F.col("pos"))
    groups = positions.groupBy("node").agg(
        F.count_if(F.col("_tokens") == 1).alias("_same"), F.count(F.lit(1)).alias("_n"), F.min(choice).alias("_choice")
    )
    whole = (F.col("_same") >= F.lit(SIMILARITY) * F.col("_n")) | F.col("_choice").isNull()
    split = (F.col("_choice") % (1 << 31) + 1).cast("int")
    return groups.select("node", F.when(whole, 0).otherwise(split).alias("at"))


def _descend(lines: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that ``tree`` (node, at) brings to a template, and those at groups that it doesn't hold, with that node."""
    done, left = None, lines
    while True:
        met = written(
            left.join(sized(tree), "node", "left").withColumn(
                "_next", F.when(F.col("at") > 0, _below(F.col("node"), F.col("at"), F.element_at(_tokens(), F.greatest("at", F.lit(1)))))
            ),
            "tree-lines",
        )
        arrived = met.filter("at = 0").drop("at", "_next")
        outside = met.filter("at is null").drop("at", "_next")
        done = (arrived, outside) if done is None else (done[0].unionByName(arrived), done[1].unionByName(outside))
        left = met.filter("at > 0").withColumn("node", F.col("_next")).drop("at", "_next")
        if not left.limit(1).count():
            return done


def grow(lines: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The leaf of every line (service, line, first_seen, n_logs, node), and the new groups (service, node, at)."""
    schema = "service string, node string, at int"
    spark = lines.sparkSession
    new = spark.createDataFrame([], schema)
    rounds = 0
    if known is None:
        arrived, left = lines.limit(0), lines
    else:
        arrived, left = _descend(lines, written(known.select("node", "at"), "tree-known"))
        left = written(left, "tree-outside")
    while True:
        judged = written(_judged(left), "tree-judged")
        met = left.join(sized(judged), "node")
        met = written(met, "tree-lines")
        new = new.unionByName(met.select("service", "node", "at").distinct())
        arrived = arrived.unionByName(met.filter("at = 0").drop("at"))
        further = met.filter("at > 0")
        rounds += 1
        if not further.limit(1).count():
            # leaves of one round are stored as they are
            return arrived if rounds == 1 and known is None else written(arrived, "tree-leaves"), new
        node = _below(F.col("node"), F.col("at"), F.element_at(_tokens(), F.col("at")))
        left = further.withColumn("node", node).drop("at")


def mine(logs: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cleaned logs → (every distinct line with its template and key, the tree as it is now).

    The first has service, cleaned_text, template and key_id. ``known`` is the tree of earlier logs.
    New templates are numbered on by first appearance, per service.
    """
    leaves, groups = grow(distinct_lines(logs), known)
    texts = leaves.select("node", "line")
    if known is not None:
        before = known.filter("at = 0").select("node", F.col("template").alias("line"))
        touched = before.join(sized(leaves.select("node").distinct()), "node", "left_semi")
        texts = texts.unionByName(touched)
    word = F.when(F.count(F.lit(1)) == 1, F.min("token")).otherwise(WILDCARD)
    words = _cells(texts).groupBy("node", "pos").agg(word.alias("word"))
    templates = words.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("_w"))
    templates = templates.select("node", F.array_join(F.transform("_w", lambda w: w["word"]), " ").alias("template"))
    seen = leaves.groupBy("service", "node").agg(F.min("first_seen").alias("_first"), F.sum("n_logs").alias("size"))
    seen = written(seen.join(templates, "node"), "tree-templates")

    if known is None:
        fresh, last = seen, None
    else:
        fresh = seen.join(known.filter("at = 0").select("node"), "node", "left_anti")
        last = known.groupBy("service").agg(F.max("key_id").alias("_last"))
    numbered = number_rows(fresh, ["_first"], ["service"], "_no")
    if last is not None:
        numbered = numbered.join(last, "service", "left")
        numbered = numbered.withColumn("_no", F.col("_no") + F.coalesce("_last", F.lit(RESERVED_IDS)) - RESERVED_IDS)
    fields = ["service", "node", "at", "template", "key_id", "size"]
    tree = numbered.select(
        "service", "node", F.lit(0).alias("at"), "template", (F.col("_no") + RESERVED_IDS).alias("key_id"), "size"
    )
    inner = groups.filter("at > 0").withColumns(
        {"template": F.lit(None).cast("string"), "key_id": F.lit(None).cast("long"), "size": F.lit(None).cast("long")}
    )
    tree = tree.unionByName(inner.select(*fields))
    if known is not None:
        wider = seen.select("node", F.col("template").alias("_wide"), F.col("size").alias("_more"))
        kept = known.join(wider, "node", "left").select(
            "service", "node", "at", F.coalesce("_wide", "template").alias("template"), "key_id",
            (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"),
        )
        tree = tree.unionByName(kept)
    tree = written(tree, "template-tree")
    keys = tree.filter("at = 0").select("node", "template", "key_id")
    found = leaves.join(sized(keys), "node").select("service", F.col("line").alias("cleaned_text"), "template", "key_id")
    return written(found, "template-lines"), tree


def dictionary(tree: DataFrame) -> DataFrame:
    """service, template, key_id and size (number of logs) of every template of a tree."""
    return tree.filter("at = 0").select("service", "template", "key_id", "size")


def assign(logs: DataFrame, found: DataFrame) -> DataFrame:
    """Add template and key to every log whose cleaned line was mined."""
    return logs.join(sized(found), ["service", "cleaned_text"], "left")


def tree_keyed(logs: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cleaned logs → (logs with mined ``template`` and ``key_id``, the tree as it is now)."""
    found, tree = mine(logs, known)
    return assign(logs, found), tree
