from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from emberlog.operators import ordering


def rows(n, seed, hot_value=False):
    """A third of the rows under one key; on demand a third at one time as well."""
    random.seed(seed)
    out = []
    for i in range(n):
        key = "hot" if random.random() < 0.34 else random.choice(["a", "b", "c", None])
        ts = 500 if hot_value and random.random() < 0.4 else random.randint(0, 1000)
        out.append((key, ts, i))
    random.shuffle(out)
    return out


@pytest.mark.parametrize("hot_value", [False, True])
@pytest.mark.parametrize("keys", [(), ("key",)])
def test_number_rows_in_ranges(spark, hot_value, keys):
    data = rows(3000, 1, hot_value)
    df = spark.createDataFrame(data, "key string, ts long, id long")
    groups = defaultdict(list)
    for key, ts, i in data:
        groups[key if keys else None].append((ts, i))
    expected = {i: n + 1 for g in groups.values() for n, (_, i) in enumerate(sorted(g))}
    got = ordering.number_rows(df, ["ts", "id"], keys, rows_per_range=100).collect()
    assert {r.id: r.row_no for r in got} == expected


def test_ranges_bound_every_task(spark):
    """No (group, range) holds much more than its share, even when one time value is hot."""
    df = spark.createDataFrame(rows(6000, 2, True), "key string, ts long, id long")
    sizes = ordering._with_ranges(df, ["ts", "id"], 60).groupBy("_range").count().agg(F.max("count")).first()[0]
    assert sizes <= 220


def test_running_totals_on_strings_and_times(spark):
    words = [f"w{random.Random(i).randint(0, 10**6)}-{i}" for i in range(500)]
    df = spark.createDataFrame([(w, 1 + i % 3) for i, w in enumerate(words)], "word string, n long")
    got = ordering.running_totals(df, {"upto": F.col("n")}, ["word"], rows_per_range=50).collect()
    total, expected = 0, {}
    for w, n in sorted((w, 1 + i % 3) for i, w in enumerate(words)):
        total += n
        expected[w] = total
    assert {r.word: r.upto for r in got} == expected

    stamped = df.withColumn("ts", F.timestamp_micros(F.xxhash64("word") % 10**12)).withColumn("id", F.xxhash64("word"))
    plain = {r.word: r.row_no for r in ordering.number_rows(stamped, ["ts", "id"]).collect()}
    ranged = {r.word: r.row_no for r in ordering.number_rows(stamped, ["ts", "id"], rows_per_range=40).collect()}
    assert plain == ranged


def test_empty_input(spark):
    df = spark.createDataFrame([], "key string, ts long, id long")
    assert ordering.number_rows(df, ["ts", "id"], ["key"]).count() == 0


def test_position_orders_like_the_pair(spark):
    df = spark.range(200).select(
        F.timestamp_micros(F.col("id") % 7 * 1_000_000 + 1_700_000_000_000_000).alias("ts"),
        F.xxhash64("id").bitwiseAND(2**63 - 1).alias("log_id"),
    )
    by_pair = [tuple(r) for r in df.orderBy("ts", "log_id").collect()]
    by_position = [tuple(r) for r in df.orderBy(ordering.position()).collect()]
    assert by_pair == by_position


def test_first_rows_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id").repartition(4)
    top = ordering.first_rows(df, 2, [F.desc("id")], ["g"])
    assert {(r.g, r.id, r["rank"]) for r in top.collect()} == {
        (0, 999, 1), (0, 996, 2), (1, 997, 1), (1, 994, 2), (2, 998, 1), (2, 995, 2)
    }
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_numbered_ranges_stay_where_they_are(spark):
    """Few groups and ranges: their offsets are sent to the numbered rows, which are not dealt out and sorted again."""
    df = spark.createDataFrame(rows(600, 3), "key string, ts long, id long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = ordering.number_rows(df, ["ts", "id"], ["key"], rows_per_range=100)
        plan = numbered._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
