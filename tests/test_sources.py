from __future__ import annotations

import json

from pyspark.sql import functions as F

from emberlog.operators.evaluate import merge_labels
from emberlog.operators.lines import parse_hdfs, unique_lines
from emberlog.sources import files, loki
from emberlog.sources.tables import PartTable


def test_push_messages(spark):
    push = {
        "streams": [
            {"stream": {"filename": "a.log", "node": "n", "service": "s"}, "values": [["1704067207179575123", "one"], ["1704067207179575999", "two"]]},
            {"stream": {"filename": "b.log", "node": "n"}, "values": [["1704067208000000000", "three"]]},
        ]
    }
    messages = spark.createDataFrame([(json.dumps(push),), ("{broken",)], "value string")
    rows = {r.original_text: r for r in loki.flatten_pushes(messages).collect()}
    assert set(rows) == {"one", "two", "three"}
    assert rows["one"].ts.microsecond == 179575 and rows["one"].timestamp == 170406720717957
    assert {r.original_text for r in loki.select_labelled(loki.flatten_pushes(messages)).collect()} == {"one", "two"}


def test_decode(spark):
    good = {"log_id": 1, "service": "s", "node": "n", "filename": "f", "ts": "2024-01-01T00:00:01.123456Z", "original_text": "t"}
    texts = [json.dumps(good), "not json", json.dumps({**good, "node": None}), "", json.dumps([1])]
    decoded = loki.decode_logs(spark.createDataFrame([(t,) for t in texts], "value string"))
    valid = loki.valid_logs(decoded).collect()
    assert [(r.log_id, r.ts.microsecond) for r in valid] == [(1, 123456)]
    assert {r.raw for r in loki.dead_letters(decoded).collect()} == set(texts[1:])


def test_corpus_files(spark, tmp_path):
    log, csv = tmp_path / "hdfs.log", tmp_path / "labels.csv"
    log.write_text("1 got blk_1 from 10.0.0.1:50\n2 got blk_-2 x\n3 lost blk_1 y\n4 got blk_1 from 10.0.0.9:51\n")
    csv.write_text("BlockId,Label\nblk_1,Anomaly\nblk_-2,Normal\n")
    lines = files.read_lines(spark, str(log))
    assert [r.line[0] for r in lines.orderBy("line_id").collect()] == list("1234")
    parsed = parse_hdfs(lines).withColumns({"ts": F.timestamp_seconds(F.lit(0)), "log_id": F.col("line_id")})
    merged = merge_labels(unique_lines(parsed, "block_id", "line"), files.read_labels(spark, str(csv)))
    assert {(r.block_id, r.line, r.is_anomaly) for r in merged.collect()} == {
        ("blk_1", "NUM got BLK from IP NUM lost BLK y", 1), ("blk_-2", "NUM got BLK x", 0)
    }


def test_read_or_build_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "cache")
    assert files.read_or_build(spark, path, build).count() == 3
    assert files.read_or_build(spark, path, build).count() == 3
    assert len(calls) == 1


def test_spread(spark):
    assert files.spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == 8
    assert files.spread(spark.range(10).repartition(9)).rdd.getNumPartitions() == 9


def test_part_table(spark, tmp_path):
    table = PartTable(spark, str(tmp_path / "t"), "id long")
    assert table.latest().count() == 0 and table.parts() == []
    table.write(spark.range(1), 0)
    table.write(spark.range(5), 1)
    table.write(spark.range(2), 1)  # the batch ran again
    assert table.parts() == [0, 1] and table.latest().count() == 2 and table.all().count() == 3
    assert table.latest(1).count() == 1 and table.all(1).count() == 1 and table.all(after=0).count() == 2
    assert table.write(spark.range(4)) == 2
    (tmp_path / "t" / "part=9").mkdir()  # never finished
    assert table.latest().count() == 4
    table.expire(1)
    assert table.parts() == [2]


def test_scratch_tables_go_at_the_end(spark):
    from emberlog.session import scratch, written

    with scratch(spark):
        inner = written(spark.range(3), "inner")
        path = inner.inputFiles()[0].rsplit("/", 1)[0]
        assert inner.count() == 3
    outer = written(spark.range(2), "outer")
    assert outer.count() == 2
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)


def test_claims_are_exclusive(spark, tmp_path):
    one, other = PartTable(spark, str(tmp_path / "t")), PartTable(spark, str(tmp_path / "t"))
    first, second = one.claim(), other.claim()
    assert (first, second) == (0, 1)
    other.write(spark.range(2), second)
    one.write(spark.range(3), first)
    assert one.all().count() == 5 and one.write(spark.range(1)) == 2


def test_lines_are_numbered_over_files(spark, tmp_path):
    for n, size in enumerate((3, 400, 1, 50, 0, 7)):
        (tmp_path / f"f{n}.log").write_text("".join(f"{n}-{i}\n" for i in range(size)))
    rows = files.read_lines(spark, str(tmp_path)).orderBy("line_id").collect()
    assert [r.line_id for r in rows] == list(range(461))
    assert [r.line for r in rows] == [f"{n}-{i}" for n, size in enumerate((3, 400, 1, 50, 0, 7)) for i in range(size)]


def test_shipped_record(spark):
    record = {"node": "n", "filename": "f", "timestamp": 170406720717957, "service": "s", "original_text": "t"}
    decode = lambda: loki.valid_logs(loki.decode_logs(spark.createDataFrame([(json.dumps(record),)], "value string"))).collect()
    (row,), (again,) = decode(), decode()
    assert row == again and row.log_id >= 0 and row.ts.microsecond == 179570
    for number in (1704067207, 1704067207179, 1704067207179575, 1704067207179575123):
        got = spark.range(1).select(F.unix_micros(loki.epoch_time(F.lit(number)))).first()[0]
        assert got // 1_000_000 == 1704067207


def test_spread_of_a_file_with_one_row_group(spark, tmp_path):
    """The file is cut into more splits than cores, but its rows lie in one of them."""
    path = str(tmp_path / "packed.parquet")
    spark.range(20_000).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(path)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 16)
    try:
        packed = spark.read.parquet(path)
        assert packed.rdd.getNumPartitions() >= 8
        sizes = files.spread(packed, "id").groupBy(F.spark_partition_id()).count().toDF("part", "n").agg(F.sum("n"), F.max("n"))
        assert sizes.first()[0] == 20_000 and sizes.first()[1] < 4_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
