"""Files that grow while they are tailed."""

from __future__ import annotations

import random

import pytest

from emberlog.sources.tail import tail_lines
from emberlog.sources.topics import read_topic


@pytest.fixture
def tail(spark, tmp_path):
    """Runs the stream until it has caught up, and returns all rows so far."""
    rows: list = []

    def run(folder, **options):
        def take(df, batch_id):
            rows.extend(df.collect())

        stream = tail_lines(spark, str(folder), **options)
        writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start().awaitTermination()
        return rows

    return run


def by_file(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.log_id):
        out.setdefault(r.filename, []).append(r.value)
    return out


@pytest.mark.parametrize("split", [1, 7, 64 << 20])
def test_growing_files(tail, tmp_path, split):
    rng = random.Random(1)
    folder = tmp_path / "logs"
    (folder / "deep").mkdir(parents=True)
    names, expected = ["a.log", "b.log", "deep/c.log"], {}
    texts = ["same", "same", "", "é\U0001f600", "x" * 50, "ends in return\r"]
    for _ in range(3):
        for name in names:
            lines = [rng.choice(texts) for _ in range(rng.randrange(0, 9))]
            expected.setdefault(name, []).extend(line.removesuffix("\r") for line in lines)
            with open(folder / name, "a", newline="") as file:
                file.write("".join(line + "\n" for line in lines))
        rows = tail(folder, split_bytes=split)
        assert by_file(rows) == {n: lines for n, lines in expected.items() if lines}
    ids = [r.log_id for r in rows]
    assert len(set(ids)) == len(ids) and min(ids) >= 0


def test_unfinished_lines_wait(tail, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("half")
    assert tail(folder) == []
    (folder / "a.log").write_text("half done\nnext")
    assert [r.value for r in tail(folder)] == ["half done"]
    (folder / "a.log").write_text("half done\nnext one\n")
    assert [(r.value, r.position) for r in tail(folder)] == [("half done", 0), ("next one", 10)]


def test_rotated_files(tail, tmp_path):
    """A renamed file goes on under its first name; a new one under the old name begins anew."""
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("first 1\nfirst 2\n")
    tail(folder)
    (folder / "a.log").rename(folder / "a.log.1")
    with open(folder / "a.log.1", "a") as file:
        file.write("first 3\n")
    (folder / "a.log").write_text("second 1\n")
    rows = tail(folder)
    assert sorted(r.value for r in rows) == ["first 1", "first 2", "first 3", "second 1"]
    numbers = {r.value: r.file_no for r in rows}
    assert numbers["first 1"] == numbers["first 3"] != numbers["second 1"]
    assert {r.filename for r in rows} == {"a.log"}


def test_invalid_bytes_and_other_names(tail, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_bytes(b"\xff\xfe broken\n")
    for name in ("_SUCCESS", ".hidden.log", "other.txt"):
        (folder / name).write_text("no log\n")
    assert [r.value for r in tail(folder, pattern="*.log")] == ["�� broken"]


def test_shortened_file_ends_the_stream(tail, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("one\ntwo\n")
    tail(folder)
    (folder / "a.log").write_text("one\n")
    with pytest.raises(Exception, match="has become shorter"):
        tail(folder)


def test_two_readers_of_a_topic_agree(spark, tmp_path):
    topic = tmp_path / "topic"
    spark.createDataFrame([("same",)] * 40, "value string").repartition(3).write.text(str(topic))
    found = []
    for n in range(2):
        rows: list = []
        stream = read_topic(spark, str(topic), format="lines")
        writer = stream.writeStream.foreachBatch(lambda df, i, rows=rows: rows.extend(df.collect()))
        writer = writer.option("checkpointLocation", str(tmp_path / f"state{n}"))
        writer.trigger(availableNow=True).start().awaitTermination()
        found.append(sorted(r.position for r in rows))
    assert found[0] == found[1] and len(set(found[0])) == 40
