"""WARC archives of captures, and one index of them merged from sorted runs.

Writing: equal payloads are found by their SHA-256; the capture with the largest id is stored as
a response, others as revisits that refer to it. Spark's text writer puts the records into files
of the shared folder, so any store that Spark can write holds them. After the version line every
record carries the archive's boundary, a random number.

Reading back: Spark's text reader cuts the files at the boundaries, in splits of any size, and
every record is cut to the length that its header states. Digests and lengths of stored payloads
are worked out again and must agree with the header.

The index: every task sorts the captures it has read by URL key, time and id, which makes a run.
Ranges of that order are dealt to tasks, and a task merges what it got of the runs with a tree of
losers: each inner node remembers the run that lost there, so the next capture costs one
comparison per level. A run is recognised by its order, so captures that arrive in another order
only make more runs. Numbering the ranges orders all captures of the archive.

Defined results: a null payload counts as empty; a null URL has an empty key and no target in its
record; line ends inside a URL are percent-encoded; a capture without an id is smaller than all others,
and a revisit of one refers to null; of rows that repeat id and payload one is the response and the
others revisit it; payloads of any length are kept whole; an empty table gives an empty archive and
index; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import row_keyed, table
from emberlog.llm.registry import query
from emberlog.operators.joins import sized
from emberlog.session import new_shared_path, written

CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RANGE_ROWS = 100_000


@dataclass(frozen=True)
class Archive:
    """A folder of WARC files and the boundary that stands after the version line of their records."""

    path: str
    boundary: str


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary in base 32: 40 hexadecimal digits are eight groups of 20 bits, four digits each."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Sort key of a URL: reversed host labels, port unless it is the usual one, then path and query; no fragment."""
    parts = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)"
    scheme, host = F.lower(F.regexp_extract(url, parts, 1)), F.lower(F.regexp_extract(url, parts, 2))
    port, rest = F.regexp_extract(url, parts, 3), F.regexp_extract(url, parts, 4)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    labels = F.concat_ws(",", F.reverse(F.split(host, r"\.")))
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    key = F.concat(labels, F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)), F.lit(")"), path)
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).when(host == "", url).otherwise(key)


def write_archive(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    time: Column | None = None,
    revisit_from: int = 0,
) -> Archive:
    """Write one record per row of ``pages``; payloads of at least ``revisit_from`` bytes are stored once.

    ``time`` (a timestamp) is when a row was captured; the epoch if not given.
    """
    spark = pages.sparkSession
    epoch = F.timestamp_seconds(F.lit(0))
    keyed, key = row_keyed(pages)
    rows = keyed.select(
        F.col(key).alias("_row"),
        F.col(id_col).alias("_id"),
        F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("_url"),
        F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("_body"),
        (epoch if time is None else F.coalesce(time, epoch)).alias("_time"),
    ).withColumns({"_same": F.unhex(F.sha2("_body", 256)), "_bytes": F.octet_length("_body")})

    seen = written(rows.filter(F.col("_bytes") >= revisit_from).select("_same", "_id", "_row"), "warc-payloads")
    several = (
        seen.groupBy("_same").agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    )
    several = written(several.drop("_n"), "warc-repeats")
    # the row that is stored, where the largest id occurs several times
    stored = seen.join(sized(several), "_same").filter(F.col("_id").eqNullSafe(F.col("_first")))
    stored = stored.groupBy("_same").agg(F.max("_first").alias("_first"), F.min("_row").alias("_kept"))
    stored = written(stored, "warc-stored")
    told = rows.join(sized(stored), "_same", "left")

    boundary = uuid.uuid4().hex
    revisit = F.coalesce(F.col("_kept") != F.col("_row"), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:capture:"), c.cast("string"), F.lit(">"))
    field = lambda label, value: F.coalesce(F.concat(F.lit(f"{label}: "), value, F.lit(CRLF)), F.lit(""))
    http = F.concat(F.lit(HTTP), F.col("_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http.cast("binary")).otherwise(F.concat(http.cast("binary"), F.col("_body")))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Boundary: {boundary}{CRLF}"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", name(F.col("_row"))),
        field("WARC-Date", F.date_format("_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
        field("WARC-Target-URI", F.col("_url")),
        field("WARC-Page-ID", F.col("_id").cast("string")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("_body")))),
        field("WARC-Refers-To", F.when(revisit, name(F.col("_kept")))),
        field("WARC-Refers-To-Page-ID", F.when(revisit, F.col("_first").cast("string"))),
        field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    path = new_shared_path(spark, "warc")
    records = told.select(F.concat(header.cast("binary"), block).cast("string").alias("value"))
    records.write.option("lineSep", CRLF + CRLF).text(path)
    return Archive(path, boundary)


def read_archive(spark: SparkSession, archive: Archive, id_type: str = "long") -> DataFrame:
    """One row per record: record, page_id, url, captured, record_type, payload_digest, payload_bytes, refers_to, payload, filename.

    The payload of a revisit is null. A stored payload that doesn't have the digest or length of its
    header ends the job.
    """
    # the boundary begins with a letter that it doesn't hold again, so a part of it never hides another one
    cut = spark.read.option("lineSep", f"WARC-Boundary: {archive.boundary}{CRLF}").text(archive.path)
    raw = cut.select(F.col("value"), F.col("_metadata.file_name").alias("filename")).filter("value <> 'WARC/1.1\r\n'")
    split = raw.select(
        "filename",
        F.substring_index("value", CRLF + CRLF, 1).alias("_head"),
        F.col("value").cast("binary").alias("_raw"),
    )

    def of(label: str) -> Column:
        found = F.regexp_extract("_head", f"(?:^|\r\n){label}: ([^\r\n]*)", 1)
        return F.when(found != "", found)

    split = split.withColumns({"_length": of("Content-Length").cast("int"), "_start": F.octet_length("_head") + 5})
    block = F.substring(F.col("_raw"), F.col("_start"), F.col("_length"))
    split = split.withColumn("_block", block)
    # the lines before the payload are far shorter than 200 bytes
    http = F.substring_index(F.substring(F.col("_block"), 1, 200).cast("string"), CRLF + CRLF, 1)
    split = split.withColumn("_http", http)
    n_bytes = F.regexp_extract("_http", "Content-Length: ([0-9]+)", 1).cast("long")
    response = of("WARC-Type") == "response"
    payload = F.when(response, F.substring(F.col("_block"), F.octet_length("_http") + 5, F.col("_length")))
    rows = split.select(
        of("WARC-Record-ID").alias("record"),
        of("WARC-Page-ID").cast(id_type).alias("page_id"),
        of("WARC-Target-URI").alias("url"),
        F.to_timestamp(of("WARC-Date"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("captured"),
        of("WARC-Type").alias("record_type"),
        F.substring_index(of("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        n_bytes.alias("payload_bytes"),
        of("WARC-Refers-To-Page-ID").cast(id_type).alias("refers_to"),
        payload.alias("payload"),
        "filename",
    )
    wrong = F.col("payload").isNotNull() & (
        (F.octet_length("payload") != F.col("payload_bytes"))
        | (base32_sha1(F.col("payload")) != F.col("payload_digest"))
    )
    damaged = F.raise_error(F.concat(F.lit("damaged record "), F.col("record"))).cast("string")
    return rows.withColumn("record_type", F.when(wrong, damaged).otherwise(F.col("record_type")))


def sorted_runs(captures: DataFrame) -> DataFrame:
    """Captures by URL key, time, id and record inside each partition, without payloads."""
    narrow = captures.select(url_key(F.col("url")).alias("urlkey"), *[c for c in captures.columns if c not in ("url", "payload")])
    return narrow.sortWithinPartitions("urlkey", "captured", F.asc_nulls_first("page_id"), "record")


def loser_tree_merge(runs: list[list]) -> Iterator[int]:
    """Numbers of the runs in the order in which a merge takes their entries.

    ``tree[1:]`` are inner nodes, each with the run that lost the comparison there; ``tree[0]`` is
    the winner. An exhausted run loses against every other.
    """
    k = len(runs)
    if not k:
        return
    heads = [iter(run) for run in runs]
    keys = [next(head, None) for head in heads]

    def beats(a: int, b: int) -> bool:
        if keys[a] is None or keys[b] is None:
            return keys[a] is not None
        return keys[a] < keys[b] or (keys[a] == keys[b] and a < b)

    tree = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        one, other = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (one, other) if beats(one, other) else (other, one)
    tree[0] = winners[1] if k > 1 else 0
    while keys[tree[0]] is not None:
        run = tree[0]
        yield run
        keys[run] = next(heads[run], None)
        node = (run + k) // 2
        while node:
            if beats(tree[node], run):
                tree[node], run = run, tree[node]
            node //= 2
        tree[0] = run


def merged_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures of ``runs`` in one order: the columns of ``runs``, range and place.

    (range, place) orders the captures of the whole archive by URL key, time and id.
    """
    order = ["urlkey", "captured", "page_id", "record"]
    at = [runs.columns.index(c) for c in order]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        # null sorts before every value
        keys = list(zip(*([(v is not None, v) for v in rows.column(i).to_pylist()] for i in at)))
        bounds = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
        pieces = [keys[a:b] for a, b in zip(bounds, bounds[1:])]
        following = bounds[:-1]
        taken = []
        for piece in loser_tree_merge(pieces):
            taken.append(following[piece])
            following[piece] += 1
        rows = rows.take(pa.array(taken, pa.int64()))
        number = TaskContext.get().partitionId()
        rows = rows.append_column("range", pa.array([number] * len(taken), pa.int32()))
        rows = rows.append_column("place", pa.array(range(len(taken)), pa.int64()))
        yield from rows.to_batches(max_chunksize=10_000)

    schema = ", ".join(f"{n} {t}" for n, t in runs.dtypes) + ", range int, place long"
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(ranges, "urlkey", "captured", F.asc_nulls_first("page_id"), "record")
    return dealt.mapInArrow(run, schema)


def archive_and_index(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write ``pages`` as an archive, read it back, and return the merged index of its captures."""
    archive = write_archive(pages, id_col, **options)
    captures = read_archive(pages.sparkSession, archive, dict(pages.dtypes)[id_col])
    return merged_index(written(sorted_runs(captures), "warc-runs"))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
s AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM s
"""


@query("op11_warc", SQL)
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # the table has no times: pages are captured one second apart
    index = archive_and_index(pages, time=F.timestamp_seconds(F.col("page_id")))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
