"""Topics: JSON messages read from and written to a broker or a folder of files.

``format="kafka"`` needs Spark's Kafka connector on the class path; every other format
treats the topic as a folder, which is what the tests use. ``lines`` reads the folder's files as they
grow, with a place for every message; Spark's own formats take each file once and know no places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from emberlog.sources.loki import content_id
from emberlog.sources.tail import tail_lines

MAX_MESSAGE_BYTES = 10_242_880


def read_topic(
    spark: SparkSession,
    topic: str,
    format: str = "text",
    starting: str = "earliest",
    **options: str,
) -> DataFrame:
    """Stream of ``value`` (string) and ``position`` (long), the message's place in its topic.

    The position is repeatable: partition and offset of a broker, file and byte of a folder's lines. Spark's own
    file formats give no place; there it is a hash of file name and message, which equal messages share.
    ``starting`` is ``earliest`` for the sequence path and ``latest`` for the retrieval
    path. Folder topics always start with the files present; the checkpoint of each query
    takes the place of a consumer group.
    """
    if format == "lines":
        return tail_lines(spark, topic, **options).select("value", F.col("log_id").alias("position"))
    reader = spark.readStream.format(format)
    for key, value in options.items():
        reader = reader.option(key, value)
    if format == "kafka":
        stream = reader.option("subscribe", topic).option("startingOffsets", starting).load()
        place = F.shiftleft(F.col("partition").cast("long"), 44) + F.col("offset")
        return stream.select(F.col("value").cast("string").alias("value"), place.alias("position"))
    stream = reader.load(topic) if format == "text" else reader.schema("value string").load(topic)
    return stream.select("value", content_id(F.col("_metadata.file_path"), F.col("value")).alias("position"))


def write_topic(
    messages: DataFrame, topic: str, checkpoint: str, format: str = "text", **options: str
) -> DataStreamWriter:
    """Writer of a ``value`` stream; at-least-once on a broker, exactly-once on files."""
    writer = messages.writeStream.format(format).outputMode("append").option("checkpointLocation", checkpoint)
    for key, value in options.items():
        writer = writer.option(key, value)
    if format == "kafka":
        return writer.option("topic", topic).option("kafka.max.request.size", str(MAX_MESSAGE_BYTES))
    return writer.option("path", topic)
