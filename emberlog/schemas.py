"""Record schemas shared by the sources, operators and streams."""

from __future__ import annotations

from pyspark.sql import types as T

REGEX_SUB = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("replacement", T.StringType())])

PUSH = T.StructType(
    [
        T.StructField(
            "streams",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "stream",
                            T.StructType(
                                [
                                    T.StructField("filename", T.StringType()),
                                    T.StructField("node", T.StringType()),
                                    T.StructField("service", T.StringType()),
                                ]
                            ),
                        ),
                        T.StructField("values", T.ArrayType(T.ArrayType(T.StringType()))),
                    ]
                )
            ),
        )
    ]
)

# one log line on the topic that the shipper writes
TOPIC_LOG = T.StructType(
    [
        T.StructField("log_id", T.LongType()),
        T.StructField("service", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("original_text", T.StringType()),
        T.StructField("train_strategy", T.StringType()),
    ]
)

LOG_FIELDS = ["log_id", "service", "node", "filename", "ts", "original_text"]

SERVICE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("is_train", T.BooleanType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("coreset_size", T.IntegerType()),
        T.StructField("enable_trace", T.BooleanType()),
        T.StructField("trace_regex", T.StringType()),
        T.StructField("top_k", T.IntegerType()),
        T.StructField("max_pretrain", T.IntegerType()),
        T.StructField("context_size", T.IntegerType()),
        T.StructField("lr_pretraining", T.DoubleType()),
        T.StructField("lr_finetuning", T.DoubleType()),
        T.StructField("train_batch_size", T.IntegerType()),
        T.StructField("num_episodes", T.IntegerType()),
        T.StructField("num_epochs", T.IntegerType()),
        T.StructField("vocab_size", T.IntegerType()),
        T.StructField("regex_subs", T.ArrayType(REGEX_SUB)),
    ]
)
