"""Ways to turn a cleaned line into a line vector (``cls``) and token vectors (``tokens``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.text import word_tokens
from emberlog.operators.joins import sized
from emberlog.operators.ordering import running_totals
from emberlog.session import written

VECTOR = T.ArrayType(T.DoubleType())
TRIGRAM_DIM = 32
# words with a vector; they are held on the driver
MAX_WORDS = 200_000


def _trigram_vectors(tokens: Column, dim: int) -> Column:
    """One vector per token; the slots of a token's trigrams are worked out once, not once per dimension."""
    code = lambda framed, i: F.ascii(F.substring(framed, i, 1))
    framed = F.transform(tokens, lambda t: F.concat(F.lit("#"), t, F.lit("#")))
    slots = F.transform(
        framed,
        lambda t: F.transform(
            F.sequence(F.lit(1), F.length(t) - 2),
            lambda i: (code(t, i) * 961 + code(t, i + 1) * 31 + code(t, i + 2)) % dim,
        ),
    )
    dims = F.sequence(F.lit(0), F.lit(dim - 1))
    return F.transform(
        slots, lambda of: F.transform(dims, lambda d: F.size(F.filter(of, lambda s: s == d)).cast("double"))
    )


def add_vectors(vectors: Column, dim: int) -> Column:
    zero = F.array_repeat(F.lit(0.0), dim)
    return F.aggregate(vectors, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))


def embed_trigrams(lines: DataFrame, text: str = "cleaned_text", dim: int = TRIGRAM_DIM) -> DataFrame:
    """Counts of hashed character trigrams per token; the line vector is their sum."""
    tokens = _trigram_vectors(word_tokens(F.col(text)), dim)
    return lines.withColumn("tokens", tokens).withColumn("cls", add_vectors(F.col("tokens"), dim))


def fit_word_vectors(
    lines: DataFrame, text: str = "cleaned_text", dim: int = 32, seed: int = 1, max_words: int = MAX_WORDS
) -> Word2VecModel:
    """Word vectors of the ``max_words`` most frequent words; the driver holds no more than these."""
    words = lines.select(word_tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    counts = written(words.select(F.explode("words").alias("word")).groupBy("word").count(), "word-counts")
    # the smallest count that leaves at most so many words
    falling = counts.groupBy("count").agg(F.count(F.lit(1)).alias("n"))
    totals = running_totals(falling.withColumn("_falling", -F.col("count")), {"_upto": F.col("n")}, ["_falling"])
    least = totals.filter(F.col("_upto") <= max_words).agg(F.min("count")).first()[0]
    most = counts.agg(F.max("count")).first()[0] or 0
    least = most + 1 if least is None else least
    return Word2Vec(vectorSize=dim, minCount=least, seed=seed, inputCol="words", outputCol="cls").fit(words)


def embed_words(lines: DataFrame, model: Word2VecModel, key: str, text: str = "cleaned_text") -> DataFrame:
    """Vectors of a fitted word model.

    Words it does not know have no token vector. A line of such words only keeps its row, with a
    line vector of zeros and no tokens, and so scores as the farthest from every normal line.
    """
    words = lines.withColumn("words", word_tokens(F.coalesce(F.col(text), F.lit(""))))
    averaged = model.transform(words).withColumn("cls", vector_to_array("cls")).drop("words")
    table = model.getVectors().select(F.col("word"), vector_to_array("vector").alias("vector"))
    per_token = (
        words.select(key, F.posexplode("words").alias("_pos", "word"))
        .join(sized(table), "word")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "vector"))).alias("_t"))
        .select(key, F.transform("_t", lambda x: x["vector"]).alias("tokens"))
    )
    none = F.array().cast(T.ArrayType(VECTOR))
    return averaged.join(per_token, key, "left").withColumn("tokens", F.coalesce("tokens", none))


def embed_with(
    lines: DataFrame, encode: Callable[[pd.Series], tuple[list, list]], text: str = "cleaned_text"
) -> DataFrame:
    """A user's encoder: a batch of texts → (line vectors, token matrices)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cls, tokens = encode(pdf[text])
            yield pdf.assign(cls=list(cls), tokens=list(tokens))

    schema = T.StructType([*lines.schema.fields, T.StructField("cls", VECTOR), T.StructField("tokens", T.ArrayType(VECTOR))])
    return lines.mapInPandas(run, schema)


def embed_cached(
    lines: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Read-through cache by ``hash``: (vectors of all distinct hashes, the newly embedded ones).

    ``cache`` holds hash, cls, tokens, for all services together. Only misses are embedded.
    """
    wanted = lines.groupBy("hash").agg(F.min("cleaned_text").alias("cleaned_text"))
    misses = wanted.join(cache.select("hash"), "hash", "left_anti")
    added = embed(misses).select("hash", "cls", "tokens")
    hits = cache.join(wanted.select("hash"), "hash", "left_semi").select("hash", "cls", "tokens")
    return hits.unionByName(added), added


def normalized(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))
