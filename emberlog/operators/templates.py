"""Line templates and the integer keys made from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.sequences import RESERVED_IDS
from emberlog.functions.text import mask_digit_tokens
from emberlog.operators.joins import sized
from emberlog.operators.ordering import first_rows, number_rows, position
from emberlog.session import written

# Similarity threshold of the published miner, and its wildcard token.
SIMILARITY = 0.4
WILDCARD = "<*>"


def masked_templates(logs: DataFrame) -> DataFrame:
    """Template per line by masking tokens with digits: a plain projection."""
    return logs.withColumn("template", mask_digit_tokens(F.col("cleaned_text")))


class Clusters:
    """Greedy clusters of equally long token lists.

    A line joins the template that equals it in the most places, wildcards not counted, if
    those are at least ``SIMILARITY`` of all; among equals the one with more wildcards, then
    the oldest. Places that differ become wildcards. Only the templates are held, not the lines.
    """

    def __init__(self, width: int):
        self.codes, self.names = {WILDCARD: 0}, [WILDCARD]
        self.templates = np.zeros((16, width), dtype=np.int64)
        self.used = 0

    def start(self, tokens: list[str]) -> int:
        """A template of its own."""
        for token in tokens:
            if token not in self.codes:
                self.codes[token] = len(self.names)
                self.names.append(token)
        if self.used == len(self.templates):
            self.templates = np.vstack([self.templates, np.zeros_like(self.templates)])
        self.templates[self.used] = [self.codes[t] for t in tokens]
        self.used += 1
        return self.used - 1

    def add(self, tokens: list[str]) -> int:
        """Number of the template that the line joins or starts."""
        # a token that no template has equals none
        row = np.array([self.codes.get(t, -1) for t in tokens], dtype=np.int64)
        known = self.templates[: self.used]
        same = ((known == row) & (known != 0)).sum(axis=1)
        if not self.used or same.max() < SIMILARITY * len(tokens):
            return self.start(tokens)
        best = int((same * (len(tokens) + 1) + (known == 0).sum(axis=1)).argmax())
        self.templates[best][self.templates[best] != row] = 0
        return best

    def text(self, number: int) -> str:
        return " ".join(self.names[c] for c in self.templates[number])


def cluster_tokens(lines: list[list[str]]) -> tuple[list[str], list[int]]:
    """Templates and assignments of equally long lines, in order."""
    clusters = Clusters(len(lines[0]))
    chosen = [clusters.add(line) for line in lines]
    return [clusters.text(i) for i in range(clusters.used)], chosen


_LEAF = ["service", "_n", "_prefix"]
_CLUSTERED = "service string, _n int, _prefix string, line string, cluster long, template string, seed string"


def _cluster_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaves in turn, lines in order → the cluster of each line, and each leaf's templates at its end."""
    leaf, clusters, seeds = None, None, []
    names = ["service", "_n", "_prefix", "line", "cluster", "template", "seed"]

    def finished() -> list[tuple]:
        if clusters is None:
            return []
        return [
            (*leaf, None, i, clusters.text(i), seeds[i] if i < len(seeds) else None) for i in range(clusters.used)
        ]

    for pdf in batches:
        out: list[tuple] = []
        for service, n, prefix, line, known in pdf[["service", "_n", "_prefix", "line", "_known"]].itertuples(index=False):
            if (service, n, prefix) != leaf:
                out += finished()
                leaf, clusters, seeds = (service, n, prefix), Clusters(n), []
            tokens = line.split(" ")
            if known:
                clusters.start(tokens)
                seeds.append(line)
            else:
                out.append((service, n, prefix, line, clusters.add(tokens), None, None))
        yield pd.DataFrame(out, columns=names)
    yield pd.DataFrame(finished(), columns=names)


def fit_templates(logs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Mine templates from cleaned lines: one row per distinct (service, cleaned_text), with ``template`` and ``seed``.

    Each distinct line is clustered once, in order of appearance, inside its leaf (same token count
    and leading token). The rule is the same for a leaf of any size: a task streams over its sorted
    leaves and holds only templates. ``known`` (service, template, key_id) are the templates to start
    from; a line that joins one may widen it, and ``seed`` is its text as it was known.
    """
    lines = logs.groupBy("service", F.col("cleaned_text").alias("line")).agg(F.min(position()).alias("first_seen"))
    lines = lines.select("service", "line", "first_seen", F.lit(False).alias("_known"))
    if known is not None:
        order = F.col("key_id").cast(lines.schema["first_seen"].dataType)
        lines = lines.unionByName(
            known.select("service", F.col("template").alias("line"), order.alias("first_seen"), F.lit(True).alias("_known"))
        )
    tokens = F.split("line", " ")
    head = tokens[0]
    routed = lines.withColumns(
        {"_n": F.size(tokens), "_prefix": F.when(head.rlike("[0-9]"), WILDCARD).otherwise(head)}
    )
    clustered = written(
        routed.repartition(*_LEAF)
        .sortWithinPartitions(*_LEAF, F.desc("_known"), "first_seen", "line")
        .mapInPandas(_cluster_leaves, _CLUSTERED),
        "clustered-lines",
    )
    found = clustered.filter("template IS NOT NULL").select(*_LEAF, "cluster", "template", "seed")
    members = clustered.filter("template IS NULL").drop("template", "seed")
    fitted = members.join(sized(found), [*_LEAF, "cluster"])
    return fitted.select("service", F.col("line").alias("cleaned_text"), "template", "seed")


def mined_keys(logs: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cleaned logs → (logs with mined ``template`` and ``key_id``, the dictionary as it is now).

    A known template keeps its key even when new lines widen it; new ones are numbered on by
    first appearance.
    """
    fitted = written(fit_templates(logs, known), "fitted")
    templated = written(assign_fitted(logs, fitted), "templated")
    if known is None:
        dictionary = written(template_keys(templated), "dictionary")
        return assign_keys(templated.drop("seed"), dictionary), dictionary
    grown = fitted.filter("seed IS NOT NULL").select("service", "seed", F.col("template").alias("_wide")).distinct()
    renamed = known.join(grown.withColumnRenamed("seed", "template"), ["service", "template"], "left").select(
        "service", F.coalesce("_wide", "template").alias("template"), "key_id", "size"
    )
    dictionary = written(template_keys(templated, written(renamed, "known-templates")), "dictionary")
    return assign_keys(templated.drop("seed"), dictionary), dictionary


def template_keys(templated: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Dictionary (service, template) → key, numbered by first appearance per service.

    Keys start after the reserved ids. ``known`` templates keep their keys and the new
    ones continue after the largest.
    """
    seen = templated.groupBy("service", "template").agg(
        F.min(position()).alias("_first"), F.count(F.lit(1)).alias("size")
    )
    # one pass over the lines; everything below works on the far smaller table of templates
    seen = written(seen, "templates-seen")
    if known is None:
        numbered = number_rows(seen, ["_first"], ["service"], "_no")
        return numbered.select("service", "template", (F.col("_no") + RESERVED_IDS).alias("key_id"), "size")
    fresh = seen.join(known.select("service", "template"), ["service", "template"], "left_anti")
    last = known.groupBy("service").agg(F.max("key_id").alias("_last"))
    grown = number_rows(fresh, ["_first"], ["service"], "_no").join(last, "service", "left")
    added = grown.select(
        "service",
        "template",
        (F.col("_no") + F.coalesce("_last", F.lit(RESERVED_IDS))).alias("key_id"),
        "size",
    )
    old = known.join(
        seen.select("service", "template", F.col("size").alias("_more")), ["service", "template"], "left"
    ).select("service", "template", "key_id", (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"))
    return old.unionByName(added)


def assign_keys(templated: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add ``key_id`` to every line."""
    keys = dictionary.select("service", "template", "key_id")
    return templated.join(sized(keys, of=dictionary), ["service", "template"], "left")


def assign_fitted(logs: DataFrame, fitted: DataFrame) -> DataFrame:
    """Add the mined template to every line."""
    return logs.join(sized(fitted), ["service", "cleaned_text"], "left")


def keyed(logs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Cleaned logs → logs with template and key by masking.

    The templated lines are stored once: the dictionary and the lookup both read them.
    """
    templated = written(masked_templates(logs), "templated")
    return assign_keys(templated, template_keys(templated) if dictionary is None else dictionary)


def template_stats(dictionary: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` largest templates per service and the number of templates."""
    counts = dictionary.groupBy("service").agg(F.count(F.lit(1)).alias("n_templates"))
    ranked = first_rows(dictionary, top, [F.desc("size"), F.asc("template")], ["service"])
    return ranked.join(counts, "service")


def vocabulary_size(dictionary: DataFrame) -> DataFrame:
    """Templates + reserved ids, per service."""
    return dictionary.groupBy("service").agg((F.count(F.lit(1)) + RESERVED_IDS).alias("vocab_size"))


def cached_vocabulary_size(sequences: DataFrame, ids: str = "line") -> DataFrame:
    """Largest id in stored sequences."""
    return sequences.agg(F.max(F.array_max(ids)).alias("vocab_size"))
