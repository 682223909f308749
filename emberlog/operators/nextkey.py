"""Next-key scoring: a variable-order count model over framed key sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.sequences import PAD, prompt_length
from emberlog.operators.joins import sized
from emberlog.session import written

ORDER = 2
# Least improvement that counts, and the stalls allowed before stopping.
LEAST_GAIN = 0.01
STALLS_ALLOWED = 3


def unpadded(ids: Column) -> Column:
    return F.filter(ids, lambda v: v != PAD)


def positions(sequences: DataFrame, order: int = ORDER, ids: str = "input_ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per predicted position: ``pos`` (0-based), the context before it, the actual key."""
    real = sequences.withColumn("_ids", unpadded(F.col(ids)))
    start = lambda i: F.greatest(i - order, F.lit(1))
    grams = F.transform(
        F.sequence(F.lit(2), F.size("_ids")),
        lambda i: F.struct(
            (i - 1).cast("long").alias("pos"),
            F.slice("_ids", start(i), i - start(i)).alias("context"),
            F.element_at("_ids", i).alias("next_id"),
        ),
    )
    exploded = real.filter(F.size("_ids") >= 2).select(*keep, F.explode(grams).alias("g"))
    return exploded.select(*keep, "g.*")


def session_contexts(positioned: DataFrame, session: str, order: int = ORDER) -> DataFrame:
    """``positions`` of sessions with one row per key (session, 1-based ``pos``, ``key_id``), of any length.

    Every key is sent to the ``order`` positions after it, so no task gathers a session.
    """
    sent = positioned.select(
        session,
        F.col("key_id").cast("int").alias("_key"),
        F.posexplode(F.sequence(F.col("pos"), F.col("pos") + order)).alias("_back", "_pos"),
    )
    at = lambda back: F.max(F.when(F.col("_back") == back, F.col("_key")))
    met = sent.groupBy(session, "_pos").agg(
        at(0).alias("next_id"), F.array(*[at(back) for back in range(order, 0, -1)]).alias("_before")
    )
    return met.filter("next_id is not null and _pos > 1").select(
        F.col(session).alias("chunk_id"),
        F.lit("").alias("service"),
        (F.col("_pos") - 1).cast("long").alias("pos"),
        F.filter("_before", lambda x: x.isNotNull()).alias("context"),
        "next_id",
    )


def _suffix(context: Column, length) -> Column:
    return F.slice(context, F.size(context) - length + 1, length)


def count_keys(sequences: DataFrame, order: int = ORDER, ids: str = "input_ids", weight: int = 1) -> DataFrame:
    """Counts n of (service, context, next key) for every context length up to ``order``.

    The longest contexts are counted first, with partial aggregation; the shorter ones are
    sums over that much smaller table.
    """
    return count_positions(positions(sequences, order, ids, ("service",)), weight)


def count_positions(predicted: DataFrame, weight: int = 1) -> DataFrame:
    """The counts of ``count_keys`` from positions (service, context, next_id)."""
    longest = predicted.groupBy("service", "context", "next_id").agg((F.count(F.lit(1)) * weight).alias("n"))
    shorter = longest.select(
        "service", "context", "next_id", "n", F.explode(F.sequence(F.lit(0), F.size("context"))).alias("m")
    )
    return shorter.groupBy("service", _suffix(F.col("context"), F.col("m")).alias("context"), "next_id").agg(
        F.sum("n").alias("n")
    )


def ranked(counts: DataFrame) -> DataFrame:
    """Model rows: counts with the rank of each next key in its context and the context total.

    A context has at most one row per key of the service's vocabulary.
    """
    context = Window.partitionBy("service", "context")
    return counts.withColumns(
        {
            "rank": F.row_number().over(context.orderBy(F.desc("n"), F.asc("next_id"))).cast("long"),
            "total": F.sum("n").over(context),
        }
    )


def train(sequences: DataFrame, order: int = ORDER, ids: str = "input_ids") -> DataFrame:
    return ranked(count_keys(sequences, order, ids))


def update(model: DataFrame, sequences: DataFrame, order: int = ORDER, ids: str = "input_ids", weight: int = 1) -> DataFrame:
    """Add the (weighted) counts of more sequences and rank again."""
    more = count_keys(sequences, order, ids, weight)
    both = model.select("service", "context", "next_id", "n").unionByName(more)
    return ranked(both.groupBy("service", "context", "next_id").agg(F.sum("n").alias("n")))


def training_sets(chunks: DataFrame, strategy: str) -> DataFrame:
    """Stored chunks of one train strategy, one row per chunk."""
    return chunks.filter(F.coalesce("train_strategy", F.lit("ignore")) == strategy)


def training_set_sizes(chunks: DataFrame) -> DataFrame:
    """Chunks and keys per (train strategy, service)."""
    return chunks.groupBy(F.coalesce("train_strategy", F.lit("ignore")).alias("train_strategy"), "service").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.size(unpadded(F.col("input_ids")))).alias("n_ids")
    )


def look_up(predicted: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """Join positions with the model at the longest context seen in training.

    Adds ``used`` (that context's length), ``rank``, ``n`` and ``total``; rank and n are NULL
    when the key never followed the context. Only the distinct (service, context, next key) are
    looked up, and mapped back to the positions. No row is ever joined on the empty context:
    that level is one row per service.
    """
    contexts = model.filter("rank = 1").select("service", F.col("context").alias("_seen"), "total")
    transition = ["service", "context", "next_id"]
    wanted = written(predicted.select(*transition).distinct(), "transitions")
    given = wanted.select("service", "context").distinct().filter(F.size("context") > 0)
    suffixes = given.select(
        "service", "context", F.explode(F.sequence(F.lit(1), F.size("context"))).alias("_m")
    ).withColumn("_seen", _suffix(F.col("context"), F.col("_m")))
    longest = (
        suffixes.join(contexts.filter(F.size("_seen") > 0), ["service", "_seen"])
        .groupBy("service", "context")
        .agg(F.max("_m").alias("used"), F.max_by("total", "_m").alias("total"))
    )
    found = wanted.join(longest, ["service", "context"], "left")
    anywhere = contexts.filter("size(_seen) = 0").select("service", F.col("total").alias("_all"))
    found = found.join(sized(anywhere), "service", "left").withColumns(
        {"used": F.coalesce("used", F.when(F.col("_all").isNotNull(), 0)), "total": F.coalesce("total", "_all")}
    )
    seen = found.drop("_all").withColumn("_seen", _suffix(F.col("context"), F.col("used")))
    pairs = model.select("service", F.col("context").alias("_seen"), "next_id", "rank", "n")
    resolved = written(seen.join(sized(pairs, of=model), ["service", "_seen", "next_id"], "left").drop("_seen"), "looked-up")
    return predicted.join(sized(resolved), transition, "left")


def in_top_k(top_k: Column) -> Column:
    return F.coalesce(F.col("rank") <= top_k, F.lit(False))


def detect(sequences: DataFrame, model: DataFrame, top_k: DataFrame, order: int = ORDER, ids: str = "input_ids") -> DataFrame:
    """Per chunk: positions, misses, first miss, verdict (any key outside the top ``top_k``).

    ``top_k`` has one row per service: service, top_k.
    """
    return judge(positions(sequences, order, ids, ("chunk_id", "service")), model, top_k, order)


def judge(predicted: DataFrame, model: DataFrame, top_k: DataFrame, order: int = ORDER) -> DataFrame:
    """The verdicts of ``detect`` from positions (chunk_id, service, pos, context, next_id)."""
    scored = look_up(predicted, model, order)
    hit = in_top_k(F.col("top_k"))
    return (
        scored.join(sized(top_k), "service", "left")
        .groupBy("chunk_id", "service")
        .agg(
            F.count(F.lit(1)).alias("n_positions"),
            F.count_if(~hit).alias("n_miss"),
            F.min(F.when(~hit, F.col("pos"))).alias("first_miss_pos"),
        )
        .withColumn("is_anomaly", F.col("n_miss") > 0)
    )


def log_probability(vocab_size: Column) -> Column:
    """Natural log of the add-one smoothed probability at the context used."""
    return F.log((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + vocab_size))


def policy_cost(
    sequences: DataFrame,
    model: DataFrame,
    settings: DataFrame,
    cut: float = 0.8,
    margin: int = 2,
    order: int = ORDER,
    ids: str = "input_ids",
) -> DataFrame:
    """Reward, log-probability and cost of each sequence after its cut.

    ``settings`` has one row per service: service, top_k, vocab_size. Every key from the cut
    on earns +1 inside the top k and -1 outside; cost = -reward * log-probability.
    """
    length = F.size(unpadded(F.col(ids)))
    framed = sequences.withColumns(
        {
            "_start": F.floor(F.lit(cut) * length),
            "prompt_len": prompt_length(length, cut, margin),
        }
    )
    after = positions(framed, order, ids, ("chunk_id", "service", "_start", "prompt_len")).filter(
        F.col("pos") >= F.col("_start")
    )
    scored = look_up(after, model, order).join(sized(settings), "service", "left")
    return (
        scored.groupBy("chunk_id", "service", "prompt_len")
        .agg(
            F.sum(F.when(in_top_k(F.col("top_k")), 1).otherwise(-1)).alias("reward"),
            F.sum(log_probability(F.col("vocab_size"))).alias("log_prob"),
        )
        .withColumn("cost", F.lit(0.0) - F.col("reward") * F.col("log_prob"))
    )


def held_out_loss(sequences: DataFrame, model: DataFrame, settings: DataFrame, order: int = ORDER, ids: str = "input_ids") -> DataFrame:
    """Mean negative log-probability per position and service."""
    scored = look_up(positions(sequences, order, ids, ("service",)), model, order)
    loss = F.avg(-log_probability(F.col("vocab_size")))
    return scored.join(sized(settings), "service", "left").groupBy("service").agg(
        F.count(F.lit(1)).alias("n_positions"), loss.alias("loss")
    )


def training_summary(history: DataFrame, group: str = "service", step: str = "episode", loss: str = "loss") -> DataFrame:
    """Where training stops and which step is kept, from a loss history.

    A step stalls when it gains at most ``LEAST_GAIN`` on the one before (the first one is
    compared with zero); stalls are never forgotten. The step after ``STALLS_ALLOWED``
    stalls stops training and is not kept itself. One group has one row per step.
    """
    ordered = Window.partitionBy(group).orderBy(step)
    stalled = (F.lag(loss, 1, 0.0).over(ordered) - F.col(loss)) <= LEAST_GAIN
    running = F.sum("_stall").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    counted = history.withColumn("_stall", stalled.cast("int")).withColumn("stalls", running)
    kept = F.col("stalls") <= STALLS_ALLOWED
    return counted.groupBy(group).agg(
        F.min(F.when(~kept, F.col(step))).alias("stopped_at"),
        F.min_by(F.col(step), F.when(kept, F.struct(F.col(loss), F.col(step)))).alias("best_step"),
        F.min(F.when(kept, F.col(loss))).alias("best_loss"),
        F.count_if(kept).alias("steps_kept"),
    )


def sequence_predictions(chunks: DataFrame, verdicts: DataFrame, services: DataFrame) -> DataFrame:
    """Messages of the sequence detector.

    Chunks of training services all pass, as not anomalous; of the others only anomalies.
    """
    judged = chunks.join(verdicts.select("chunk_id", "is_anomaly"), "chunk_id", "left")
    modes = services.select(F.col("name").alias("service"), F.coalesce("is_train", F.lit(False)).alias("_train"))
    found = F.coalesce(F.col("is_anomaly"), F.lit(False))
    training = F.coalesce(F.col("_train"), F.lit(False))
    joined = judged.join(sized(modes, of=services), "service", "left").filter(training | found)
    return joined.withColumns({"type": F.lit("log_gpt"), "is_anomaly": ~training & found}).drop("_train")
