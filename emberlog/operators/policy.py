"""Fine-tuning by reward: the next-key model as a policy whose weights follow the reward of what it predicts.

A policy has one weight per (service, context, next key), the logarithm of its share up to a constant per
context. Keys that a context has never been followed by share one weight, in a row without key
that stands for ``n_keys`` of them. A sequence is cut as a prompt is; every key from the cut on earns +1 if it is
among the top k and -1 if not, and the cost of the sequence is minus its reward times its log-probability.
A step moves all weights against the gradient of the mean cost of their service. The gradient is a sum over
positions: two aggregations, one by key and one by context, whatever the number of sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.sequences import prompt_length
from emberlog.operators.joins import sized
from emberlog.operators.nextkey import ORDER, in_top_k, look_up, positions, unpadded
from emberlog.session import written

RATE = 1e-6
_CONTEXT = ["service", "context"]


def initial_policy(model: DataFrame, settings: DataFrame) -> DataFrame:
    """service, context, next_id, n_keys and weight, from a count model: the add-one smoothed shares.

    ``settings`` has one row per service: service, top_k, vocab_size.
    """
    sizes = settings.select("service", "vocab_size")
    counted = model.join(sized(sizes, of=settings), "service")
    total = F.col("total") + F.col("vocab_size")
    known = counted.select(*_CONTEXT, "next_id", F.lit(1).cast("long").alias("n_keys"), F.log((F.col("n") + 1) / total).alias("weight"))
    rest = counted.groupBy(*_CONTEXT).agg(
        F.lit(None).cast(model.schema["next_id"].dataType).alias("next_id"),
        F.greatest(F.first("vocab_size") - F.count(F.lit(1)), F.lit(0)).alias("n_keys"),
        F.first(F.log(F.lit(1.0) / total)).alias("weight"),
    )
    return known.unionByName(rest)


def _shares(policy: DataFrame) -> DataFrame:
    """Add ``share``, the probability of a row's key, or of each key that it stands for.

    A context has at most one row per key of the service's vocabulary.
    """
    over = F.sum(F.col("n_keys") * F.exp("weight")).over(Window.partitionBy(*_CONTEXT))
    return policy.withColumn("share", F.exp("weight") / over)


def _as_model(policy: DataFrame) -> DataFrame:
    """The policy in the form that ``look_up`` takes: keys ranked by weight, ``n`` is their share."""
    context = Window.partitionBy(*_CONTEXT)
    rest = F.max(F.when(F.col("next_id").isNull(), F.col("share"))).over(context)
    rank = F.row_number().over(context.orderBy(F.desc_nulls_last("weight"), F.asc("next_id"))).cast("long")
    known = _shares(policy).withColumn("total", rest).filter("next_id is not null")
    return known.select(*_CONTEXT, "next_id", F.col("share").alias("n"), rank.alias("rank"), "total")


def _played(
    sequences: DataFrame, policy: DataFrame, settings: DataFrame, cut: float, margin: int, order: int, ids: str
) -> DataFrame:
    """Positions after the cut: chunk_id, service, context (as the policy has it), next_id, gain and log_share."""
    length = F.size(unpadded(F.col(ids)))
    framed = sequences.withColumns({"_start": F.floor(F.lit(cut) * length), "prompt_len": prompt_length(length, cut, margin)})
    after = positions(framed, order, ids, ("chunk_id", "service", "_start")).filter(F.col("pos") >= F.col("_start"))
    scored = look_up(after, written(_as_model(policy), "policy-model"), order).join(sized(settings), "service", "left")
    used = F.slice("context", F.size("context") - F.col("used") + 1, F.col("used"))
    share = F.coalesce("n", "total")
    return scored.filter("used is not null").select(
        "chunk_id", "service", used.alias("context"), "next_id",
        F.when(in_top_k(F.col("top_k")), 1).otherwise(-1).alias("gain"), F.log(share).alias("log_share"),
    )


def policy_rewards(
    sequences: DataFrame, policy: DataFrame, settings: DataFrame, cut: float = 0.8, margin: int = 2, order: int = ORDER, ids: str = "input_ids"
) -> DataFrame:
    """Reward, log-probability and cost of each sequence under the policy."""
    played = _played(sequences, policy, settings, cut, margin, order, ids)
    per_chunk = played.groupBy("chunk_id", "service").agg(F.sum("gain").alias("reward"), F.sum("log_share").alias("log_prob"))
    return per_chunk.withColumn("cost", F.lit(0.0) - F.col("reward") * F.col("log_prob"))


def policy_step(
    sequences: DataFrame,
    policy: DataFrame,
    settings: DataFrame,
    rate: float | Column = RATE,
    cut: float = 0.8,
    margin: int = 2,
    order: int = ORDER,
    ids: str = "input_ids",
) -> DataFrame:
    """The policy after one step against the gradient of the mean cost, per service.

    The slope of a sequence's cost along a weight is minus its reward times how much more often the key follows the
    context in it than the policy expects.
    """
    played = written(_played(sequences, policy, settings, cut, margin, order, ids), "policy-played")
    rewards = written(played.groupBy("chunk_id", "service").agg(F.sum("gain").alias("_reward")), "policy-rewards")
    counts = rewards.groupBy("service").agg(F.count(F.lit(1)).alias("_n"))
    earned = played.join(rewards, ["chunk_id", "service"])
    # one pass over the positions; everything below works on the far smaller table of what was earned by key
    by_key = written(earned.groupBy(*_CONTEXT, "next_id").agg(F.sum("_reward").alias("_got")), "policy-earned")
    by_context = by_key.groupBy(*_CONTEXT).agg(F.sum("_got").alias("_all"))

    rows = _shares(policy).join(by_context, _CONTEXT, "left").join(sized(counts), "service", "left")
    known = rows.join(by_key, [*_CONTEXT, "next_id"], "left")
    # keys that get their first row begin at the weight that they shared
    rest = rows.filter("next_id is null").drop("next_id")
    fresh = by_key.join(policy.select(*_CONTEXT, "next_id"), [*_CONTEXT, "next_id"], "left_anti")
    added = fresh.join(rest.drop("n_keys"), _CONTEXT).withColumn("n_keys", F.lit(1).cast("long"))
    n_added = fresh.groupBy(*_CONTEXT).agg(F.count(F.lit(1)).alias("_added"))
    moved = F.col("weight") + F.lit(rate) / F.col("_n") * (F.coalesce("_got", F.lit(0)) - F.col("_all") * F.col("share"))
    fields = [*_CONTEXT, "next_id", "n_keys", F.coalesce(moved, "weight").alias("weight")]
    stepped = known.select(*fields).unionByName(added.select(*fields))
    left = F.when(F.col("next_id").isNull(), F.greatest(F.col("n_keys") - F.coalesce("_added", F.lit(0)), F.lit(0)))
    return stepped.join(n_added, _CONTEXT, "left").withColumn("n_keys", F.coalesce(left, "n_keys")).drop("_added")


def fine_tune(
    sequences: DataFrame, policy: DataFrame, settings: DataFrame, episodes: int = 10, rate: float = RATE, **options
) -> tuple[DataFrame, DataFrame]:
    """The policy after ``episodes`` steps, and the mean cost and reward before each: service, episode, loss, reward."""
    history = None
    for episode in range(episodes):
        costs = policy_rewards(sequences, policy, settings, **options).groupBy("service")
        row = written(costs.agg(F.lit(episode).alias("episode"), F.avg("cost").alias("loss"), F.avg("reward").alias("reward")), "policy-costs")
        history = row if history is None else history.unionByName(row)
        policy = written(policy_step(sequences, policy, settings, rate, **options), "policy")
    return policy, history
