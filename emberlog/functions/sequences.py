"""Array functions over key sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reserved ids of every key sequence, and the default context sizes.
BOS, EOS, PAD = 0, 1, 2
RESERVED_IDS = 3
ONLINE_CONTEXT = 512
OFFLINE_CONTEXT = 256


def _ints(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("int") for v in values])


def _repeat(value: int, times: Column) -> Column:
    return F.array_repeat(F.lit(value).cast("int"), F.greatest(times, F.lit(0)).cast("int"))


def frame(keys: Column, context: int = ONLINE_CONTEXT) -> Column:
    """BOS + keys + EOS, padded to ``context``."""
    return F.concat(_ints(BOS), keys, _ints(EOS), _repeat(PAD, F.lit(context - 2) - F.size(keys)))


def frame_mask(keys: Column, context: int = ONLINE_CONTEXT) -> Column:
    used = F.size(keys) + 2
    return F.concat(_repeat(1, used), _repeat(0, F.lit(context) - used))


def frame_truncated(keys: Column, context: int = OFFLINE_CONTEXT) -> Column:
    """As ``frame``; a longer sequence keeps its first ``context - 1`` ids and ends with EOS."""
    framed = F.concat(_ints(BOS), keys, _ints(EOS))
    return F.when(
        F.size(framed) > context, F.concat(F.slice(framed, 1, context - 1), _ints(EOS))
    ).otherwise(F.concat(framed, _repeat(PAD, F.lit(context) - F.size(framed))))


def pad_mask(ids: Column, pad: int = PAD) -> Column:
    return F.transform(ids, lambda v: F.when(v != pad, 1).otherwise(0))


def prompt_length(length: Column, cut: float, margin: int = 2) -> Column:
    """Length of the prompt that a cut at ``cut`` leaves.

    ``margin`` is 2 for framed sequences and 1 for sliding ones.
    """
    start = F.floor(F.lit(cut) * length)
    return (
        F.when(start < margin, F.least(F.lit(margin), length))
        .when(start >= length - margin, F.greatest(length - margin, F.lit(0)))
        .otherwise(start)
        .cast("int")
    )
