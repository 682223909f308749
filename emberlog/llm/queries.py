"""All registered queries of this package."""

from __future__ import annotations

from emberlog.llm import bpe_codec, chat_format, exact_dedup, filter_audit, minhash_dedup, mixing, prefix_trie, quality, suffix_dedup, token_counts, topk, toxicity, warc  # noqa: F401
from emberlog.llm.registry import ORACLE, QUERIES  # noqa: F401
