"""All registered queries."""

from __future__ import annotations

from emberlog.plans import (  # noqa: F401
    evaluation,
    feed,
    ingest,
    lines,
    live,
    nextkeys,
    retrieval,
    service_config,
    streams,
    templates,
    windows,
)
from emberlog.plans.feed import flagship  # noqa: F401
from emberlog.plans.registry import ORACLE, QUERIES  # noqa: F401
