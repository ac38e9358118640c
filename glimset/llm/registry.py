"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, langid, mixing, near_dup, quality, revisit, sharding, topk, toxicity, urlfilter

MODULES = [decontaminate, langid, mixing, near_dup, quality, revisit, sharding, topk, toxicity, urlfilter]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
