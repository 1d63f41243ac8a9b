"""All registered queries of the engine's own operators."""

from __future__ import annotations

from strata.plans import after_merge, code, composite, coordination, history, lineages, logs, matching_rules, merging, nested, objects, ordering, policies, scalars, streams, structural, texts, versions
from strata.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "after_merge", "code", "composite", "coordination", "history", "lineages", "logs", "matching_rules", "merging", "nested", "objects", "ordering", "policies", "scalars", "streams", "structural", "texts", "versions"]
