"""All registered queries."""

from cueloom.plans import evidence, geometry, ingest, laying_out, ledgers, matching, readings, segmenting, streams, texts  # noqa: F401
from cueloom.plans.registry import PLANS, SQL

__all__ = ["PLANS", "SQL"]
