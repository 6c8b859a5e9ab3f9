"""Registered queries over the given tables, with the same questions in SQL."""

from . import budgets, concepts, context, contracts, details, manifests, masking, matching, outcomes, planning, reporting, reports, screening, stateful, streams, views  # noqa: F401  (register their plans)
from .catalogue import ORACLES, PLANS

__all__ = ["ORACLES", "PLANS"]
