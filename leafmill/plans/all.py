"""Imports every module that registers queries."""

from leafmill.operators import alignment, audits, filters, grids, joins, layout, mapping, outline, profiles, retrieval, rewrites, scoring, structure, styles  # noqa: F401
from leafmill.sources import catalog  # noqa: F401
from leafmill.streaming import runs  # noqa: F401
from leafmill.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
