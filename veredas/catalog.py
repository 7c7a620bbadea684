"""Every query of the library by name, and the SQL that says the same."""

from __future__ import annotations

from veredas.plans import aggregates, batches, files, filters, joins, scalars, trees, windows  # noqa: F401
from veredas.plans.registry import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "flagship_ranking"
