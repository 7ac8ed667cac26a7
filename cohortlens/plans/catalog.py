"""All registered queries."""

from cohortlens.plans import queries_columns, queries_models, queries_panel, queries_sources  # noqa: F401
from cohortlens.plans.registry import ENTRIES

__all__ = ["ENTRIES"]
