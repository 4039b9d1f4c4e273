"""All registered queries."""

from panelstat.plans import (  # noqa: F401
    catalog_metrics,
    catalog_review,
    catalog_similarity,
    catalog_sources,
    catalog_stats,
    catalog_streaming,
    catalog_survey,
)
from panelstat.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
