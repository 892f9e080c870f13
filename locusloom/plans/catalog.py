"""All registered queries."""

from locusloom.plans import catalog_jobs, catalog_merge, catalog_reports, catalog_sources, catalog_streams  # noqa: F401
from locusloom.plans import catalog_files  # noqa: F401 - after catalog_merge, whose SQL it reads
from locusloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
