"""All queries of the library and their SQL."""

from pactlake.plans import graphs  # noqa: F401  registers its queries with those of profiling
from pactlake.plans.profiling import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
