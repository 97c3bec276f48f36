"""Every registered query. Importing the query modules registers them."""

from tallymark.plans import (  # noqa: F401
    landing_queries, mart_queries, observation_queries, rate_queries, region_queries, report_queries, stream_queries, supply_queries,
    text_queries,
)
from tallymark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
