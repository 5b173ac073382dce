"""Search configurations, searches and registered queries."""

from . import feature_queries, match_queries, queries, search_queries, spectrum_queries  # noqa: F401
