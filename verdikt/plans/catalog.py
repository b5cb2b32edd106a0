"""Every registered query, gathered by importing the modules that register them."""

from verdikt.plans import agreement_queries, composition_queries, rating_queries, scoring_queries, source_queries  # noqa: F401
from verdikt.plans.registry import ORACLES as _WRITTEN, QUERIES, with_ctes  # noqa: F401

ORACLES = {name: with_ctes(sql) for name, sql in _WRITTEN.items()}
