"""All queries over the standard tables."""

from . import base, checks, control, corpus, evidence, retrieval, rounds, sync, textual  # noqa: F401 (they register themselves)

queries = base.QUERIES
oracle_sql = base.SQL
