"""Queries of this package, registered beside the others by the entry file."""

from __future__ import annotations

from incidentry.llm import queries as _queries


def add_to(queries: dict, oracles: dict) -> None:
    """Add every query here and the pipeline, and the SQL where SQL can express them."""
    import corpus_pipeline

    queries.update(_queries.QUERIES)
    oracles.update(_queries.ORACLES)
    queries["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
