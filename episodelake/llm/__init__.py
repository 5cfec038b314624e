"""Operators for large training-data corpora, one module each.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries only when it is there.
"""

from __future__ import annotations


def queries() -> dict:
    """name -> callable(spark, sf_dir) of every query of this subpackage."""
    from episodelake.llm import corpus_queries as q

    return q.queries()


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL of the queries that SQL can express."""
    from episodelake.llm import corpus_queries as q

    return q.oracle_sql()
