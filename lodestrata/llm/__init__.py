"""Operators for preparing large training corpora, one module each.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
collect what the modules register for ``__spark_entry__``.
"""

from __future__ import annotations


def _modules():
    from . import alignment, chat, digest, loss, mil, packing, pii, ppm, qgram, secrets, simhash, spelling, warc

    return [ppm, loss, qgram, mil, secrets, simhash, chat, packing, warc, digest, alignment, pii, spelling]


def queries():
    """Query name -> callable(spark, sf_dir), over all modules."""
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql():
    """Query name -> DuckDB SQL, for the queries that SQL can express."""
    return {name: sql for m in _modules() for name, sql in m.ORACLE_SQL.items()}
