"""Operators for building training corpora: one module each, their queries in ``registered``."""

from __future__ import annotations


def queries() -> dict:
    from newsloom.llm.registered import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from newsloom.llm.registered import ORACLES

    return dict(ORACLES)
