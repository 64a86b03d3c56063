"""Registered queries of the library's own operators, each with equivalent SQL."""

from . import claims, clauses, index, mail, metadata, preprocess, profile, records, state, structure, vectors

MODULES = (profile, structure, clauses, claims, vectors, index, state, records, metadata, mail, preprocess)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
