"""All queries of the core engine and their SQL twins."""

from __future__ import annotations

from . import imports, kernels, matches, people, relational, writes

_MODULES = (relational, imports, matches, kernels, writes, people)


def queries():
    return {name: run for m in _MODULES for name, run in m.queries().items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.oracle_sql().items()}
