"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    bpe,
    exact_dedup,
    filter_audit,
    language_model,
    licences,
    near_dedup,
    neighbours,
    packing,
    personal_data,
    phrases,
    quality,
    substring_dedup,
    token_files,
)

_MODULES = (
    quality,
    exact_dedup,
    bpe,
    neighbours,
    near_dedup,
    substring_dedup,
    language_model,
    token_files,
    licences,
    packing,
    phrases,
    filter_audit,
    personal_data,
)


def queries():
    return {name: run for m in _MODULES for name, run in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
