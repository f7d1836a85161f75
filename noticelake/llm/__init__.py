"""Operators for preparing language-model training data, one module each.

Every module offers a general operator (DataFrame in, DataFrame out) and a thin
``opN_<name>(spark, sf_dir)`` query that applies it to a whole table.  ``queries`` and
``oracle_sql`` collect those queries for the entry module.
"""

from __future__ import annotations

from . import (
    chat,
    contamination,
    exact,
    hmm,
    langmix,
    lines,
    negatives,
    packing,
    quality,
    simhash,
    substrings,
    tokenfile,
    whitening,
)

_MODULES = (
    substrings,
    chat,
    simhash,
    langmix,
    quality,
    exact,
    tokenfile,
    contamination,
    packing,
    lines,
    hmm,
    whitening,
    negatives,
)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
