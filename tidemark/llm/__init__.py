"""Operators of a training-data pipeline: fingerprints, deduplication, tokens, packing, language, extraction.

Nothing outside this folder imports it. ``QUERIES`` and ``ORACLES`` hold what ``__spark_entry__`` adds; they are loaded on
first use, so a Python worker that runs one operator does not hold the libraries of all.
"""

from __future__ import annotations


def __getattr__(name: str):
    if name in ("QUERIES", "ORACLES"):
        from tidemark.llm import queries

        return getattr(queries, name)
    raise AttributeError(name)
