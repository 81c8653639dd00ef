"""Queries of this subpackage, by name."""

from __future__ import annotations

from skein.llm import chat, decontamination, divergence, licenses, lines, neardup, packing, periodic, quality, sharding, substring, toxicity, warc

_MODULES = [chat, decontamination, divergence, licenses, lines, neardup, packing, periodic, quality, sharding, substring, toxicity, warc]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in getattr(m, "ORACLES", {}).items()}
