"""Registered queries and their SQL counterparts, collected from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ["texts", "traffic", "screen", "search", "catalog", "page_texts", "links", "cards"]


def _modules():
    return [importlib.import_module(f"songsieve.plans.{name}") for name in MODULES]


def queries() -> dict:
    out: dict = {}
    for module in _modules():
        out |= module.QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for module in _modules():
        out |= module.ORACLES
    return out
