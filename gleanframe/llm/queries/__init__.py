"""Registered queries of the training-data operators, with their DuckDB counterparts."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline

MODULES = ["layout", "leaks", "copies", "classes", "exposure", "wording", "search", "threads"]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"{__name__}.{name}"), attribute))
    return merged


QUERIES = {**_merged("QUERIES"), "pipeline": corpus_pipeline.run}
ORACLES = _merged("ORACLES")
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
