"""Every query of the library, by name."""

from __future__ import annotations

import importlib

from pulsegrid.catalog import registry

_FAMILIES = ("stream_features", "series_queries", "rolling_queries", "source_queries", "decision_queries", "metric_queries", "model_queries", "streaming_queries", "asof_queries", "control_queries")


def _load() -> None:
    for name in _FAMILIES:
        importlib.import_module(f"pulsegrid.catalog.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLES)
