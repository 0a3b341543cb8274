"""Manifest-driven ingest: which sources to read, and how."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.series import union_all
from pulsegrid.sources.traces import load_series


def load_manifest(path_or_dict: str | dict[str, Any]) -> dict[str, Any]:
    cfg = path_or_dict
    if isinstance(cfg, str):
        with open(cfg, encoding="utf-8") as f:
            cfg = json.load(f)
    if not isinstance(cfg.get("sources"), list):
        raise ValueError("the manifest needs a list of sources")
    return cfg


def ingest(spark: SparkSession, manifest: str | dict[str, Any]) -> DataFrame:
    """Union of the enabled sources as ``(timestamp, value, weight, source)``. Sources without rows
    simply add none."""
    enabled = [s for s in load_manifest(manifest)["sources"] if s.get("enabled", False)]
    if not enabled:
        raise RuntimeError("no source is enabled in the manifest")
    return union_all([
        load_series(spark, s).withColumns({
            "weight": F.lit(float(s.get("weight", 1.0))), "source": F.lit(s["name"])})
        for s in enabled])


def contributions(tagged: DataFrame) -> DataFrame:
    """Rows per source."""
    return tagged.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
