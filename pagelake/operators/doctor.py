"""Diagnostics: a small table of checks and their summary."""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checks(spark: SparkSession, data: str | None = None) -> DataFrame:
    """``(id, status, detail)``: versions, settings and optional inputs."""
    rows = [("spark.version", "ok", spark.version), ("java.version", "ok", str(spark.sparkContext._jvm.System.getProperty("java.version"))), ("spark.timezone", "ok" if spark.conf.get("spark.sql.session.timeZone") == "UTC" else "warn", spark.conf.get("spark.sql.session.timeZone")), ("spark.adaptive", "ok" if spark.conf.get("spark.sql.adaptive.enabled") == "true" else "warn", spark.conf.get("spark.sql.adaptive.enabled")), ("spark.checkpoint", "ok" if spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) else "warn", spark.conf.get("spark.checkpoint.dir", None) or "unset")]
    for module in ("pyarrow", "numpy", "xxhash", "ahocorasick", "regex"):
        try:
            rows.append((f"python.{module}", "ok", getattr(importlib.import_module(module), "__version__", "present")))
        except ImportError:
            rows.append((f"python.{module}", "fail", "missing"))
    if data:
        rows.append(("store.data", "ok" if os.path.isdir(data) else "fail", data))
    return spark.createDataFrame(rows, "id string, status string, detail string")


def summary(found: DataFrame) -> DataFrame:
    return found.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warn", "fail"))).withColumn("exit_code", F.when(F.col("fail") > 0, 1).otherwise(0))
