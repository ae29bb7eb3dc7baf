"""Evaluation reports as JSON (small results) and manifests and long tables as CSV, on any file system of the cluster."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.session import path_exists, write_file

#: Per-query rows that a report may hold; larger ones belong into a table.
MAX_ROWS = 1_000_000


def free_path(spark: SparkSession, path: str) -> str:
    """``path``, or the first of ``name_1``, ``name_2``, ... that doesn't exist."""
    stem, ext = posixpath.splitext(path)
    n, out = 0, path
    while path_exists(spark, out):
        n += 1
        out = f"{stem}_{n}{ext}"
    return out


def write_report(spark: SparkSession, path: str, metadata: dict, metrics: dict, per_query: DataFrame | None = None) -> str:
    """Write a report beside existing ones, by a temporary file and a rename; returns its path."""
    out = free_path(spark, path)
    rows = [] if per_query is None else [r.asDict() for r in per_query.limit(MAX_ROWS + 1).collect()]
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows: write a table instead")
    write_file(spark, out, [json.dumps({"metadata": metadata, "metrics": metrics, "per_query": rows}, ensure_ascii=False, indent=1)])
    return out


def long_metrics(per_query: DataFrame, keys: tuple[str, ...] = ("run_id", "qid")) -> DataFrame:
    """A row for each system, query and measure: ``keys``, ``metric``, ``value``."""
    measures = [c for c, t in per_query.dtypes if t == "double"]
    return per_query.unpivot(list(keys), measures, "metric", "value")


def manifest(runs: DataFrame, queries: DataFrame, contexts: DataFrame, least: float = 0.0) -> DataFrame:
    """A row for each system with enough of the queries: how many it ranks, how many of those asked, their share, split and language.

    ``runs(run_id, qid)``, ``queries(qid)``, ``contexts(run_id, split, lang)``; systems are few.
    """
    asked = queries.select("qid").distinct().withColumn("__asked", F.lit(True))
    total = asked.agg(F.count(F.lit(1)).alias("__n"))
    counts = runs.select("run_id", "qid").distinct().join(asked, "qid", "left").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("ranking_qids"), F.count("__asked").alias("matched_qids")
    )
    rows = counts.crossJoin(F.broadcast(total)).withColumn("coverage", F.col("matched_qids") / F.col("__n")).filter(F.col("coverage") >= least)
    return rows.join(contexts, "run_id", "left").select("run_id", "ranking_qids", "matched_qids", "coverage", "split", "lang")
