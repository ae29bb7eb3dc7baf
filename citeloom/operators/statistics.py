"""Comparison of systems: summaries, rank tests, analysis of variance. Scores come as ``run_id, qid, score``.

All sums are distributed; only one row per system or pair of systems reaches the driver, where tails are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions import dist


def summary(scores: DataFrame) -> DataFrame:
    """n, mean, median, sample deviation (0 for one value), minimum, maximum per system."""
    s = F.col("score")
    return scores.groupBy("run_id").agg(
        F.count(s).alias("n"),
        F.round(F.avg(s), 6).alias("mean"),
        F.round(F.median(s), 6).alias("median"),
        F.round(F.coalesce(F.stddev_samp(s), F.lit(0.0)), 6).alias("sd"),
        F.round(F.min(s), 6).alias("lowest"),
        F.round(F.max(s), 6).alias("highest"),
    )


def normal_interval(scores: DataFrame, by: str = "run_id") -> DataFrame:
    """Mean with 1.96 standard errors to both sides."""
    s = F.col("score")
    half = 1.96 * F.coalesce(F.stddev_samp(s), F.lit(0.0)) / F.sqrt(F.count(s))
    return scores.groupBy(by).agg(F.round(F.avg(s), 6).alias("mean"), F.round(F.avg(s) - half, 6).alias("low"), F.round(F.avg(s) + half, 6).alias("high"))


def t_interval(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Mean with a Student interval; one value has a degenerate one. One row per system is collected for the quantiles."""
    s = F.col("score")
    base = scores.groupBy("run_id").agg(F.count(s).alias("n"), F.avg(s).alias("m"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("sd"))
    sizes = [r.n for r in base.select("n").distinct().collect()]
    quantile = F.lit(0.0)
    for n in sizes:
        quantile = F.when(F.col("n") == n, F.lit(dist.t_quantile(alpha, n - 1) if n > 1 else 0.0)).otherwise(quantile)
    half = quantile * F.col("sd") / F.sqrt("n")
    return base.select("run_id", F.round("m", 6).alias("mean"), F.round(F.col("m") - half, 6).alias("low"), F.round(F.col("m") + half, 6).alias("high"))


def average_ranks(rows: DataFrame, partition: list[str], value: Column, name: str) -> DataFrame:
    """Ranks with ties averaged, in ascending order of ``value``."""
    tied = Window.partitionBy(*partition, value)
    order = Window.partitionBy(*partition).orderBy(value)
    return rows.withColumn(name, F.rank().over(order) + (F.count(F.lit(1)).over(tied) - 1) / 2)


def friedman_sums(scores: DataFrame) -> DataFrame:
    """One row: systems k, queries n, statistic (tie-corrected; 0 when no row has a difference)."""
    ranked = average_ranks(scores.withColumn("v", F.round("score", 9)), ["qid"], F.col("v"), "r")
    rank_sums = ranked.groupBy("run_id").agg(F.sum("r").alias("s")).agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    ties = ranked.groupBy("qid", "v").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"), F.countDistinct("qid").alias("n"))
    k, n = F.col("k"), F.col("n")
    correction = 1 - F.col("ties") / (n * (F.pow(k, F.lit(3)) - k))
    raw = 12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    return rank_sums.crossJoin(ties).select("k", "n", F.round(F.when(correction > 0, raw / correction).otherwise(0.0), 6).alias("chi2"))


def friedman(scores: DataFrame) -> dict[str, float | str]:
    """Friedman test; fewer than three systems give a note."""
    row = friedman_sums(scores).first()
    if row is None or row.k < 3:
        return {"note": "needs at least three systems"}
    return {"systems": row.k, "queries": row.n, "chi2": row.chi2, "p": dist.chi2_tail(row.chi2, row.k - 1) if row.chi2 > 0 else 1.0}


def paired_differences(scores: DataFrame) -> DataFrame:
    """``a, b, qid, diff`` of all pairs of systems (a < b) on common queries."""
    a = scores.select("qid", F.col("run_id").alias("a"), F.col("score").alias("x"))
    b = scores.select("qid", F.col("run_id").alias("b"), F.col("score").alias("y"))
    return a.join(b, "qid").filter("a < b").select("a", "b", "qid", F.round(F.col("x") - F.col("y"), 9).alias("diff"))


def wilcoxon_sums(diffs: DataFrame) -> DataFrame:
    """Signed-rank sums with zeros ranked and then dropped: ``a, b, n, wins, losses, zeros, w, z``."""
    ranked = average_ranks(diffs.withColumn("size", F.abs("diff")), ["a", "b"], F.col("size"), "r")
    tied = ranked.filter("size > 0").groupBy("a", "b", "size").agg(F.count(F.lit(1)).alias("t")).groupBy("a", "b").agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    sums = ranked.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("diff") > 0).cast("bigint")).alias("wins"),
        F.sum((F.col("diff") < 0).cast("bigint")).alias("losses"),
        F.sum((F.col("diff") == 0).cast("bigint")).alias("zeros"),
        F.sum(F.when(F.col("diff") > 0, F.col("r")).otherwise(0.0)).alias("up"),
        F.sum(F.when(F.col("diff") < 0, F.col("r")).otherwise(0.0)).alias("down"),
    )
    n, z0 = F.col("n").cast("double"), F.col("zeros").cast("double")
    mean = n * (n + 1) / 4 - z0 * (z0 + 1) / 4
    var = (n * (n + 1) * (2 * n + 1) - z0 * (z0 + 1) * (2 * z0 + 1) - F.coalesce("ties", F.lit(0.0)) / 2) / 24
    w = F.least("up", "down")
    z = F.when(var > 0, (w - mean) / F.sqrt(var)).otherwise(0.0)
    rows = sums.join(tied, ["a", "b"], "left")
    return rows.select("a", "b", "n", "wins", "losses", "zeros", F.round(w, 4).alias("w"), F.round(z, 6).alias("z"))


def wilcoxon_holm(diffs: DataFrame) -> list[dict[str, float | str]]:
    """Tests of all pairs with Holm-adjusted values; one row per pair reaches the driver."""
    rows = [r.asDict() for r in wilcoxon_sums(diffs).collect()]
    for r in rows:
        r["p"] = dist.normal_tail(r["z"]) if r["zeros"] < r["n"] else 1.0
    rows.sort(key=lambda r: (r["p"], r["a"], r["b"]))
    for r, p in zip(rows, holm([r["p"] for r in rows])):
        r["p_holm"] = p
    return rows


def holm(p: list[float]) -> list[float]:
    """Step-down adjusted values, in the given order."""
    order = sorted(range(len(p)), key=lambda i: p[i])
    out, high = [0.0] * len(p), 0.0
    for k, i in enumerate(order):
        high = max(high, min(1.0, (len(p) - k) * p[i]))
        out[i] = high
    return out


def holm_adjust(tests: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """``tests`` with ``p_holm``, per family ``by``; families are small (pairs of systems)."""
    family = Window.partitionBy(*(by or [F.lit(0)]))
    order = family.orderBy(p, *[c for c in tests.columns if c != p])
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(family) - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("__s", step).withColumn("p_holm", F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def blocked_anova_sums(scores: DataFrame) -> DataFrame:
    """One row of a balanced two-way layout: systems, queries, sums of squares, F of the systems."""
    total = scores.agg(F.avg("score").alias("m"), F.count(F.lit(1)).alias("cells"))
    ss_total = scores.crossJoin(F.broadcast(total)).agg(F.sum(F.pow(F.col("score") - F.col("m"), F.lit(2))).alias("ss_total"))

    def between(c: str, name: str) -> DataFrame:
        means = scores.groupBy(c).agg(F.avg("score").alias("g"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))
        return means.agg(F.sum(F.col("n") * F.pow(F.col("g") - F.col("m"), F.lit(2))).alias(f"ss_{name}"), F.count(F.lit(1)).alias(f"n_{name}"))

    rows = between("run_id", "systems").crossJoin(between("qid", "queries")).crossJoin(ss_total)
    a, b = F.col("n_systems") - 1, F.col("n_queries") - 1
    rest = F.col("ss_total") - F.col("ss_systems") - F.col("ss_queries")
    mse = rest / (a * b)
    return rows.select(
        "n_systems", "n_queries", F.round("ss_systems", 6).alias("ss_systems"), F.round("ss_queries", 6).alias("ss_queries"),
        F.round(rest, 6).alias("ss_error"), F.round(mse, 9).alias("mse"), F.round(F.col("ss_systems") / a / mse, 6).alias("f"),
    )


def tukey_hsd(scores: DataFrame) -> DataFrame:
    """``a, b, diff, se, q`` of all pairs in the blocked layout (one row per system broadcast)."""
    means = scores.groupBy("run_id").agg(F.avg("score").alias("m"))
    base = blocked_anova_sums(scores).select(F.sqrt(F.col("mse") / F.col("n_queries")).alias("se"))
    a, b = means.select(F.col("run_id").alias("a"), F.col("m").alias("x")), means.select(F.col("run_id").alias("b"), F.col("m").alias("y"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).crossJoin(F.broadcast(base))
    q = F.when(F.col("se") > 0, F.abs(F.col("x") - F.col("y")) / F.col("se")).otherwise(0.0)
    return pairs.select("a", "b", F.round(F.col("x") - F.col("y"), 6).alias("diff"), F.round("se", 6).alias("se"), F.round(q, 4).alias("q"))


def tukey_tests(scores: DataFrame, alpha: float = 0.05) -> list[dict[str, float | str | bool]]:
    """Tukey tests with tails of the studentized range."""
    sums = blocked_anova_sums(scores).first()
    df = (sums.n_systems - 1) * (sums.n_queries - 1)
    out = []
    for r in tukey_hsd(scores).collect():
        p = dist.studentized_range_tail(r.q, sums.n_systems, df) if r.se > 0 else (0.0 if r["diff"] else 1.0)
        out.append(r.asDict() | {"p": p, "reject": p < alpha})
    return out


