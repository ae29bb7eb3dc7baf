"""Evaluation of rankings: per-query measures, averages, rank buckets, graded measures.

Inputs: ``gold(qid, gold)`` and ``run(run_id, qid, docid, rank)``. A query without ranking or gold scores 0 and stays in the
denominator. ``per_query`` takes the first place of the gold document; ``repeated_hits`` counts a document listed twice twice, as the
evaluated protocol does for lists that aren't normalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_relevant_rank(run: DataFrame, gold: DataFrame) -> DataFrame:
    """``run_id, qid, gold, rank`` for every system and query; rank -1 where the gold isn't listed.

    Systems are few (one row each), so pairing them with all queries broadcasts them; hits are found by an equi-join.
    """
    systems = run.select("run_id").distinct()
    hits = run.join(gold.withColumnRenamed("gold", "docid"), ["qid", "docid"]).groupBy("run_id", "qid").agg(F.min("rank").alias("hit"))
    every = gold.crossJoin(F.broadcast(systems))
    return every.join(hits, ["run_id", "qid"], "left").select("run_id", "qid", "gold", F.coalesce("hit", F.lit(-1)).alias("rank"))


def hit(k: int) -> Column:
    return F.col("rank").between(1, k).cast("double")


def reciprocal(k: int) -> Column:
    return F.when(F.col("rank").between(1, k), 1 / F.col("rank")).otherwise(F.lit(0.0))


def gain(k: int) -> Column:
    return F.when(F.col("rank").between(1, k), 1 / F.log2(F.col("rank") + 1)).otherwise(F.lit(0.0))


def per_query(ranked: DataFrame) -> DataFrame:
    """All single-gold measures of each system and query."""
    ap = F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(F.lit(0.0))
    measures = [hit(k).alias(f"recall_{k}") for k in (1, 5, 10, 100)]
    measures += [(hit(k) / k).alias(f"precision_{k}") for k in (1, 5, 10)]
    measures += [hit(1).alias("f1_1"), reciprocal(5).alias("mrr_5"), ap.alias("ap")]
    measures += [gain(k).alias(f"ndcg_{k}") for k in (5, 10, 100)]
    return ranked.select("run_id", "qid", "gold", "rank", *measures)


def repeated_hits(run: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """``run_id, qid, times, first_rank, precision_k, ap, ndcg_k`` of the queries whose gold is listed; every place of it is a hit."""
    hits = run.join(gold.withColumnRenamed("gold", "docid"), ["qid", "docid"])
    so_far = F.row_number().over(Window.partitionBy("run_id", "qid").orderBy("rank"))
    early = F.col("rank") <= k
    return hits.withColumn("n", so_far).groupBy("run_id", "qid").agg(
        F.count(F.lit(1)).alias("times"),
        F.min("rank").alias("first_rank"),
        (F.sum(early.cast("int")) / k).alias(f"precision_{k}"),
        F.sum(F.col("n") / F.col("rank")).alias("ap"),
        F.sum(F.when(early, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"ndcg_{k}"),
    )


def averages(ranked: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Means per system, rounded to six digits."""
    return ranked.groupBy("run_id").agg(*[F.round(F.avg(v), 6).alias(k) for k, v in measures.items()])


def rank_buckets(ranked: DataFrame) -> DataFrame:
    """Queries per system and bucket of the first relevant rank, with percentages."""
    r = F.col("rank")
    bucket = F.when(r < 0, "missing").when(r == 1, "1").when(r <= 5, "2-5").when(r <= 10, "6-10").when(r <= 100, "11-100").otherwise(">100")
    counts = ranked.groupBy("run_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("run_id"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / total, 4))


def average_precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``run_id, qid, ap`` over full lists for any number of relevant documents; ``qrels(qid, docid)``."""
    size = qrels.groupBy("qid").agg(F.count(F.lit(1)).alias("relevant"))
    hits = run.join(qrels, ["qid", "docid"])
    found = Window.partitionBy("run_id", "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    gained = hits.withColumn("p", F.count(F.lit(1)).over(found) / F.col("rank"))
    return gained.groupBy("run_id", "qid").agg(F.sum("p").alias("s")).join(size, "qid").select("run_id", "qid", (F.col("s") / F.col("relevant")).alias("ap"))


def graded_ndcg(judged: DataFrame, k: int, exponential: bool = True) -> DataFrame:
    """nDCG of ``run_id, qid, rank, rel``; the ideal order is that of the retrieved judgements."""
    value = F.pow(F.lit(2.0), F.col("rel")) - 1 if exponential else F.col("rel").cast("double")
    ideal = Window.partitionBy("run_id", "qid").orderBy(F.desc("rel"), "rank")
    rows = judged.withColumn("ideal_rank", F.row_number().over(ideal))

    def dcg(rank: str) -> Column:
        return F.sum(F.when(F.col(rank) <= k, value / F.log2(F.col(rank) + 1)).otherwise(0.0))

    sums = rows.groupBy("run_id", "qid").agg(dcg("rank").alias("d"), dcg("ideal_rank").alias("i"))
    return sums.select("run_id", "qid", F.when(F.col("i") > 0, F.col("d") / F.col("i")).otherwise(F.lit(0.0)).alias("ndcg"))
