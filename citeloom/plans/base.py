"""Base tables of the queries: papers, topics, runs and gold, cleaned once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions.text import doc_text
from citeloom.session import table


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Papers with a key and text; of a repeated key the first record with text."""
    rows = table(spark, d, "collection_data").withColumn("doc_text", doc_text())
    rows = rows.filter(F.col("pubkey").isNotNull() & (F.trim("pubkey") != "") & (F.col("doc_text") != ""))
    order = Window.partitionBy("pubkey").orderBy("doc_text", F.coalesce("venue", F.lit("")), F.coalesce("authors", F.lit("")))
    columns = ["pubkey", "title", "abstract", "venue", "authors", "doc_text"]
    return rows.withColumn("n", F.row_number().over(order)).filter("n = 1").select(*columns)


def _one_per_qid(rows: DataFrame, *columns: str) -> DataFrame:
    rows = rows.filter("qid IS NOT NULL AND text IS NOT NULL AND trim(text) != ''")
    return rows.groupBy("qid").agg(F.min("text").alias("text"), F.min("pubkey").alias("gold"), *[F.min(c).alias(c) for c in columns])


def topics(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation queries, one row a qid."""
    return _one_per_qid(table(spark, d, "eval_queries"), "split", "source")


def train(spark: SparkSession, d: str) -> DataFrame:
    """Training queries, one row a qid."""
    return _one_per_qid(table(spark, d, "en_train"), "source")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs ranked by score (best score of a document; ties by document)."""
    rows = table(spark, d, "run_entry").filter("score IS NOT NULL AND NOT isnan(score)")
    best = rows.groupBy("run_id", "qid", "docid").agg(F.max("score").alias("score"))
    order = Window.partitionBy("run_id", "qid").orderBy(F.desc("score"), "docid")
    return best.withColumn("rank", F.row_number().over(order))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Gold paper of each German query."""
    return table(spark, d, "final_de_tradottoen_test").filter("qid IS NOT NULL").groupBy("qid").agg(F.min("pubkey").alias("gold"))
