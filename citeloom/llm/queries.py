"""Queries of the training-data operators over the tables of a scale directory, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import bpe, curves, langid, leakage, overlap, pairs, splitter, topn, toxicity
from citeloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = overlap.cross_split_overlap(table(spark, d, "en_train"), table(spark, d, "eval_queries"))
    return found.select(F.col("train_id").alias("train_qid"), F.col("eval_id").alias("eval_qid"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "en_train"), table(spark, d, "eval_queries"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitter.split_oversized(table(spark, d, "collection_data"), "abstract", ["pubkey"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).filter("n_pieces > 1 AND pubkey IS NOT NULL").select("pubkey").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p2_cover(spark: SparkSession, d: str) -> DataFrame:
    """Per key: characters of its abstracts as its pieces cover them, and whether every piece keeps the limit."""
    new = F.col("end_at") - F.col("start_at")
    cut = _pieces(spark, d).filter("pubkey IS NOT NULL").groupBy("pubkey").agg(F.sum(new).alias("chars"), (F.max(F.char_length("piece")) <= 1500).alias("fits"))
    return cut.select("pubkey", F.col("chars").cast("long").alias("chars"), "fits")


def _top(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, d, "run_entry"), ["run_id", "qid"], "docid", "score", 5)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("run_id", "qid", "docid")


def p3_lists(spark: SparkSession, d: str) -> DataFrame:
    return topn.prediction_lists(_top(spark, d), ["run_id", "qid"], "docid")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = curves.neighbours(table(spark, d, "paper_vectors"), "vec_id", "vec", k=5, least=0.9)
    return curves.similar_pairs(found, 0.9)


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    found = curves.neighbours(table(spark, d, "paper_vectors"), "vec_id", "vec", k=5, curves=16, window=128, hold=0.92)
    return found.select(F.col("id").alias("vec_id"), F.col("other").alias("neighbour"), F.round("similarity", 4).alias("similarity"), "rank")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    columns = ["qid", "text", "lang"]
    both = table(spark, d, "final_fr_test").select(*columns).unionByName(table(spark, d, "final_de_tradottoen_test").select(*columns))
    return both.distinct()


def _profiles(spark: SparkSession, d: str) -> dict[str, list[str]]:
    return langid.profiles(table(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = langid.label_faults(_answers(spark, d), _profiles(spark, d)).filter("fault IS NOT NULL")
    return found.select("qid", F.explode("languages").alias("lang")).distinct()


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    found = langid.identify(_answers(spark, d), _profiles(spark, d))
    return found.select("qid", "found_lang", F.round("confidence", 4).alias("confidence"), F.posexplode("segments").alias("segment_no", "s")).select(
        "qid", "found_lang", "confidence", "segment_no", F.col("s.lang").alias("segment_lang"), F.round("s.confidence", 4).alias("segment_confidence"), "s.words", "s.start_at", "s.end_at"
    )


def p5_cover(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each text that its segments cover one behind the other; texts without words have none."""
    found = langid.identify(_answers(spark, d), _profiles(spark, d)).filter(F.size("segments") > 0)
    total = F.aggregate("segments", F.lit(0), lambda n, x: n + x["end_at"] - x["start_at"])
    chars = F.element_at("segments", -1)["end_at"] - F.element_at("segments", 1)["start_at"]
    return found.select("qid", chars.cast("long").alias("chars"), (total == chars).alias("joined")).distinct()


def _defects(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "final_de_tradottoen_test").select("qid", "text_original", "text").distinct()
    return pairs.defects(rows, _profiles(spark, d)).filter("defect IS NOT NULL")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    weight = F.array_position(F.array(*map(F.lit, pairs.ORDER)), F.col("defect"))
    return _defects(spark, d).groupBy("qid").agg(F.min_by("defect", weight).alias("defect"))


def p6_defects(spark: SparkSession, d: str) -> DataFrame:
    """Every defect of each pair, in one row a query."""
    rows = _defects(spark, d).select("qid", F.explode("all_defects").alias("defect")).distinct()
    return rows.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("defect")), ",").alias("defects"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    leaks = _leaks(spark, d).join(table(spark, d, "heldout_items").select("item_id", "split").distinct(), "item_id")
    return leaks.groupBy("split").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("item_id").alias("items"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    model = toxicity.fit(documents, table(spark, d, "doc_labels"), table(spark, d, "flag_terms"))
    return toxicity.score(documents.select("doc_id", "source", "text"), model)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter(F.col("toxicity") >= toxicity.FLAG_AT).select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "source", F.round("toxicity", 4).alias("toxicity"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.source_rates(_scored(spark, d))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_report, p2_found, p2_pieces, p2_cover, p3_found, p3_lists, p4_found, p4_neighbours, p5_found, p5_segments, p5_cover,
            p6_found, p6_defects, p7_ids, p8_found, p8_report, p9_found, p9_scores, p9_rates,
        )
    }


_TOP = """
    SELECT run_id, qid, docid, row_number() OVER (PARTITION BY run_id, qid ORDER BY score DESC, CAST(docid AS HUGEINT), docid) AS r
    FROM (SELECT run_id, qid, docid, max(score) AS score FROM run_entry WHERE score IS NOT NULL AND NOT isnan(score) AND docid IS NOT NULL
          GROUP BY run_id, qid, docid)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": r"SELECT DISTINCT pubkey FROM collection_data WHERE pubkey IS NOT NULL AND length(regexp_replace(abstract, '^\s+|\s+$', '', 'g')) > 1500",
        "p2_cover": r"""SELECT pubkey, CAST(sum(length(t)) AS BIGINT) AS chars, true AS fits FROM (SELECT pubkey, regexp_replace(abstract, '^\s+|\s+$', '', 'g') AS t FROM collection_data)
            WHERE t <> '' AND pubkey IS NOT NULL GROUP BY pubkey""",
        "p5_cover": r"""SELECT DISTINCT qid, CAST(length(text) AS BIGINT) AS chars, true AS joined FROM (SELECT qid, text FROM final_fr_test UNION ALL SELECT qid, text FROM final_de_tradottoen_test)
            WHERE regexp_matches(regexp_replace(text, '(https?://|www\.)\S+|[@#]\w+|[\p{L}\p{N}_-]*\p{N}[\p{L}\p{N}_-]*', ' ', 'g'), '\p{L}')""",
        "p3_found": f"SELECT run_id, qid, docid FROM ({_TOP}) WHERE r <= 5",
        "p3_lists": f"SELECT run_id, qid, '[' || string_agg(docid, ', ' ORDER BY r) || ']' AS preds FROM ({_TOP}) WHERE r <= 5 GROUP BY run_id, qid",
        "p4_found": """
            WITH v AS (SELECT vec_id, CAST(vec AS DOUBLE[64]) AS u FROM paper_vectors
                       WHERE vec IS NOT NULL AND list_sum(list_transform(vec, lambda x: x * x)) > 0),
                 s AS (SELECT a.vec_id AS a, b.vec_id AS b, array_cosine_similarity(a.u, b.u) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id),
                 r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE s >= 0.9)
            SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE r <= 5""",
    }
