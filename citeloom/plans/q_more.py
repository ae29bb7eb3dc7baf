"""Queries of plug-in points, stemming and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import stem as ST
from citeloom.functions import text as T
from citeloom.operators import plugins as P
from citeloom.operators import retrieval as R
from citeloom.plans import base
from citeloom.plans import sqltext as S
from citeloom.plans.registry import query
from citeloom.session import table
from citeloom.streaming import intake


@query()
def tokenize_sparse_stem(spark: SparkSession, d: str) -> DataFrame:
    return base.topics(spark, d).select("qid", F.array_join(ST.stemmed(T.tokenize_sparse("text")), " ").alias("terms"))


_WORDS = f"list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\\-]{{3,}}'), lambda t: NOT list_contains({S.STOP}, lower(t)))"
#: Keywords of ``text`` by SQL: telling words first, each once, in text order.
KEYWORDS = f"""(SELECT coalesce(string_agg(t, ' ' ORDER BY k, p), '') FROM (SELECT t, k, p, row_number() OVER (ORDER BY k, p) AS r FROM (
    SELECT t, min(p) AS p, CASE WHEN regexp_matches(t, '[0-9\\-]') OR regexp_matches(t, '^[A-Z]') OR length(t) > 5 THEN 0 ELSE 1 END AS k
    FROM (SELECT unnest({_WORDS}) AS t, generate_subscripts({_WORDS}, 1) AS p) GROUP BY t)) WHERE r <= 12)"""


@query(f"WITH {S.TOPICS} SELECT qid, {KEYWORDS} AS keywords FROM topics")
def keyword_extraction(spark: SparkSession, d: str) -> DataFrame:
    return base.topics(spark, d).select("qid", F.array_join(P.keywords("text"), " ").alias("keywords"))


@query()
def encoded_search(spark: SparkSession, d: str) -> DataFrame:
    """Texts through the encoder plug-in, then exact search: ten nearest papers of each query."""
    docs = P.encode(base.corpus(spark, d).select(F.col("pubkey").alias("docid"), "doc_text"), "doc_text", "v", P.hashing_encoder())
    queries = P.encode(base.topics(spark, d).select(F.col("qid").cast("string").alias("qid"), "text"), "text", "v", P.hashing_encoder())
    return R.dense_top_k(queries, docs, 10)


@query(f"""WITH {S.TOPICS} SELECT qid, CASE WHEN length(text) % 3 = 2 THEN {KEYWORDS} WHEN length(text) % 3 = 1 THEN 'again about ' || substr(text, 1, 40) ELSE 'about ' || substr(text, 1, 40) END AS expanded FROM topics""")
def generated_expansion(spark: SparkSession, d: str) -> DataFrame:
    """The generator plug-in with a stand-in: a third of the texts is answered at once, a third when told what was wrong, a third never (the rule-based fallback)."""

    def factory():
        def answer(prompts: list[str]) -> list[str | None]:
            out = []
            for p in prompts:
                text, again, _ = p.partition("\n\nThe answer before was not valid: ")
                k = len(text) % 3
                out.append(f"about {text[:40]}" if k == 0 else f"again about {text[:40]}" if k == 1 and again else "" if k == 1 else None)
            return out

        return answer

    fallback = F.array_join(P.keywords("text"), " ")
    rows = base.topics(spark, d).select("qid", "text")
    return P.generate(rows, "text", "expanded", factory, fallback, lambda c: F.trim(c) != "", lambda a: None if a.strip() else "blank").select("qid", "expanded")


@query(f"""WITH r AS (SELECT DISTINCT text_original AS src, text AS dst FROM final_de_tradottoen_test WHERE text_original IS NOT NULL), c AS (SELECT src, min(dst) AS dst FROM r WHERE dst IS NOT NULL GROUP BY src),
    m AS (SELECT src, 'Translation: [en] ' || src AS raw FROM (SELECT DISTINCT src FROM r WHERE src NOT IN (SELECT src FROM c)))
    SELECT DISTINCT src, dst FROM (SELECT src, dst FROM c UNION ALL SELECT src, {S.clean_translation('raw')} FROM m) WHERE dst <> src""")
def translated(spark: SparkSession, d: str) -> DataFrame:
    """Cache first, generator stand-in for misses."""
    rows = table(spark, d, "final_de_tradottoen_test").filter("text_original IS NOT NULL").select(F.col("text_original").alias("src"), F.col("text").alias("dst"))
    cache = rows.filter("dst IS NOT NULL").groupBy("src").agg(F.min("dst").alias("dst"))
    return P.translate_missing(rows, cache, lambda: lambda texts: ["Translation: [en] " + t for t in texts])


@query("SELECT DISTINCT run_id, qid, docid, run_rank, CASE WHEN NOT isnan(score) THEN score END AS score, run_at, loaded_at FROM run_entry")
def stream_intake(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries taken in once each; a score that isn't a number counts as missing."""
    rows = intake.take_in(spark, f"{d}/run_entry.parq*et")
    return rows.withColumn("score", F.when(~F.isnan("score"), F.col("score"))).distinct()


@query("""SELECT date_trunc('hour', run_at) AS hour, run_id, CAST(count(*) AS BIGINT) AS rows, round(avg(epoch(date_trunc('second', loaded_at)) - epoch(date_trunc('second', run_at))), 3) AS delay
    FROM (SELECT DISTINCT * FROM run_entry) GROUP BY ALL""")
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    return intake.hourly_deliveries(intake.take_in(spark, f"{d}/run_entry.parq*et"))
