"""Queries of evaluation and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions import dist
from citeloom.functions import text as T
from citeloom.operators import evaluation as E
from citeloom.operators import statistics as B
from citeloom.plans import base
from citeloom.plans import sqltext as S
from citeloom.plans.registry import query
from citeloom.session import table

HIT = {k: f"CAST(rank BETWEEN 1 AND {k} AS INTEGER)" for k in (1, 5, 10, 100)}
MRR = "CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0 / rank ELSE 0 END"
AP = "CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0 END"
GAIN = {k: f"CASE WHEN rank BETWEEN 1 AND {k} THEN 1 / log2(rank + 1) ELSE 0 END" for k in (5, 10, 100)}
SCORES = f"{S.RANKED}, scores AS (SELECT run_id, qid, CAST({MRR} AS DOUBLE) AS score FROM ranked)"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return E.first_relevant_rank(base.runs(spark, d), base.gold(spark, d))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("run_id", "qid", E.reciprocal(5).alias("score"))


@query(f"WITH {S.RANKED} SELECT run_id, qid, rank IS NOT NULL AND rank > 0 AS found FROM ranked")
def eval_join(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("run_id", "qid", (F.col("rank") > 0).alias("found"))


@query(f"WITH {S.RANKED} SELECT run_id, qid, CAST(rank AS INTEGER) AS rank FROM ranked")
def first_relevant_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("run_id", "qid", "rank")


def _mean_query(name: str, measures, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return E.averages(_ranked(spark, d), measures())

    query(f"WITH {S.RANKED} SELECT run_id, {sql} FROM ranked GROUP BY run_id", name)(run)


_mean_query("recall_at_k", lambda: {f"recall_{k}": E.hit(k) for k in HIT}, ", ".join(f"round(avg({v}), 6) AS recall_{k}" for k, v in HIT.items()))
_mean_query("precision_at_k", lambda: {f"precision_{k}": E.hit(k) / k for k in (1, 5, 10)}, ", ".join(f"round(avg({HIT[k]} / {k}), 6) AS precision_{k}" for k in (1, 5, 10)))
_mean_query("mrr_at_5", lambda: {"mrr_5": E.reciprocal(5)}, f"round(avg({MRR}), 6) AS mrr_5")
_mean_query("map", lambda: {"map": F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)}, f"round(avg({AP}), 6) AS map")
_mean_query("ndcg_at_k", lambda: {f"ndcg_{k}": E.gain(k) for k in GAIN}, ", ".join(f"round(avg({v}), 6) AS ndcg_{k}" for k, v in GAIN.items()))


@query(f"""WITH {S.RANKED}, m AS (SELECT run_id, avg({HIT[1]}) AS p, avg({HIT[1]}) AS r FROM ranked GROUP BY run_id)
    SELECT run_id, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1_macro, round(r, 6) AS f1_mean FROM m""")
def f1_at_1(spark: SparkSession, d: str) -> DataFrame:
    m = _ranked(spark, d).groupBy("run_id").agg(F.avg(E.hit(1)).alias("p"), F.avg(E.hit(1)).alias("r"))
    macro = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return m.select("run_id", F.round(macro, 6).alias("f1_macro"), F.round("r", 6).alias("f1_mean"))


@query(f"""WITH {S.RANKED} SELECT run_id, round(min({MRR}), 6) AS mrr_low, round(median({MRR}), 6) AS mrr_median, round(max({MRR}), 6) AS mrr_high,
    round(min({GAIN[10]}), 6) AS ndcg_low, round(median({GAIN[10]}), 6) AS ndcg_median, round(max({GAIN[10]}), 6) AS ndcg_high FROM ranked GROUP BY run_id""")
def per_query_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = []
    for name, m in (("mrr", E.reciprocal(5)), ("ndcg", E.gain(10))):
        stats += [F.round(f(m), 6).alias(f"{name}_{k}") for k, f in (("low", F.min), ("median", F.median), ("high", F.max))]
    return _ranked(spark, d).groupBy("run_id").agg(*stats)


@query(f"WITH {S.RANKED} SELECT run_id, qid, gold, CAST(rank AS INTEGER) AS rank, "
       + ", ".join(f"CAST({HIT[k]} AS DOUBLE) AS recall_{k}" for k in HIT) + ", " + ", ".join(f"round({HIT[k]} / {k}, 6) AS precision_{k}" for k in (1, 5, 10))
       + f", CAST({HIT[1]} AS DOUBLE) AS f1_1, round({MRR}, 6) AS mrr_5, round({AP}, 6) AS ap, " + ", ".join(f"round({v}, 6) AS ndcg_{k}" for k, v in GAIN.items()) + " FROM ranked")
def per_query_eval(spark: SparkSession, d: str) -> DataFrame:
    rows = E.per_query(_ranked(spark, d))
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in rows.dtypes])


JUDGED = f"""{S.RUNS}, judged AS (SELECT r.run_id, r.qid, r.rank, CASE WHEN r.docid = g.pubkey THEN 2 WHEN c.venue = k.venue THEN 1 ELSE 0 END AS rel
    FROM runs r JOIN (SELECT qid, min(pubkey) AS pubkey FROM final_de_tradottoen_test WHERE qid IS NOT NULL GROUP BY qid) g ON r.qid = g.qid
    LEFT JOIN corpus c ON c.pubkey = r.docid LEFT JOIN corpus k ON k.pubkey = g.pubkey)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """The gold paper has grade 2, papers of its venue grade 1."""
    papers = base.corpus(spark, d).select("pubkey", "venue")
    wanted = base.gold(spark, d).join(papers.select(F.col("pubkey").alias("gold"), F.col("venue").alias("own")), "gold", "left")
    rows = base.runs(spark, d).join(wanted, "qid").join(papers.select(F.col("pubkey").alias("docid"), "venue"), "docid", "left")
    rel = F.when(F.col("docid") == F.col("gold"), 2).when(F.col("venue") == F.col("own"), 1).otherwise(0)
    return rows.select("run_id", "qid", "rank", rel.alias("rel"))


def _ndcg_sql(gain: str) -> str:
    return f"""WITH {S.CORPUS}, {JUDGED}, i AS (SELECT *, row_number() OVER (PARTITION BY run_id, qid ORDER BY rel DESC, rank) AS ideal FROM judged),
    s AS (SELECT run_id, qid, sum(CASE WHEN rank <= 10 THEN ({gain}) / log2(rank + 1) ELSE 0 END) AS x, sum(CASE WHEN ideal <= 10 THEN ({gain}) / log2(ideal + 1) ELSE 0 END) AS y
          FROM i GROUP BY run_id, qid)
    SELECT run_id, round(avg(CASE WHEN y > 0 THEN x / y ELSE 0 END), 6) AS ndcg FROM s GROUP BY run_id"""


@query(_ndcg_sql("pow(2, rel) - 1"))
def graded_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return E.graded_ndcg(_judged(spark, d), 10).groupBy("run_id").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query(_ndcg_sql("rel"))
def linear_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return E.graded_ndcg(_judged(spark, d), 10, exponential=False).groupBy("run_id").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query(f"""WITH {S.CORPUS}, {JUDGED}, p AS (SELECT run_id, qid, min(CASE WHEN rel > 0 THEN rank END) AS first_hit, count(*) FILTER (rel = 0) AS negatives FROM judged GROUP BY run_id, qid)
    SELECT run_id, round(avg(coalesce(1.0 / first_hit, 0)), 6) AS mrr FROM p WHERE negatives > 0 GROUP BY run_id""")
def pool_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Pools without negatives are skipped."""
    p = _judged(spark, d).groupBy("run_id", "qid").agg(F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("hit"), F.sum((F.col("rel") == 0).cast("int")).alias("negatives"))
    return p.filter("negatives > 0").groupBy("run_id").agg(F.round(F.avg(F.coalesce(1 / F.col("hit"), F.lit(0.0))), 6).alias("mrr"))


@query(f"""WITH {S.CORPUS}, {JUDGED}, h AS (SELECT run_id, qid, rank, row_number() OVER (PARTITION BY run_id, qid ORDER BY rank) AS k FROM judged WHERE rel > 0)
    SELECT run_id, qid, round(sum(k / rank) / count(*), 6) AS ap FROM h GROUP BY run_id, qid""")
def average_precision_graded(spark: SparkSession, d: str) -> DataFrame:
    """AP over the retrieved relevant documents."""
    hits = _judged(spark, d).filter("rel > 0")
    k = F.row_number().over(Window.partitionBy("run_id", "qid").orderBy("rank"))
    return hits.withColumn("p", k / F.col("rank")).groupBy("run_id", "qid").agg(F.round(F.sum("p") / F.count(F.lit(1)), 6).alias("ap"))


@query(f"""WITH {S.RANKED}, m AS (SELECT run_id, avg({HIT[10]}) AS r, avg({MRR}) AS mrr FROM ranked GROUP BY run_id)
    SELECT a.run_id AS a, b.run_id AS b, round(b.r - a.r, 6) AS recall_delta, round(b.mrr - a.mrr, 6) AS mrr_delta FROM m a JOIN m b ON a.run_id < b.run_id""")
def metric_delta(spark: SparkSession, d: str) -> DataFrame:
    m = _ranked(spark, d).groupBy("run_id").agg(F.avg(E.hit(10)).alias("r"), F.avg(E.reciprocal(5)).alias("mrr"))
    a = m.select(F.col("run_id").alias("a"), F.col("r").alias("ra"), F.col("mrr").alias("ma"))
    b = m.select(F.col("run_id").alias("b"), F.col("r").alias("rb"), F.col("mrr").alias("mb"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(F.col("rb") - F.col("ra"), 6).alias("recall_delta"), F.round(F.col("mb") - F.col("ma"), 6).alias("mrr_delta"))


@query(f"""WITH {S.RANKED}, b AS (SELECT run_id, CASE WHEN rank < 0 THEN 'missing' WHEN rank = 1 THEN '1' WHEN rank <= 5 THEN '2-5' WHEN rank <= 10 THEN '6-10'
        WHEN rank <= 100 THEN '11-100' ELSE '>100' END AS bucket FROM ranked), c AS (SELECT run_id, bucket, count(*) AS n FROM b GROUP BY run_id, bucket)
    SELECT run_id, bucket, CAST(n AS BIGINT) AS n, round(100 * n / sum(n) OVER (PARTITION BY run_id), 4) AS percent FROM c""")
def rank_buckets(spark: SparkSession, d: str) -> DataFrame:
    return E.rank_buckets(_ranked(spark, d))


# Statistics.


@query(f"""WITH {SCORES} SELECT run_id, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(coalesce(stddev_samp(score), 0), 6) AS sd,
    round(min(score), 6) AS lowest, round(max(score), 6) AS highest FROM scores GROUP BY run_id""")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.summary(_scores(spark, d))


@query(f"""WITH {SCORES}, m AS (SELECT run_id, avg(score) AS m, 1.96 * coalesce(stddev_samp(score), 0) / sqrt(count(*)) AS h FROM scores GROUP BY run_id)
    SELECT run_id, round(m, 6) AS mean, round(m - h, 6) AS low, round(m + h, 6) AS high FROM m""")
def normal_ci(spark: SparkSession, d: str) -> DataFrame:
    return B.normal_interval(_scores(spark, d))


_Z = 1.959963984540054
#: Student's quantile from the normal one (Cornish-Fisher), v degrees of freedom.
_T = f"({_Z} + {(_Z**3 + _Z) / 4!r} / v + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r} / pow(v, 2) + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384!r} / pow(v, 3) + {(79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160!r} / pow(v, 4))"


@query(f"""WITH {SCORES}, m AS (SELECT run_id, avg(score) AS m, count(*) - 1 AS v, coalesce(stddev_samp(score), 0) / sqrt(count(*)) AS e FROM scores GROUP BY run_id)
    SELECT run_id, round(m, 6) AS mean, round(m - {_T} * e, 6) AS low, round(m + {_T} * e, 6) AS high FROM m""")
def student_ci(spark: SparkSession, d: str) -> DataFrame:
    return B.t_interval(_scores(spark, d))


@query(f"WITH {SCORES} SELECT qid, " + ", ".join(f"round(max(score) FILTER (run_id = '{r}'), 6) AS {r}" for r in ("dense_m", "lex_plain", "mix_k", "rerank_hi")) + " FROM scores GROUP BY qid")
def pivot_scores(spark: SparkSession, d: str) -> DataFrame:
    names = ["dense_m", "lex_plain", "mix_k", "rerank_hi"]
    return _scores(spark, d).groupBy("qid").pivot("run_id", names).agg(F.round(F.max("score"), 6))


@query(f"WITH {SCORES} SELECT * FROM (PIVOT scores ON run_id USING round(max(score), 6) GROUP BY qid)")
def pivot_scores_all(spark: SparkSession, d: str) -> DataFrame:
    """A column for every system of the runs; ``pivot_scores`` has four fixed ones."""
    names = sorted(r.run_id for r in base.runs(spark, d).select("run_id").distinct().collect() if r.run_id is not None)
    return _scores(spark, d).groupBy("qid").pivot("run_id", names).agg(F.round(F.max("score"), 6))


@query(f"""WITH {SCORES}, v AS (SELECT run_id, qid, round(score, 9) AS v FROM scores),
    r AS (SELECT run_id, qid, v, rank() OVER (PARTITION BY qid ORDER BY v) + (count(*) OVER (PARTITION BY qid, v) - 1) / 2 AS r FROM v),
    s AS (SELECT count(*) AS k, sum(s * s) AS ss FROM (SELECT run_id, sum(r) AS s FROM r GROUP BY run_id)),
    t AS (SELECT sum(t * t * t - t) AS ties, count(DISTINCT qid) AS n FROM (SELECT qid, v, count(*) AS t FROM r GROUP BY qid, v))
    SELECT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, round((12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * (k * k * k - k))), 6) AS chi2 FROM s, t""")
def friedman(spark: SparkSession, d: str) -> DataFrame:
    return B.friedman_sums(_scores(spark, d))


@query(f"""WITH {SCORES} SELECT a.run_id AS a, b.run_id AS b, a.qid, round(a.score - b.score, 9) AS diff FROM scores a JOIN scores b ON a.qid = b.qid AND a.run_id < b.run_id""")
def paired_diffs(spark: SparkSession, d: str) -> DataFrame:
    return B.paired_differences(_scores(spark, d))


WILCOXON = f"""{SCORES}, d AS (SELECT a.run_id AS a, b.run_id AS b, round(a.score - b.score, 9) AS diff FROM scores a JOIN scores b ON a.qid = b.qid AND a.run_id < b.run_id),
    r AS (SELECT a, b, diff, abs(diff) AS size, rank() OVER (PARTITION BY a, b ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY a, b, abs(diff)) - 1) / 2 AS r FROM d),
    t AS (SELECT a, b, sum(t * t * t - t) AS ties FROM (SELECT a, b, size, count(*) AS t FROM r WHERE size > 0 GROUP BY a, b, size) GROUP BY a, b),
    s AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff < 0) AS losses, CAST(count(*) FILTER (diff = 0) AS DOUBLE) AS zeros,
          sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS up, sum(CASE WHEN diff < 0 THEN r ELSE 0 END) AS down FROM r GROUP BY a, b),
    w AS (SELECT s.*, least(up, down) AS w, n * (n + 1) / 4 - zeros * (zeros + 1) / 4 AS mean,
          (n * (n + 1) * (2 * n + 1) - zeros * (zeros + 1) * (2 * zeros + 1) - coalesce(ties, 0) / 2) / 24 AS var FROM s LEFT JOIN t USING (a, b))"""


@query(f"""WITH {WILCOXON} SELECT a, b, CAST(n AS BIGINT) AS n, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, CAST(zeros AS BIGINT) AS zeros, round(w, 4) AS w,
    round(CASE WHEN var > 0 THEN (w - mean) / sqrt(var) ELSE 0 END, 6) AS z FROM w""")
def wilcoxon_pratt(spark: SparkSession, d: str) -> DataFrame:
    return B.wilcoxon_sums(B.paired_differences(_scores(spark, d)))


def _two_sided(z: str) -> str:
    x = f"(abs({z}) / sqrt(2))"
    t = f"(1 / (1 + {dist.ERFC_P} * {x}))"
    total = "0"
    for a in reversed(dist.ERFC_A):
        total = f"(({total} + {a}) * {t})"
    return f"{total} * exp(-{x} * {x})"


@query(f"""WITH {WILCOXON}, z AS (SELECT a, b, round(CASE WHEN var > 0 THEN (w - mean) / sqrt(var) ELSE 0 END, 6) AS z FROM w), p AS (SELECT a, b, round({_two_sided('z')}, 9) AS p FROM z),
    o AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, a, b) + 1) * p) AS s FROM p)
    SELECT a, b, round(p, 6) AS p, round(max(s) OVER (ORDER BY p, a, b ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM o""")
def holm_adjust(spark: SparkSession, d: str) -> DataFrame:
    """Holm's step-down over the two-sided Wilcoxon tails of all pairs of systems."""
    sums = B.wilcoxon_sums(B.paired_differences(_scores(spark, d)))
    tests = sums.select("a", "b", F.round(dist.normal_two_sided(F.col("z")), 9).alias("p"))
    return B.holm_adjust(tests).select("a", "b", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


@query(f"""WITH {SCORES}, d AS (SELECT b.run_id, b.score - a.score AS diff FROM scores a JOIN scores b ON a.qid = b.qid AND a.run_id = 'lex_plain' AND b.run_id <> 'lex_plain'),
    m AS (SELECT run_id, avg(diff) AS m, 1.96 * coalesce(stddev_samp(diff), 0) / sqrt(count(*)) AS h FROM d GROUP BY run_id)
    SELECT run_id, round(m, 6) AS mean, round(m - h, 6) AS low, round(m + h, 6) AS high FROM m""")
def baseline_delta(spark: SparkSession, d: str) -> DataFrame:
    scores = _scores(spark, d)
    first = scores.filter("run_id = 'lex_plain'").select("qid", F.col("score").alias("ref"))
    diffs = scores.filter("run_id <> 'lex_plain'").join(first, "qid").select("run_id", (F.col("score") - F.col("ref")).alias("score"))
    return B.normal_interval(diffs)


ANOVA = f"""{SCORES}, g AS (SELECT avg(score) AS m FROM scores),
    s AS (SELECT sum(n * pow(x - m, 2)) AS ss_systems, count(*) AS n_systems FROM (SELECT avg(score) AS x, count(*) AS n FROM scores GROUP BY run_id), g),
    q AS (SELECT sum(n * pow(x - m, 2)) AS ss_queries, count(*) AS n_queries FROM (SELECT avg(score) AS x, count(*) AS n FROM scores GROUP BY qid), g),
    t AS (SELECT sum(pow(score - m, 2)) AS ss_total FROM scores, g),
    e AS (SELECT *, ss_total - ss_systems - ss_queries AS rest, (ss_total - ss_systems - ss_queries) / ((n_systems - 1) * (n_queries - 1)) AS mse FROM s, q, t)"""


@query(f"""WITH {ANOVA} SELECT CAST(n_systems AS BIGINT) AS n_systems, CAST(n_queries AS BIGINT) AS n_queries, round(ss_systems, 6) AS ss_systems, round(ss_queries, 6) AS ss_queries,
    round(rest, 6) AS ss_error, round(mse, 9) AS mse, round(ss_systems / (n_systems - 1) / mse, 6) AS f FROM e""")
def blocked_anova(spark: SparkSession, d: str) -> DataFrame:
    return B.blocked_anova_sums(_scores(spark, d))


@query(f"""WITH {ANOVA}, m AS (SELECT run_id, avg(score) AS m FROM scores GROUP BY run_id), z AS (SELECT sqrt(round(mse, 9) / n_queries) AS se FROM e)
    SELECT a.run_id AS a, b.run_id AS b, round(a.m - b.m, 6) AS diff, round(se, 6) AS se, round(CASE WHEN se > 0 THEN abs(a.m - b.m) / se ELSE 0 END, 4) AS q
    FROM m a JOIN m b ON a.run_id < b.run_id, z""")
def tukey_hsd(spark: SparkSession, d: str) -> DataFrame:
    return B.tukey_hsd(_scores(spark, d))


@query(f"""WITH {S.RANKED}, t AS (SELECT qid, min(text) AS text FROM final_de_tradottoen_test WHERE qid IS NOT NULL AND text IS NOT NULL GROUP BY qid),
    f AS (SELECT r.run_id, {MRR} AS score, len(string_split({S.ws('t.text')}, ' ')) AS n, {S.cue_score('t.text')} AS cues FROM ranked r JOIN t USING (qid)),
    b AS (SELECT run_id, 'length' AS family, CASE WHEN n <= 20 THEN 'short' WHEN n <= 34 THEN 'middle' ELSE 'long' END AS bucket, score FROM f
          UNION ALL SELECT run_id, 'cue', CASE WHEN cues < 4 THEN 'few' ELSE 'many' END, score FROM f)
    SELECT run_id, family, bucket, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean FROM b GROUP BY run_id, family, bucket""")
def query_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Both bucket families in one pass over the scores."""
    t = table(spark, d, "final_de_tradottoen_test").filter("qid IS NOT NULL AND text IS NOT NULL").groupBy("qid").agg(F.min("text").alias("text"))
    n = F.size(F.split(T.normalize_ws("text"), " "))
    cues = T.entity_cue_score("text")
    length = F.when(n <= 20, "short").when(n <= 34, "middle").otherwise("long")
    families = F.array(
        F.struct(F.lit("length").alias("family"), length.alias("bucket")), F.struct(F.lit("cue").alias("family"), F.when(cues < 4, "few").otherwise("many").alias("bucket"))
    )
    rows = _scores(spark, d).join(t, "qid").select("run_id", "score", F.explode(families).alias("f")).select("run_id", "f.*", "score")
    return rows.groupBy("run_id", "family", "bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(f"""SELECT source, CAST(least(10, floor(n / 10)) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM (SELECT source, CAST(len({S.tok_sparse('text')}) AS BIGINT) AS n FROM en_train WHERE text IS NOT NULL)
    GROUP BY source, bin""")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "en_train").filter("text IS NOT NULL").select("source", F.least(F.lit(10), F.floor(F.size(T.tokenize_sparse("text")) / 10)).alias("bin"))
    return rows.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(min(n) AS INTEGER) AS lowest, median(n) AS median, CAST(max(n) AS INTEGER) AS highest, round(avg(n), 6) AS mean
    FROM (SELECT source, len({S.tok_sparse('text')}) AS n FROM en_train WHERE text IS NOT NULL) GROUP BY source""")
def length_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "en_train").filter("text IS NOT NULL").select("source", F.size(T.tokenize_sparse("text")).alias("n"))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("k"), F.min("n").alias("lowest"), F.median("n").alias("median"), F.max("n").alias("highest"), F.round(F.avg("n"), 6).alias("mean")
    ).withColumnRenamed("k", "n")


def _vocabulary(rows: DataFrame) -> DataFrame:
    return rows.filter("text IS NOT NULL").select(F.explode(T.vocabulary_words("text")).alias("w")).distinct()


@query(r"""WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\b[a-z]{3,}\b')) AS w FROM en_train WHERE text IS NOT NULL),
    b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\b[a-z]{3,}\b')) AS w FROM eval_queries WHERE text IS NOT NULL),
    c AS (SELECT (SELECT count(*) FROM (SELECT w FROM a INTERSECT SELECT w FROM b)) AS common, (SELECT count(*) FROM (SELECT w FROM a UNION SELECT w FROM b)) AS every)
    SELECT CAST(common AS BIGINT) AS common, CAST(every AS BIGINT) AS every, round(common / every, 6) AS jaccard, common / every < 0.5 AS shifted FROM c""")
def vocab_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """One pass: each word with the sides it occurs on."""
    a = _vocabulary(table(spark, d, "en_train")).withColumn("side", F.lit(1))
    b = _vocabulary(table(spark, d, "eval_queries")).withColumn("side", F.lit(2))
    words = a.unionByName(b).groupBy("w").agg(F.sum("side").alias("sides"))
    counts = words.agg(F.coalesce(F.sum((F.col("sides") == 3).cast("bigint")), F.lit(0)).alias("common"), F.count(F.lit(1)).alias("every"))
    share = F.col("common") / F.col("every")
    return counts.select("common", "every", F.round(share, 6).alias("jaccard"), (share < 0.5).alias("shifted"))


@query("""SELECT run_id, round(corr(score, run_rank), 6) AS r, round(regr_slope(score, run_rank), 6) AS slope, round(regr_intercept(score, run_rank), 6) AS intercept
    FROM run_entry WHERE score IS NOT NULL AND NOT isnan(score) AND run_rank > 0 GROUP BY run_id""")
def trial_correlation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "run_entry").filter("score IS NOT NULL AND NOT isnan(score) AND run_rank > 0").withColumn("x", F.col("run_rank").cast("double"))
    return rows.groupBy("run_id").agg(
        F.round(F.corr("score", "x"), 6).alias("r"), F.round(F.regr_slope("score", "x"), 6).alias("slope"), F.round(F.regr_intercept("score", "x"), 6).alias("intercept")
    )


@query(f"""WITH {S.RUNS}, {S.GOLD}, c AS (SELECT DISTINCT pubkey FROM collection_data WHERE pubkey IS NOT NULL)
    SELECT r.run_id, CAST(count(*) AS BIGINT) AS entries, CAST(count(DISTINCT r.qid) AS BIGINT) AS queries, CAST(count(*) FILTER (c.pubkey IS NULL) AS BIGINT) AS unknown,
    CAST(count(*) FILTER (r.docid = g.gold) AS BIGINT) AS gold_hits, round(count(*) FILTER (c.pubkey IS NOT NULL AND r.docid IS DISTINCT FROM g.gold) / count(*), 6) AS usable
    FROM runs r LEFT JOIN gold g ON r.qid = g.qid LEFT JOIN c ON c.pubkey = r.docid GROUP BY r.run_id""")
def run_alignment(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "collection_data").filter("pubkey IS NOT NULL").select(F.col("pubkey").alias("docid")).distinct().withColumn("known", F.lit(True))
    rows = base.runs(spark, d).join(base.gold(spark, d), "qid", "left").join(keys, "docid", "left")
    known, right = F.col("known").isNotNull(), F.coalesce(F.col("docid") == F.col("gold"), F.lit(False))
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.countDistinct("qid").alias("queries"),
        F.sum((~known).cast("bigint")).alias("unknown"),
        F.sum(right.cast("bigint")).alias("gold_hits"),
        F.round(F.sum((known & ~right).cast("bigint")) / F.count(F.lit(1)), 6).alias("usable"),
    )
