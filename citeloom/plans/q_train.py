"""Queries of training-set construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions import text as T
from citeloom.operators import retrieval as R
from citeloom.operators import training as N
from citeloom.plans import base
from citeloom.plans import sqltext as S
from citeloom.plans.q_search import DENSE, VECS, _dense
from citeloom.plans.registry import query
from citeloom.session import table


def _md5(seed: int, *columns: str) -> str:
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in columns) + "))"


def _hex(x: str, n: int) -> str:
    return f"CAST(('0x' || substr({x}, 1, {n})) AS BIGINT)"


SPLIT = f"{_hex(_md5(42, 'qid'), 13)} / {float(16**13)!r}"


@query(f"WITH {S.TRAIN} SELECT qid, CASE WHEN {SPLIT} < 0.1 THEN 'dev' WHEN {SPLIT} < 0.2 THEN 'test' ELSE 'train' END AS part FROM train")
def split_queries(spark: SparkSession, d: str) -> DataFrame:
    return N.split_queries(base.train(spark, d), (0.1, 0.1))


@query(f"""WITH g AS (SELECT DISTINCT pubkey AS qid FROM en_train WHERE pubkey IS NOT NULL AND text IS NOT NULL)
    SELECT qid AS pubkey, CASE WHEN {SPLIT} < 0.15 THEN 'dev' ELSE 'train' END AS part FROM g""")
def split_groups(spark: SparkSession, d: str) -> DataFrame:
    """All claims of a paper fall into one part."""
    rows = table(spark, d, "en_train").filter("pubkey IS NOT NULL AND text IS NOT NULL")
    return N.split_queries(rows, (0.15, 0.0), key="pubkey")


def _draws(name: str, queries: str, pool: str, n: str, seed: int) -> str:
    """CTE of ``qid, docid, draw``: n documents of a pool for each query, from the place of its hash onwards in seeded order."""
    return f"""{name}_p AS (SELECT docid, row_number() OVER (ORDER BY {_md5(seed, 'docid')}, docid) - 1 AS at, count(*) OVER () AS size FROM {pool}),
    {name}_z AS (SELECT max(size) AS size FROM {name}_p),
    {name}_a AS (SELECT qid, {_hex(_md5(seed, 'qid'), 8)} % size AS start, size, unnest(range(CAST(least(size, {n}) AS BIGINT))) AS draw FROM {queries}, {name}_z),
    {name} AS (SELECT a.qid, p.docid, a.draw FROM {name}_a a JOIN {name}_p p ON p.at = (a.start + a.draw) % a.size)"""


@query(f"""WITH {S.TRAIN}, {S.CORPUS}, docs AS (SELECT pubkey AS docid FROM corpus), asked AS (SELECT DISTINCT qid, gold FROM train), {_draws('drawn', 'asked', 'docs', '16', 42)}
    SELECT * FROM (SELECT qid, docid, CAST(row_number() OVER (PARTITION BY qid ORDER BY draw) AS INTEGER) AS pos FROM drawn JOIN asked USING (qid) WHERE docid IS DISTINCT FROM gold) WHERE pos <= 15""")
def random_negatives(spark: SparkSession, d: str) -> DataFrame:
    docs = base.corpus(spark, d).select(F.col("pubkey").alias("docid"))
    return N.random_negatives(base.train(spark, d), docs, 15)


@query(f"""WITH {S.TRAIN}, v AS (SELECT qid, 'original' AS variant, text FROM train UNION ALL SELECT qid, 'clean', {S.drop_handles('text')} FROM train UNION ALL SELECT qid, 'ws', {S.ws('text')} FROM train)
    SELECT qid, min(CASE variant WHEN 'original' THEN 0 WHEN 'clean' THEN 1 ELSE 2 END) AS variant, text FROM v WHERE text <> '' GROUP BY qid, text""")
def variant_rows(spark: SparkSession, d: str) -> DataFrame:
    """Text variants of each query, a text once (under its first variant)."""
    kinds = F.array(
        *[F.struct(F.lit(i).alias("variant"), c.alias("text")) for i, c in enumerate((F.col("text"), T.clean_drop_handles("text"), T.normalize_ws("text")))]
    )
    rows = base.train(spark, d).select("qid", F.explode(kinds).alias("v")).select("qid", "v.*").filter("text != ''")
    return rows.groupBy("qid", "text").agg(F.min("variant").alias("variant"))


ORDER = ("rerank_hi", "mix_k", "dense_m", "lex_plain")
TIER = "CASE run_id " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(ORDER)) + " END"


@query(f"""WITH {S.RUNS}, {S.GOLD}, c AS (SELECT r.run_id, r.qid, r.docid, r.rank FROM runs r JOIN gold g ON r.qid = g.qid WHERE r.docid IS DISTINCT FROM g.gold AND rank <= 100 AND {TIER} IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY run_id, qid ORDER BY rank) AS n FROM c), t AS (SELECT qid, docid, min({TIER} * 1000 + rank) AS seen FROM k WHERE n <= 8 GROUP BY qid, docid)
    SELECT * FROM (SELECT qid, docid, CAST(floor(seen / 1000) AS INTEGER) AS tier, CAST(row_number() OVER (PARTITION BY qid ORDER BY seen, docid) AS INTEGER) AS pos FROM t) WHERE pos <= 15""")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """At most 8 of each run in run order, 15 in all, gold out."""
    rows = base.runs(spark, d).filter(F.col("run_id").isin(*ORDER)).filter("rank <= 100").join(base.gold(spark, d), "qid")
    rows = rows.filter(~F.col("docid").eqNullSafe(F.col("gold")))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("run_id", "qid").orderBy("rank"))).filter("n <= 8")
    tier = F.array_position(F.array(*map(F.lit, ORDER)), F.col("run_id")) - 1
    return N.tiered_negatives(first.select("qid", "docid", tier.cast("int").alias("tier"), F.col("rank").alias("place")), 15)


def _drawn(seed: int, n: int) -> str:
    """Random papers of each German query under a seed, as ``random_negatives`` draws them."""
    return f"""{_draws(f'x{seed}', 'asked', 'docs', str(n + 1), seed)},
    d{seed} AS (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY draw) AS place FROM x{seed} JOIN asked USING (qid) WHERE docid IS DISTINCT FROM gold)"""


def _in_turn(tiers: int) -> str:
    """Tables s0, s1, ...: what each tier of ``c`` adds to the earlier ones, within its quota."""
    parts = []
    for i in range(tiers):
        known = " UNION ALL ".join(f"SELECT qid, docid FROM s{j}" for j in range(i)) or "SELECT NULL AS qid, NULL AS docid WHERE false"
        parts.append(f"""s{i} AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.qid ORDER BY place) AS n FROM c LEFT JOIN ({known}) b ON b.qid = c.qid AND b.docid = c.docid
        WHERE tier = {i} AND b.qid IS NULL) WHERE n <= {8 if i < len(ORDER) else 15})""")
    return ", ".join(parts) + ", s AS (" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(tiers)) + ")"


@query(f"""WITH {S.RUNS}, {S.GOLD}, {S.CORPUS}, docs AS (SELECT pubkey AS docid FROM corpus), asked AS (SELECT DISTINCT qid, gold FROM gold), {_drawn(42, 15)}, {_drawn(43, 30)},
    c AS (SELECT r.qid, r.docid, {TIER} AS tier, r.rank AS place FROM runs r JOIN gold g ON r.qid = g.qid JOIN corpus p ON p.pubkey = r.docid WHERE r.docid IS DISTINCT FROM g.gold AND rank <= 100 AND {TIER} IS NOT NULL
          UNION ALL SELECT qid, docid, {len(ORDER)}, place FROM d42 WHERE place <= 15 UNION ALL SELECT qid, docid, {len(ORDER) + 1}, place FROM d43 WHERE place <= 30), {_in_turn(len(ORDER) + 2)}
    SELECT * FROM (SELECT qid, docid, CAST(tier AS INTEGER) AS tier, CAST(row_number() OVER (PARTITION BY qid ORDER BY tier, place) AS INTEGER) AS pos FROM s) WHERE pos <= 15""")
def hard_negatives_filled(spark: SparkSession, d: str) -> DataFrame:
    """Runs in order, at most 8 new papers of the first 100 of each; then base negatives, then random ones, up to 15 a query.

    ``hard_negatives`` counts the 8 before known papers are left out and fills nothing.
    """
    gold, docs = base.gold(spark, d), base.corpus(spark, d).select(F.col("pubkey").alias("docid"))
    rows = base.runs(spark, d).filter(F.col("run_id").isin(*ORDER)).filter("rank <= 100").join(gold, "qid").filter(~F.col("docid").eqNullSafe(F.col("gold")))
    tier = F.array_position(F.array(*map(F.lit, ORDER)), F.col("run_id")) - 1
    found = rows.join(docs, "docid", "left_semi").select("qid", "docid", tier.cast("int").alias("tier"), F.col("rank").alias("place"))
    # Of the random papers fewer than 15 can be known, so 30 are enough.
    drawn = [N.random_negatives(gold, docs, n, seed).select("qid", "docid", F.lit(len(ORDER) + i).alias("tier"), F.col("pos").alias("place")) for i, (n, seed) in enumerate(((15, 42), (30, 43)))]
    return N.quota_negatives(found.unionByName(drawn[0]).unionByName(drawn[1]), {i: 8 if i < len(ORDER) else 15 for i in range(len(ORDER) + 2)}, 15)


@query(f"""WITH {S.RUNS}, {S.GOLD}, {S.CORPUS}, f AS (SELECT qid, docid, count(*) AS support, round(sum(1 / (60 + rank)), 9) AS rrf, min(rank) AS best, round(avg(rank), 6) AS mean_rank FROM runs GROUP BY qid, docid),
    x AS (SELECT f.*, lower({S.ws('c.doc_text')}) AS t FROM f JOIN gold g USING (qid) JOIN corpus c ON c.pubkey = f.docid WHERE f.docid IS DISTINCT FROM g.gold),
    y AS (SELECT *, row_number() OVER (PARTITION BY qid, t ORDER BY support DESC, rrf DESC, best, mean_rank, docid) AS k FROM x)
    SELECT * FROM (SELECT qid, docid, CAST(row_number() OVER (PARTITION BY qid ORDER BY support DESC, rrf DESC, best, mean_rank, docid) AS INTEGER) AS pos FROM y WHERE k = 1) WHERE pos <= 15""")
def hard_negatives_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Fused evidence order, a text once per query, gold and unknown papers out."""
    fused = R.reciprocal_rank_fusion(base.runs(spark, d)).drop("rank")
    docs = base.corpus(spark, d).select(F.col("pubkey").alias("docid"), F.md5(F.lower(T.normalize_ws("doc_text"))).alias("t"))
    rows = fused.join(base.gold(spark, d), "qid").filter(~F.col("docid").eqNullSafe(F.col("gold"))).join(docs, "docid")
    order = [F.desc("support"), F.desc("rrf"), "best", "mean_rank", "docid"]
    once = rows.withColumn("k", F.row_number().over(Window.partitionBy("qid", "t").orderBy(*order))).filter("k = 1")
    return once.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter("pos <= 15").select("qid", "docid", "pos")


POOL = f"""{S.RUNS}, {S.GOLD}, pool AS (SELECT r.qid, r.docid, row_number() OVER (PARTITION BY r.qid ORDER BY r.rank) AS rank FROM runs r JOIN gold g ON r.qid = g.qid
    WHERE r.run_id = 'pooled_deep' AND r.docid IS DISTINCT FROM g.gold)"""


def _pool(spark: SparkSession, d: str) -> DataFrame:
    rows = base.runs(spark, d).filter("run_id = 'pooled_deep'").join(base.gold(spark, d), "qid").filter(~F.col("docid").eqNullSafe(F.col("gold")))
    return rows.select("qid", "docid", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).alias("rank"))


GROUPS = f"""{POOL}, n AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM pool), s AS (SELECT *, CASE WHEN n >= 9 THEN 5 ELSE 0 END AS o FROM n WHERE n >= 6),
    groups AS (SELECT qid, docid, CASE WHEN rank > o AND rank <= o + 4 THEN 'hard' WHEN rank > 10 AND rank <= 16 THEN 'soft' END AS kind FROM s)"""


@query(f"WITH {GROUPS} SELECT qid, docid, kind FROM groups WHERE kind IS NOT NULL")
def hard_soft_groups(spark: SparkSession, d: str) -> DataFrame:
    return N.hard_and_soft(_pool(spark, d), 5, 4, 10, 6)


@query(f"""WITH {GROUPS}, p AS (SELECT qid, gold AS docid, 1 AS label FROM gold WHERE gold IS NOT NULL AND qid IN (SELECT qid FROM groups WHERE kind = 'hard')
    UNION ALL SELECT qid, docid, 0 FROM groups WHERE kind = 'hard') SELECT qid, docid, CAST(label AS INTEGER) AS label FROM p""")
def labeled_pairs(spark: SparkSession, d: str) -> DataFrame:
    hard = N.hard_and_soft(_pool(spark, d), 5, 4, 10, 6).filter("kind = 'hard'")
    positives = base.gold(spark, d).filter("gold IS NOT NULL").join(hard.select("qid").distinct(), "qid", "left_semi")
    return positives.select("qid", F.col("gold").alias("docid"), F.lit(1).alias("label")).unionByName(hard.select("qid", "docid", F.lit(0).alias("label")))


@query(f"""WITH a AS (SELECT DISTINCT qid AS id FROM en_train WHERE qid IS NOT NULL), b AS (SELECT DISTINCT qid AS id FROM eval_queries WHERE qid IS NOT NULL),
    s AS (SELECT 'a' AS source, id, (row_number() OVER (ORDER BY id) - 0.5) / (SELECT count(*) FROM a) AS share FROM a
          UNION ALL SELECT 'b', id, (row_number() OVER (ORDER BY id) - 0.5) / (SELECT count(*) FROM b) FROM b),
    p AS (SELECT *, floor((row_number() OVER (ORDER BY share, source, id) - 1) / 128) AS block FROM s)
    SELECT source, id, CAST(block * 128 + row_number() OVER (PARTITION BY block ORDER BY {_md5(42, 'source', 'id')}, source, id) - 1 AS BIGINT) AS place FROM p""")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).filter("qid IS NOT NULL").select("qid").distinct() for t in ("en_train", "eval_queries")]
    return N.interleave(parts[0], parts[1], "qid")


def _mined(found: DataFrame, last: int) -> DataFrame:
    rows = found.withColumn("top", F.max("score").over(Window.partitionBy("qid")))
    kept = rows.filter(f"rank BETWEEN 5 AND {last} AND score <= 0.85 AND score <= top - 0.05")
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).filter("pos <= 8").select("qid", "docid", "score", "pos")


@query(f"""WITH {VECS}, {DENSE}, best AS (SELECT qid, max(score) AS top FROM dense GROUP BY qid)
    SELECT * FROM (SELECT qid, docid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS pos FROM dense JOIN best USING (qid)
                   WHERE rank BETWEEN 5 AND 30 AND score <= 0.85 AND score <= top - 0.05) WHERE pos <= 8""")
def mined_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of rank 5 to 30, below a score bound and a margin under the best."""
    return _mined(_dense(spark, d), 30)


@query(f"""WITH {VECS}, {DENSE.replace('rank <= 30', 'rank <= 50')}, best AS (SELECT qid, max(score) AS top FROM dense GROUP BY qid)
    SELECT * FROM (SELECT qid, docid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INTEGER) AS pos FROM dense JOIN best USING (qid)
                   WHERE rank BETWEEN 5 AND 50 AND score <= 0.85 AND score <= top - 0.05) WHERE pos <= 8""")
def mined_negatives_50(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of rank 5 to 50, below a score bound and a margin under the best; ``mined_negatives`` ends at rank 30."""
    return _mined(_dense(spark, d, 50), 50)


@query("""WITH u AS (SELECT qid, pubkey, text, 0 AS file FROM en_train UNION ALL SELECT qid, pubkey, text, 1 FROM eval_queries)
    SELECT qid, pubkey, text, CAST(file AS INTEGER) AS file FROM (SELECT *, row_number() OVER (PARTITION BY qid, pubkey ORDER BY file, text NULLS FIRST) AS k FROM u) WHERE k = 1""")
def topic_dedup(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select("qid", "pubkey", "text", F.lit(i).alias("file")) for i, t in enumerate(("en_train", "eval_queries"))]
    order = Window.partitionBy("qid", "pubkey").orderBy("file", F.col("text").asc_nulls_first())
    return parts[0].unionByName(parts[1]).withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


@query(f"""WITH {GROUPS}, h AS (SELECT qid, docid FROM groups WHERE kind = 'hard'), hn AS (SELECT qid, count(*) AS n FROM h GROUP BY qid),
    short AS (SELECT g.qid, g.gold, coalesce(hn.n, 0) AS n FROM gold g LEFT JOIN hn USING (qid) WHERE coalesce(hn.n, 0) < 6), src AS (SELECT DISTINCT gold AS docid FROM gold WHERE gold IS NOT NULL),
    {_draws('drawn', 'short', 'src', '7', 7)},
    c AS (SELECT s.qid, d.docid, s.n, row_number() OVER (PARTITION BY s.qid ORDER BY d.draw) AS k FROM short s JOIN drawn d USING (qid)
          WHERE d.docid IS DISTINCT FROM s.gold AND (s.qid, d.docid) NOT IN (SELECT (qid, docid) FROM h))
    SELECT qid, docid, CAST(n + k AS BIGINT) AS pos FROM c WHERE n + k <= 6""")
def pad_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Lists of fewer than six filled from the positives of all other queries; of seven drawn at most those in the list and the own one drop out."""
    hard = N.hard_and_soft(_pool(spark, d), 5, 4, 10, 6).filter("kind = 'hard'").select("qid", "docid")
    counts = hard.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    source = base.gold(spark, d).filter("gold IS NOT NULL").select(F.col("gold").alias("docid")).distinct()
    short = base.gold(spark, d).join(counts, "qid", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < 6")
    pairs = N.drawn(short, source, F.lit(7), 7).join(short, "qid").filter(~F.col("docid").eqNullSafe(F.col("gold"))).join(hard, ["qid", "docid"], "left_anti")
    k = F.row_number().over(Window.partitionBy("qid").orderBy("draw"))
    return pairs.withColumn("pos", F.col("n") + k).filter("pos <= 6").select("qid", "docid", "pos")


@query(f"""WITH {GROUPS}, p AS (SELECT (SELECT count(*) FROM groups WHERE kind IN ('hard', 'soft')) + (SELECT count(*) FROM groups WHERE kind = 'hard') AS neg,
        (SELECT count(DISTINCT qid) FROM groups WHERE kind = 'hard') AS pos)
    SELECT CAST(neg AS BIGINT) AS neg, CAST(pos AS BIGINT) AS pos, round(neg / pos, 6) AS weight FROM p""")
def pos_weight(spark: SparkSession, d: str) -> DataFrame:
    """Class weight with hard negatives repeated twice."""
    rows = N.hard_and_soft(_pool(spark, d), 5, 4, 10, 6)
    twice = rows.select("qid", "kind", F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == "hard", 2).otherwise(1))).alias("one"))
    sums = twice.agg(F.count(F.lit(1)).alias("neg"), F.countDistinct(F.when(F.col("kind") == "hard", F.col("qid"))).alias("pos"))
    return sums.withColumn("weight", F.round(F.col("neg") / F.col("pos"), 6))


@query(f"""WITH {S.RUNS}, {S.GOLD}, s AS (SELECT r.qid, r.score, CAST(coalesce(r.docid = g.gold, false) AS INTEGER) AS label FROM runs r JOIN gold g ON r.qid = g.qid WHERE run_id = 'dense_m'),
    j AS (SELECT p.qid, greatest(0, 1 - (p.score - n.score)) AS l FROM s p JOIN s n ON p.qid = n.qid AND p.label = 1 AND n.label = 0)
    SELECT qid, CAST(count(*) AS BIGINT) AS pairs, round(avg(l), 6) AS loss FROM j GROUP BY qid""")
def pairwise_margin(spark: SparkSession, d: str) -> DataFrame:
    rows = base.runs(spark, d).filter("run_id = 'dense_m'").join(base.gold(spark, d), "qid")
    return N.margin_loss(rows.select("qid", "score", F.coalesce(F.col("docid") == F.col("gold"), F.lit(False)).cast("int").alias("label")))


@query(f"""WITH {S.RUNS}, {S.GOLD}, s AS (SELECT r.run_id, r.qid, r.score, CAST(coalesce(r.docid = g.gold, false) AS INTEGER) AS label FROM runs r JOIN gold g ON r.qid = g.qid),
    j AS (SELECT p.run_id, p.qid, greatest(0, 1 - (p.score - n.score)) AS l FROM s p JOIN s n ON p.run_id = n.run_id AND p.qid = n.qid AND p.label = 1 AND n.label = 0)
    SELECT run_id, qid, CAST(count(*) AS BIGINT) AS pairs, round(avg(l), 6) AS loss FROM j GROUP BY run_id, qid""")
def pairwise_margin_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run and query; ``pairwise_margin`` has one run."""
    rows = base.runs(spark, d).join(base.gold(spark, d), "qid")
    label = F.coalesce(F.col("docid") == F.col("gold"), F.lit(False)).cast("int")
    return N.margin_loss(rows.select("run_id", "qid", "score", label.alias("label")), keys=("run_id", "qid"))


@query(f"""WITH {S.RUNS}, {S.GOLD}, s AS (SELECT r.qid, count(*) AS docs, count(*) FILTER (r.docid = g.gold) AS positives FROM runs r JOIN gold g ON r.qid = g.qid WHERE run_id = 'lex_plain' GROUP BY r.qid)
    SELECT qid, CAST(docs AS BIGINT) AS docs, CAST(positives AS BIGINT) AS positives FROM s WHERE positives >= 1 AND docs >= 2""")
def eval_samples(spark: SparkSession, d: str) -> DataFrame:
    """Groups with a positive and at least two documents."""
    rows = base.runs(spark, d).filter("run_id = 'lex_plain'").join(base.gold(spark, d), "qid")
    right = F.coalesce(F.col("docid") == F.col("gold"), F.lit(False)).cast("bigint")
    return rows.groupBy("qid").agg(F.count(F.lit(1)).alias("docs"), F.sum(right).alias("positives")).filter("positives >= 1 AND docs >= 2")


@query(f"""WITH {S.RUNS}, {S.GOLD}, s AS (SELECT r.run_id, r.qid, count(*) AS docs, count(*) FILTER (r.docid = g.gold) AS positives FROM runs r JOIN gold g ON r.qid = g.qid GROUP BY r.run_id, r.qid)
    SELECT run_id, qid, CAST(docs AS BIGINT) AS docs, CAST(positives AS BIGINT) AS positives FROM s WHERE positives >= 1 AND docs >= 2""")
def eval_samples_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run and query; ``eval_samples`` has one run."""
    right = F.coalesce(F.col("docid") == F.col("gold"), F.lit(False)).cast("bigint")
    rows = base.runs(spark, d).join(base.gold(spark, d), "qid").groupBy("run_id", "qid")
    return rows.agg(F.count(F.lit(1)).alias("docs"), F.sum(right).alias("positives")).filter("positives >= 1 AND docs >= 2")


@query(f"""WITH {GROUPS}, a AS (SELECT qid, min(docid) FILTER (kind = 'soft') AS neg, min(docid) FILTER (kind = 'hard') AS hard_neg FROM groups WHERE kind IS NOT NULL GROUP BY qid)
    SELECT qid, docid FROM (SELECT qid, unnest(list_distinct(list_filter([neg, hard_neg], lambda x: x IS NOT NULL))) AS docid FROM a)""")
def merge_negative_fields(spark: SparkSession, d: str) -> DataFrame:
    """Two optional fields as one list, exploded."""
    rows = N.hard_and_soft(_pool(spark, d), 5, 4, 10, 6).groupBy("qid").agg(
        F.min(F.when(F.col("kind") == "soft", F.col("docid"))).alias("neg"), F.min(F.when(F.col("kind") == "hard", F.col("docid"))).alias("hard_neg")
    )
    return rows.select("qid", F.explode(F.array_distinct(F.array_compact(F.array("neg", "hard_neg")))).alias("docid"))


@query(f"WITH {GROUPS} SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT qid) AS BIGINT) AS queries, round(count(*) / count(DISTINCT qid), 6) AS per_query FROM groups WHERE kind IS NOT NULL GROUP BY kind")
def composition_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = N.hard_and_soft(_pool(spark, d), 5, 4, 10, 6)
    n, q = F.count(F.lit(1)), F.countDistinct("qid")
    return rows.groupBy("kind").agg(n.alias("n"), q.alias("queries"), F.round(n / q, 6).alias("per_query"))


@query(f"""WITH {GROUPS}, b AS (SELECT g.qid, count(*) FILTER (kind = 'hard') AS hard, count(*) FILTER (kind = 'soft') AS soft FROM gold g LEFT JOIN groups USING (qid) GROUP BY g.qid)
    SELECT CAST(count(*) AS BIGINT) AS queries, round(count(*) FILTER (hard = 4) / count(*), 6) AS full_share, round(count(*) FILTER (hard = 0) / count(*), 6) AS empty_share, round(avg(hard + soft), 6) AS mean_negatives,
    CAST(0 AS BIGINT) AS excess_fallback FROM b""")
def build_quality(spark: SparkSession, d: str) -> DataFrame:
    """Shares that the quality gates look at; excess fallback is 0 by construction."""
    rows = N.hard_and_soft(_pool(spark, d), 5, 4, 10, 6).groupBy("qid").agg(
        F.sum((F.col("kind") == "hard").cast("int")).alias("hard"), F.sum((F.col("kind") == "soft").cast("int")).alias("soft")
    )
    every = base.gold(spark, d).select("qid").join(rows, "qid", "left").na.fill(0, ["hard", "soft"])
    share = lambda c: F.round(F.sum(c.cast("int")) / F.count(F.lit(1)), 6)
    return every.agg(
        F.count(F.lit(1)).alias("queries"), share(F.col("hard") == 4).alias("full_share"), share(F.col("hard") == 0).alias("empty_share"),
        F.round(F.avg(F.col("hard") + F.col("soft")), 6).alias("mean_negatives"), F.lit(0).cast("bigint").alias("excess_fallback"),
    )


@query(f"""WITH {GROUPS} SELECT g.qid, count(*) = count(DISTINCT g.docid) AS all_distinct, bool_and(g.docid IS DISTINCT FROM p.gold) AS disjoint, CAST(count(*) AS BIGINT) AS n
    FROM groups g JOIN gold p USING (qid) WHERE kind IS NOT NULL GROUP BY g.qid""")
def validate_training_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = N.hard_and_soft(_pool(spark, d), 5, 4, 10, 6).join(base.gold(spark, d), "qid")
    return rows.groupBy("qid").agg(
        (F.count(F.lit(1)) == F.countDistinct("docid")).alias("all_distinct"), F.bool_and(~F.col("docid").eqNullSafe(F.col("gold"))).alias("disjoint"), F.count(F.lit(1)).alias("n")
    )
