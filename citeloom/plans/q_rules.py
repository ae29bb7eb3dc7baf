"""Queries of rules on names, shapes, duplicates, splits and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions import text as T
from citeloom.operators import evaluation as E
from citeloom.operators import retrieval as R
from citeloom.operators import training as N
from citeloom.plans import base
from citeloom.plans import sqltext as S
from citeloom.plans.q_eval import AP, GAIN, HIT, JUDGED, MRR, _judged
from citeloom.plans.q_search import BM25, DENSE, VECS, _dense, _docs, _index, _run, bm25_run
from citeloom.plans.q_train import GROUPS, _hex, _md5, _pool
from citeloom.plans.registry import query
from citeloom.session import materialise, table
from citeloom.sources import reports as RP
from citeloom.sources import runs as IO

# Names of files.

#: Parts of file names that are replaced in the compact name, in order.
COMPACT = (
    ("reranked_results_", ""), ("res_rer_", "rer_"), ("res_", ""), ("FTAarsen20252026_Lora_", "lora_"), ("FTAarsen2526_Lora_", "lora_"),
    ("BASELINE", "baseline"), ("onbiEncoder", "on_biencoder"),
)
#: Names of run files over the systems of the runs: folder, before the system, behind it.
FOLDERS = (("runs/dev", "res_", "_deDev"), ("runs/test", "reranked_results_", "_frFinal"), ("runs/train", "res_rer_BGE_M3_hybrid_", ""), ("runs/dev", "BASELINE_dev_", ""), ("runs/other", "x ", "!"), ("runs/x", "res_", "_enfinal"))


def run_context(path: str | Column) -> tuple[Column, Column, Column]:
    """(split, language, compact name) that the path of a run file tells; null where it doesn't."""
    p = F.col(path) if isinstance(path, str) else path
    name = F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", "")
    stem, parts = F.lower(name), F.split(F.lower(p), "/")
    has = lambda x: stem.contains(x)
    inside = lambda x: F.array_contains(parts, x)
    split = F.when(inside("train") | has("train"), "train").when(inside("dev") | has("dev"), "dev").when(inside("test") | has("final"), "test")
    lang = (
        F.when(has("dedev") | has("definal"), "de")
        .when(has("frdev") | has("frfinal"), "fr")
        .when(has("endev") | has("enfinal"), "en")
        .when((split == "dev") & has("baseline_dev"), "en")
        .when((split == "train") & has("bge_m3_hybrid"), "en")
    )
    compact = name
    for old, new in COMPACT:
        compact = F.replace(compact, F.lit(old), F.lit(new))
    return split, lang, F.regexp_replace(F.regexp_replace(compact, r"[^A-Za-z0-9_.\-]+", "_"), "^_+|_+$", "")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    names = F.explode(F.array(*[F.concat(F.lit(f"{a}/{b}"), F.col("run_id"), F.lit(f"{c}.json")) for a, b, c in FOLDERS])).alias("path")
    split, lang, compact = run_context("path")
    return table(spark, d, "run_entry").filter("run_id IS NOT NULL").select("run_id").distinct().select("run_id", names).select("path", split.alias("split"), lang.alias("lang"), compact.alias("system"))


def _compact_sql(x: str) -> str:
    for old, new in COMPACT:
        x = f"replace({x}, '{old}', '{new}')"
    return rf"regexp_replace(regexp_replace({x}, '[^A-Za-z0-9_.\-]+', '_', 'g'), '^_+|_+$', '', 'g')"


PATHS = f"""files AS (SELECT f || r.run_id || e AS path FROM (SELECT DISTINCT run_id FROM run_entry WHERE run_id IS NOT NULL) r,
        (VALUES {", ".join(f"('{a}/{b}', '{c}.json')" for a, b, c in FOLDERS)}) AS v(f, e)),
    named AS (SELECT path, regexp_extract(path, '([^/]*)[.]json$', 1) AS name, lower(regexp_extract(path, '([^/]*)[.]json$', 1)) AS stem, string_split(lower(path), '/') AS parts FROM files),
    cut AS (SELECT *, CASE WHEN list_contains(parts, 'train') OR contains(stem, 'train') THEN 'train' WHEN list_contains(parts, 'dev') OR contains(stem, 'dev') THEN 'dev'
            WHEN list_contains(parts, 'test') OR contains(stem, 'final') THEN 'test' END AS split FROM named),
    contexts AS (SELECT path, split, CASE WHEN regexp_matches(stem, 'dedev|definal') THEN 'de' WHEN regexp_matches(stem, 'frdev|frfinal') THEN 'fr' WHEN regexp_matches(stem, 'endev|enfinal') THEN 'en'
            WHEN split = 'dev' AND contains(stem, 'baseline_dev') THEN 'en' WHEN split = 'train' AND contains(stem, 'bge_m3_hybrid') THEN 'en' END AS lang, {_compact_sql('name')} AS system FROM cut)"""


@query(f"WITH {PATHS} SELECT path, split, lang, system FROM contexts")
def run_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Split, language and compact system name of run files."""
    return _paths(spark, d)


@query(f"""WITH {PATHS}, q AS (SELECT * FROM (VALUES ('dev', 'de'), ('test', 'fr'), (NULL, 'en'), ('train', NULL), (NULL, NULL)) AS t(query_split, query_lang))
    SELECT query_split, query_lang, path FROM q, contexts WHERE (query_split IS NULL OR split IS NULL OR query_split = split) AND (query_lang IS NULL OR lang IS NULL OR query_lang = lang)""")
def context_compatible(spark: SparkSession, d: str) -> DataFrame:
    """Run files that fit a set of queries; what isn't known fits everything."""
    asked = spark.createDataFrame([("dev", "de"), ("test", "fr"), (None, "en"), ("train", None), (None, None)], "query_split string, query_lang string")
    fits = lambda a, b: F.col(a).isNull() | F.col(b).isNull() | (F.col(a) == F.col(b))
    return _paths(spark, d).join(F.broadcast(asked), fits("query_split", "split") & fits("query_lang", "lang")).select("query_split", "query_lang", "path")


@query(f"WITH {PATHS} SELECT system, path FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY path) AS k FROM contexts) WHERE k = 1")
def first_of_name(spark: SparkSession, d: str) -> DataFrame:
    """Of several files with one compact name the first by path."""
    order = Window.partitionBy("system").orderBy("path")
    return _paths(spark, d).withColumn("k", F.row_number().over(order)).filter("k = 1").select("system", "path")


@query("SELECT DISTINCT run_id, true AS lists, false AS scores, false AS empty FROM run_entry WHERE qid IS NOT NULL AND docid IS NOT NULL")
def ranking_payload(spark: SparkSession, d: str) -> DataFrame:
    """Whether JSON texts have the shape of rankings: maps of lists do, maps of scores and empty maps don't."""
    rows = table(spark, d, "run_entry").filter("qid IS NOT NULL AND docid IS NOT NULL").groupBy("run_id", "qid").agg(F.min("docid").alias("docid"))
    entry = lambda v: F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("qid").cast("string"), v))))
    made = rows.groupBy("run_id").agg(entry(F.array("docid")).alias("a"), entry(F.lit(0.5)).alias("b"))
    return made.select("run_id", IO.is_ranking_payload(F.col("a")).alias("lists"), IO.is_ranking_payload(F.col("b")).alias("scores"), IO.is_ranking_payload(F.lit("{}")).alias("empty"))


# Texts.


@query(f"""SELECT DISTINCT qid, (SELECT string_agg(t, ' ' ORDER BY p) FROM (SELECT t, min(p) AS p FROM (SELECT unnest({S.tok_sparse('text')}) AS t, generate_subscripts({S.tok_sparse('text')}, 1) AS p) GROUP BY t)) AS terms
    FROM (SELECT DISTINCT qid, text FROM en_train WHERE text IS NOT NULL)""")
def ordered_terms(spark: SparkSession, d: str) -> DataFrame:
    """Distinct terms in the order of their first occurrence."""
    rows = table(spark, d, "en_train").filter("text IS NOT NULL").select("qid", "text").distinct()
    terms = F.array_distinct(T.tokenize_sparse("text"))
    return rows.select("qid", F.when(F.size(terms) > 0, F.array_join(terms, " ")).alias("terms")).distinct()


@query("""WITH r AS (SELECT DISTINCT qid, text, text_original FROM final_de_tradottoen_test WHERE qid IS NOT NULL), f AS (SELECT qid, CASE WHEN qid % 4 = 0 THEN text WHEN qid % 4 = 1 THEN ' ' END AS expanded, CASE WHEN qid % 4 = 1 THEN text_original END AS original,
        CASE WHEN qid % 4 = 2 THEN text END AS text, CASE WHEN qid % 4 >= 2 THEN text_original END AS query FROM r),
    c AS (SELECT qid, coalesce(nullif(trim(expanded, ' '), ''), nullif(trim(original, ' '), ''), nullif(trim(text, ' '), ''), nullif(trim(query, ' '), '')) AS t FROM f)
    SELECT qid % 4 AS kind, CAST(count(t) AS BIGINT) AS taken, CAST(count(*) - count(t) AS BIGINT) AS skipped, min(md5(t)) AS first_key, max(md5(t)) AS last_key FROM c GROUP BY kind""")
def query_text_chain(spark: SparkSession, d: str) -> DataFrame:
    """The first text of four fields that isn't blank, and how many queries have none."""
    rows = table(spark, d, "final_de_tradottoen_test").filter("qid IS NOT NULL").select("qid", "text", "text_original").distinct()
    k = F.col("qid") % 4
    fields = {"expanded": F.when(k == 0, F.col("text")).when(k == 1, " "), "original": F.when(k == 1, F.col("text_original")), "text": F.when(k == 2, F.col("text")), "query": F.when(k >= 2, F.col("text_original"))}
    found = rows.select(k.alias("kind"), *[v.alias(n) for n, v in fields.items()]).select("kind", IO.first_text(*fields).alias("t"))
    taken = F.count("t")
    return found.groupBy("kind").agg(taken.alias("taken"), (F.count(F.lit(1)) - taken).alias("skipped"), F.min(F.md5("t")).alias("first_key"), F.max(F.md5("t")).alias("last_key"))


@query(f"""SELECT pubkey, doc_text FROM (SELECT pubkey, doc_text, row_number() OVER (PARTITION BY pubkey ORDER BY n) AS k FROM (SELECT *, {S.doc_text()} AS doc_text FROM (SELECT *, row_number() OVER () AS n FROM collection_data))
    WHERE pubkey IS NOT NULL AND trim(pubkey, ' ') <> '' AND doc_text <> '') WHERE k = 1""")
def corpus_first(spark: SparkSession, d: str) -> DataFrame:
    """Of a repeated key the first record with text in the order of the input (file, then row)."""
    rows = table(spark, d, "collection_data").select("pubkey", T.doc_text().alias("doc_text"), "_metadata.file_path", "_metadata.row_index")
    rows = rows.filter(F.col("pubkey").isNotNull() & (F.trim("pubkey") != "") & (F.col("doc_text") != ""))
    first = rows.groupBy("pubkey").agg(F.min_by("doc_text", F.struct("file_path", "row_index")).alias("doc_text"))
    return first.select("pubkey", "doc_text")


#: Example tables of a caller: names of emoji, and slang.
EMOJI = {"\U0001f9ec": "dna", "\U0001f637": "mask", "\U0001f914": "thinking"}
SLANG = {"imo": "in my opinion", "btw": "by the way", "ppl": "people", "b4": "before", "thx": "thanks"}


def _social_sql(x: str) -> str:
    for sign, name in EMOJI.items():
        x = f"replace({x}, '{sign}', ' {name} ')"
    tokens = S.every(x, T.SOCIAL_TOKEN)
    parts = S.every("t", T.TAG_PART)
    split = f"flatten(list_transform({tokens}, lambda t: CASE WHEN starts_with(t, '#') THEN list_transform({parts}, lambda p: lower(p)) ELSE [t] END))"
    named = "CASE lower(t) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SLANG.items()) + " ELSE t END"
    return f"list_filter(list_transform({split}, lambda t: {named}), lambda t: length(t) > 1 AND NOT list_contains({S.STOP}, lower(t)))"


@query(f"SELECT DISTINCT qid, {S.joined(_social_sql('text'))} AS terms FROM en_train WHERE text IS NOT NULL")
def social_terms(spark: SparkSession, d: str) -> DataFrame:
    """Posts as terms: emoji named, hashtags split, slang written out."""
    rows = table(spark, d, "en_train").filter("text IS NOT NULL")
    return rows.select("qid", F.array_join(T.social_terms("text", EMOJI, SLANG), " ").alias("terms")).distinct()


# Evaluation of lists with repeated documents.

_LISTED = f"""{S.GOLD}, listed AS (SELECT run_id, qid, docid, row_number() OVER (PARTITION BY run_id, qid ORDER BY score DESC, docid) AS rank FROM run_entry WHERE score IS NOT NULL AND NOT isnan(score)),
    hits AS (SELECT l.run_id, l.qid, l.rank, row_number() OVER (PARTITION BY l.run_id, l.qid ORDER BY l.rank) AS k FROM listed l JOIN gold g ON l.qid = g.qid AND l.docid = g.gold)"""


@query(f"""WITH {_LISTED}, m AS (SELECT run_id, qid, sum(CAST(rank <= 10 AS INTEGER)) / 10 AS p, sum(k / rank) AS ap, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS ndcg, min(rank) AS first_rank, count(*) AS times FROM hits GROUP BY run_id, qid)
    SELECT run_id, qid, CAST(times AS BIGINT) AS times, CAST(first_rank AS INTEGER) AS first_rank, round(p, 6) AS precision_10, round(ap, 6) AS ap, round(ndcg, 6) AS ndcg_10 FROM m""")
def listed_twice(spark: SparkSession, d: str) -> DataFrame:
    """Measures over lists as they come: a gold paper listed twice counts twice."""
    rows = table(spark, d, "run_entry").filter("score IS NOT NULL AND NOT isnan(score)")
    order = Window.partitionBy("run_id", "qid").orderBy(F.desc("score"), "docid")
    measures = E.repeated_hits(rows.withColumn("rank", F.row_number().over(order)), base.gold(spark, d))
    return measures.select("run_id", "qid", "times", "first_rank", *[F.round(c, 6).alias(c) for c in ("precision_10", "ap", "ndcg_10")])


# Training sets.


@query(f"""WITH {S.TRAIN}, o AS (SELECT qid, row_number() OVER (ORDER BY {_md5(42, 'qid')}, qid) - 1 AS k, count(*) OVER () AS n FROM train)
    SELECT qid, CASE WHEN k < CAST(floor(n * 0.8) AS BIGINT) THEN 'train' WHEN k < CAST(floor(n * 0.8) AS BIGINT) + CAST(floor(n * 0.1) AS BIGINT) THEN 'dev' ELSE 'test' END AS part FROM o""")
def split_exact(spark: SparkSession, d: str) -> DataFrame:
    """Parts of exactly int(n * share) queries in seeded order, the rest in the last."""
    return N.split_exact(base.train(spark, d).select("qid"), "qid", {"train": 0.8, "dev": 0.1}, "test")


@query(f"""WITH g AS (SELECT DISTINCT pubkey FROM en_train WHERE pubkey IS NOT NULL AND text IS NOT NULL),
    o AS (SELECT pubkey, row_number() OVER (ORDER BY {_md5(42, 'pubkey')}, pubkey) - 1 AS k, count(*) OVER () AS n FROM g)
    SELECT pubkey, CASE WHEN k < greatest(10, CAST(floor(n * 0.15) AS BIGINT)) THEN 'dev' ELSE 'train' END AS part FROM o""")
def split_groups_exact(spark: SparkSession, d: str) -> DataFrame:
    """All claims of a paper in one part; at least ten papers are held out."""
    rows = table(spark, d, "en_train").filter("pubkey IS NOT NULL AND text IS NOT NULL").select("pubkey").distinct()
    return N.split_exact(rows, "pubkey", {"dev": 0.15}, "train", least=10)


@query(f"""WITH {GROUPS}, a AS (SELECT qid, docid, CASE WHEN kind = 'soft' THEN 0 ELSE 1 END AS field, rank FROM groups JOIN pool USING (qid, docid) WHERE kind IS NOT NULL),
    o AS (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY field, rank) AS pos FROM a)
    SELECT o.qid, o.docid, CAST(o.pos AS INTEGER) AS pos FROM o JOIN gold g USING (qid) WHERE g.gold IS NOT NULL AND pos <= 8""")
def merged_negative_lists(spark: SparkSession, d: str) -> DataFrame:
    """``neg`` and ``hard_neg`` lists of training rows as one, the first eight; rows without a positive are left out."""
    kinds = N.hard_and_soft(_pool(spark, d), 5, 4, 10, 6).join(_pool(spark, d), ["qid", "docid"])
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", "docid")))), lambda x: x["docid"])
    rows = kinds.groupBy("qid").agg(listed("soft").alias("neg"), listed("hard").alias("hard_neg")).join(base.gold(spark, d).filter("gold IS NOT NULL"), "qid")
    merged = N.merged_negatives(F.lit(None).cast("array<string>"), F.col("neg"), F.col("hard_neg"))
    return rows.select("qid", F.posexplode(F.slice(merged, 1, 8)).alias("pos", "docid")).withColumn("pos", F.col("pos") + 1)


#: Gates of a training-set build: measure, comparison, bound.
GATES = (("full_share", ">=", 0.5), ("empty_share", "<=", 0.2), ("mean_negatives", ">=", 4.0))


@query(f"""WITH {GROUPS}, b AS (SELECT g.qid, count(*) FILTER (kind = 'hard') AS hard, count(*) FILTER (kind = 'soft') AS soft FROM gold g LEFT JOIN groups USING (qid) GROUP BY g.qid),
    m AS (SELECT round(count(*) FILTER (hard = 4) / count(*), 6) AS full_share, round(count(*) FILTER (hard = 0) / count(*), 6) AS empty_share, round(avg(hard + soft), 6) AS mean_negatives FROM b)
    """ + " UNION ALL ".join(f"SELECT '{m}' AS measure, CAST({m} AS DOUBLE) AS value, CAST({b} AS DOUBLE) AS bound, {m} {o} {b} AS passed FROM m" for m, o, b in GATES))
def build_gates(spark: SparkSession, d: str) -> DataFrame:
    """Each measure of a training-set build with its bound and whether it holds."""
    from citeloom.plans.q_train import build_quality

    entries = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"), F.lit(b).alias("bound"), F.expr(f"{m} {o} {b}").alias("passed")) for m, o, b in GATES]
    return build_quality(spark, d).select(F.explode(F.array(*entries)).alias("g")).select("g.*")


# Learning to rank over lexical candidates with gold papers.

_SHARE = f"len(list_intersect(list_distinct({S.tok_sparse('t.text')}), {S.tok_sparse('{0}')})) / greatest(1, len(list_distinct({S.tok_sparse('t.text')})))"
CANDIDATES = f"""{BM25}, cand AS (SELECT b.qid, b.docid, b.score AS bm25, round({_SHARE.format("coalesce(c.title, '')")}, 6) AS title_share, round({_SHARE.format('c.doc_text')}, 6) AS text_share,
        CAST(coalesce(b.docid = t.gold, false) AS INTEGER) AS label FROM bm b JOIN topics t USING (qid) JOIN corpus c ON c.pubkey = b.docid WHERE b.rank <= 64),
    sets AS (SELECT * FROM cand WHERE qid IN (SELECT qid FROM cand GROUP BY qid HAVING max(label) = 1 AND min(label) = 0))"""


def _scaled_sql(s: str) -> str:
    low, high = f"min({s}) OVER (PARTITION BY qid)", f"max({s}) OVER (PARTITION BY qid)"
    return f"round(CASE WHEN {high} - {low} > 1e-12 THEN ({s} - {low}) / ({high} - {low}) ELSE 0 END, 6) AS {s}_scaled"


@query(f"""WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, docid) - 1 AS r, count(*) OVER (PARTITION BY qid) AS n FROM sets)
    SELECT qid, docid, bm25, title_share, text_share, label, {", ".join(map(_scaled_sql, ("bm25", "title_share", "text_share")))}, round(CASE WHEN n > 1 THEN 1 - r / (n - 1) ELSE 1 END, 6) AS rank_fraction,
    round(1 / (r + 1), 6) AS rank_inverse, round(1 / log2(r + 2), 6) AS rank_log FROM r""")
def ltr_gold_set(spark: SparkSession, d: str) -> DataFrame:
    """Features of the first 64 candidates of each query, labelled by the gold paper; queries without a positive or a negative are skipped."""
    topics = base.topics(spark, d).select("qid", "gold", F.array_distinct(T.tokenize_sparse("text")).alias("asked"))
    papers = materialise(_docs(spark, d).select("docid", F.array_distinct(T.tokenize_sparse(F.coalesce("title", F.lit("")))).alias("own"), F.array_distinct(T.tokenize_sparse("doc_text")).alias("whole")), "terms")
    share = lambda c: F.round(F.size(F.array_intersect("asked", c)) / F.greatest(F.lit(1), F.size("asked")), 6)
    rows = _run(spark, d, 64).select("qid", "docid", F.col("score").alias("bm25")).join(topics, "qid").join(papers, "docid")
    rows = rows.select("qid", "docid", "bm25", share("own").alias("title_share"), share("whole").alias("text_share"), F.coalesce(F.col("docid") == F.col("gold"), F.lit(False)).cast("int").alias("label"))
    every = Window.partitionBy("qid")
    sets = rows.withColumns({"__hi": F.max("label").over(every), "__lo": F.min("label").over(every)}).filter("__hi = 1 AND __lo = 0").drop("__hi", "__lo")
    made = R.ltr_features(sets, ("bm25", "title_share", "text_share"))
    return made.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in made.dtypes])


@query()
def ltr_gold_model(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees trained on half of the queries (by hash) and applied to the other half: mean reciprocal rank of the gold paper before and after."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = materialise(ltr_gold_set(spark, d), "ltr")
    names = [c for c in rows.columns if c not in ("qid", "docid", "label")]
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows).withColumn("held", F.pmod(F.xxhash64("qid"), F.lit(2)) == 1)
    train = ready.filter("NOT held")
    if train.isEmpty():
        return spark.createDataFrame([], "queries long, mrr_before double, mrr_after double")
    model = GBTRegressor(labelCol="label", maxIter=20, maxDepth=4, stepSize=0.1, seed=1).fit(train)
    scored = model.transform(ready.filter("held")).select("qid", "docid", "label", "bm25", "prediction")
    place = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), F.desc("bm25"), "docid"))
    ranked = scored.withColumns({"before": place("bm25"), "after": place("prediction")}).filter("label = 1")
    return ranked.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(1 / F.col("before")), 6).alias("mrr_before"), F.round(F.avg(1 / F.col("after")), 6).alias("mrr_after"))


# Score heads.


@query(f"WITH {BM25}, z AS (SELECT qid, docid, score - 5 AS yes, 5 - score AS no FROM bm) SELECT qid, docid, round(exp(yes) / (exp(yes) + exp(no)), 6) AS p_yes, round(yes - ln(exp(yes) + exp(no)), 6) AS log_yes FROM z")
def yes_no_head(spark: SparkSession, d: str) -> DataFrame:
    """Probability of "yes" against "no" from their logits, by log-softmax."""
    rows = bm25_run(spark, d).select("qid", "docid", (F.col("score") - 5).alias("yes"), (5 - F.col("score")).alias("no"))
    log_yes = R.log_softmax("yes", "no")
    return rows.select("qid", "docid", F.round(F.exp(log_yes), 6).alias("p_yes"), F.round(log_yes, 6).alias("log_yes"))


@query(f"""WITH {S.RUNS}, {S.GOLD}, s AS (SELECT r.run_id, r.score, CAST(coalesce(r.docid = g.gold, false) AS INTEGER) AS label FROM runs r JOIN gold g ON r.qid = g.qid)
    SELECT run_id, round(avg(greatest(score, 0) - score * label + ln(1 + exp(-abs(score)))), 6) AS loss FROM s GROUP BY run_id""")
def logistic_loss(spark: SparkSession, d: str) -> DataFrame:
    """Binary cross entropy of scores as logits: the loss where a query has no pair of a positive and a negative."""
    rows = base.runs(spark, d).join(base.gold(spark, d), "qid")
    label = F.coalesce(F.col("docid") == F.col("gold"), F.lit(False)).cast("int")
    return rows.select("run_id", N.logistic_loss(F.col("score"), label).alias("l")).groupBy("run_id").agg(F.round(F.avg("l"), 6).alias("loss"))


# Run maps, filters, expansions.


@query(f"""WITH {S.RUNS}, m AS (SELECT *, CASE WHEN qid % 2 = 0 THEN 1000 - rank END AS given, CASE WHEN qid % 2 = 0 AND rank % 5 = 0 THEN NULL ELSE 1 END AS has FROM runs WHERE rank <= 50),
    g AS (SELECT *, CASE WHEN has = 1 THEN given END AS place FROM m)
    SELECT run_id, qid, docid, CAST(row_number() OVER (PARTITION BY run_id, qid ORDER BY place ASC NULLS LAST, score DESC, docid) AS INTEGER) AS rank FROM g""")
def run_from_rank_map(spark: SparkSession, d: str) -> DataFrame:
    """Maps of document to score and, for every other query, an explicit rank: where there is any, ranks decide and documents without come last."""
    rows = base.runs(spark, d).filter("rank <= 50")
    given = F.when((F.col("qid") % 2 == 0) & (F.col("rank") % 5 != 0), 1000 - F.col("rank"))
    maps = rows.groupBy("run_id", "qid").agg(F.map_from_entries(F.collect_list(F.struct("docid", F.struct("score", given.alias("rank"))))).alias("entries"))
    return IO.rank_entry_maps(maps).select("run_id", "qid", "docid", "rank")


@query(f"""WITH {BM25} SELECT b.qid, b.docid, CAST(row_number() OVER (PARTITION BY b.qid ORDER BY b.score DESC, b.docid) AS INTEGER) AS rank FROM bm_s b JOIN topics t USING (qid) JOIN corpus g ON g.pubkey = t.gold
    JOIN corpus c ON c.pubkey = b.docid WHERE lower(trim(c.authors, ' ')) = lower(trim(g.authors, ' ')) AND trim(g.authors, ' ') <> ''""")
def author_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 with mandatory authors, those of the gold paper; the filter acts before the ranking."""
    papers = base.corpus(spark, d).select("pubkey", F.lower(F.trim("authors")).alias("by")).filter("by != ''")
    wanted = base.topics(spark, d).join(papers.withColumnRenamed("pubkey", "gold"), "gold").select("qid", "by")
    allowed = wanted.join(papers.withColumnRenamed("pubkey", "docid"), "by").select("qid", "docid")
    weights = R.weighted_postings(_index(spark, d), {"title": 2.0})
    terms = R.query_terms(base.topics(spark, d), T.tokenize_sparse("text"))
    hits = terms.join(allowed, "qid").join(weights, ["docid", "term"]).groupBy("qid", "docid").agg(F.round(F.sum(F.col("qw") * F.col("w")), 6).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "docid")
    return hits.select("qid", "docid", F.row_number().over(order).alias("rank"))


@query(f"""WITH {S.CORPUS}, {VECS}, {DENSE.replace('rank <= 30', 'rank <= 5')}, own AS (SELECT v.vec_id, v.pubkey, c.doc_text FROM vecs v JOIN corpus c USING (pubkey)),
    pool AS (SELECT n.qid, n.rank, greatest(1, round_even(5 * n.score, 0)) AS times, x.term, x.pos FROM dense n JOIN (SELECT vec_id AS docid, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos
             FROM (SELECT vec_id, {S.tok_expansion('doc_text')} AS toks FROM own)) x USING (docid)),
    counted AS (SELECT qid, term, sum(times) AS n, min(rank * 1000000 + pos) AS seen FROM pool GROUP BY qid, term),
    top30 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, seen) AS k FROM counted) WHERE k <= 30),
    known AS (SELECT DISTINCT vec_id AS qid, unnest({S.tok_expansion('doc_text')}) AS term FROM own)
    SELECT qid, term, CAST(n AS DOUBLE) AS n, CAST(pos AS INTEGER) AS pos FROM (SELECT t.*, row_number() OVER (PARTITION BY t.qid ORDER BY k) AS pos FROM top30 t ANTI JOIN known o ON t.qid = o.qid AND t.term = o.term) WHERE pos <= 15""")
def neighbor_expansion_dense(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the five nearest papers by vector, each counted ``max(1, bround(5 score))`` times; 30 most frequent, own terms out, first 15."""
    papers = base.corpus(spark, d).select("pubkey", T.tokenize_expansion("doc_text").alias("tokens"))
    texts = materialise(table(spark, d, "paper_vectors").filter("vec IS NOT NULL").select("vec_id", "pubkey").join(papers, "pubkey").select("vec_id", "tokens"), "tokens")
    near = _dense(spark, d, 5).withColumn("times", F.greatest(F.lit(1.0), F.bround(5 * F.col("score"), 0)))
    pool = near.join(texts.withColumnRenamed("vec_id", "docid"), "docid").select("qid", "rank", "times", F.posexplode("tokens").alias("at", "term"))
    counted = pool.groupBy("qid", "term").agg(F.sum("times").alias("n"), F.min(F.struct("rank", "at")).alias("seen"))
    top = counted.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "seen"))).filter("k <= 30")
    own = texts.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.explode("tokens").alias("term")).distinct()
    left = top.join(own, ["qid", "term"], "left_anti")
    return left.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("k"))).filter("pos <= 15").select("qid", "term", "n", "pos")


@query(f"""WITH {S.TOPICS}, {S.CORPUS}, f AS (SELECT t.qid, t.text AS original, {S.drop_handles('t.text')} AS clean, {S.joined(S.tok_expansion('t.text'))} AS keywords, {S.joined(S.tok_expansion("coalesce(c.title, '')"))} AS terms, t.gold AS pubkey
        FROM topics t LEFT JOIN corpus c ON c.pubkey = t.gold)
    SELECT qid AS index, original, keywords, concat_ws(' ', nullif(clean, ''), nullif(keywords, ''), nullif(terms, '')) AS expanded, pubkey FROM f""")
def expansion_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an expansion file: index, original, keywords, expanded, pubkey."""
    titles = base.corpus(spark, d).select(F.col("pubkey").alias("gold"), "title")
    some = lambda c: F.when(c != "", c)
    rows = base.topics(spark, d).join(titles, "gold", "left")
    keywords, terms = (F.array_join(T.tokenize_expansion(c), " ") for c in (F.col("text"), F.coalesce("title", F.lit(""))))
    return rows.select(F.col("qid").alias("index"), F.col("text").alias("original"), keywords.alias("keywords"), F.concat_ws(" ", some(T.clean_drop_handles("text")), some(keywords), some(terms)).alias("expanded"), F.col("gold").alias("pubkey"))


#: Keys of a strict expansion row.
STRICT = ("colbert", "embedding", "expanded", "index", "keywords", "original", "pubkey", "sparse")


@query(f"""WITH {S.TOPICS}, r AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS place FROM topics)
    SELECT qid, qid % 5 NOT IN (1, 2, 3) AS valid, CASE qid % 5 WHEN 1 THEN 'keys' WHEN 2 THEN 'text' WHEN 3 THEN 'index' END AS reason FROM r""")
def strict_expansion_check(spark: SparkSession, d: str) -> DataFrame:
    """Expansion rows have exactly their keys, texts that aren't blank and the index of their place; rows are spoiled in one of these ways."""
    from citeloom.operators.ordering import global_position

    rows = global_position(base.topics(spark, d).select("qid", "text"), ["qid"])
    k = F.col("qid") % 5
    fields = {c: F.lit("x") for c in STRICT} | {"index": F.when(k == 3, F.col("position") + 1).otherwise(F.col("position")), "pubkey": F.col("qid"), "original": F.col("text"), "sparse": F.when(k == 2, " ").otherwise("x")}
    struct = lambda names: F.to_json(F.struct(*[fields[c].alias(c) for c in names]))
    lines = rows.select("qid", "position", F.when(k == 1, struct(STRICT[1:])).otherwise(struct(STRICT)).alias("value"))
    reason = IO.expansion_fault(F.col("value"), F.col("position"), STRICT)
    return lines.select("qid", reason.isNull().alias("valid"), reason.alias("reason"))


@query("""WITH s AS (SELECT DISTINCT text_original AS src, text AS dst FROM final_de_tradottoen_test WHERE text_original IS NOT NULL AND text IS NOT NULL AND trim(text_original, ' ') <> '' AND trim(text, ' ') <> ''),
    f AS (SELECT 'de-en' AS direction, src, min(dst) AS dst FROM s GROUP BY src), b AS (SELECT 'en-de' AS direction, dst AS src, min(src) AS dst FROM f GROUP BY dst),
    q AS (SELECT DISTINCT qid, text_original AS src FROM final_de_tradottoen_test WHERE qid IS NOT NULL AND trim(text_original, ' ') <> ''),
    v AS (SELECT q.qid, q.src, f.dst AS mid, b.dst AS back FROM q JOIN f ON f.src = q.src JOIN b ON b.src = f.dst WHERE f.dst <> q.src)
    SELECT DISTINCT qid, md5('en-de|' || mid) AS key, md5(back) AS variant FROM v WHERE lower(trim(back, ' ')) <> lower(trim(src, ' '))""")
def back_translations(spark: SparkSession, d: str) -> DataFrame:
    """Variants by way of a pivot language from a cache keyed by direction: pivots equal to the source are skipped, variants equal to it and repeated ones dropped."""
    pairs = table(spark, d, "final_de_tradottoen_test").select("qid", F.col("text_original").alias("src"), F.col("text").alias("dst"))
    known = pairs.filter("trim(src) != '' AND trim(dst) != ''").groupBy("src").agg(F.min("dst").alias("dst"))
    back = known.groupBy(F.col("dst").alias("src")).agg(F.min("src").alias("dst"))
    cache = known.select(F.lit("de-en").alias("direction"), "src", "dst").unionByName(back.select(F.lit("en-de").alias("direction"), "src", "dst"))
    rows = pairs.filter("qid IS NOT NULL AND trim(src) != ''").select("qid", "src").distinct()
    return N.back_translated(rows, cache, "de-en", "en-de").select("qid", F.md5(F.concat(F.lit("en-de|"), "pivot")).alias("key"), F.md5("variant").alias("variant")).distinct()


TRIALS = 200


@query(f"""WITH t AS (SELECT CAST(unnest(range({TRIALS})) AS BIGINT) AS trial), c AS (SELECT trial, 40 + {_hex(_md5(42, "'threshold'", 'trial'), 8)} % 41 AS threshold, 1 + {_hex(_md5(42, "'terms'", 'trial'), 8)} % 10 AS terms,
        {_hex(_md5(42, "'weight'", 'trial'), 8)} % 21 AS weight FROM t), u AS (SELECT min(trial) AS trial, threshold, terms, weight FROM c GROUP BY threshold, terms, weight)
    SELECT trial, round(threshold / 100, 2) AS threshold, terms, round(weight / 2, 1) AS weight FROM u WHERE trial % 7 <> 0""")
def search_trials(spark: SparkSession, d: str) -> DataFrame:
    """Seeded random settings, each once, without those tried before (every seventh here): what a resumed search has left."""
    drawn = N.random_settings(spark, TRIALS, {"threshold": (40, 80), "terms": (1, 10), "weight": (0, 20)}, seed=42)
    done = drawn.filter("trial % 7 = 0").select("threshold", "terms", "weight")
    left = drawn.join(done, ["threshold", "terms", "weight"], "left_anti")
    return left.select("trial", F.round(F.col("threshold") / 100, 2).alias("threshold"), "terms", F.round(F.col("weight") / 2, 1).alias("weight"))


@query(f"""WITH {GROUPS}, c AS (SELECT g.qid, g.gold, count(p.docid) AS n FROM gold g LEFT JOIN pool p USING (qid) GROUP BY g.qid, g.gold)
    SELECT reason, CAST(count(*) AS BIGINT) AS queries FROM (SELECT CASE WHEN gold IS NULL THEN 'no_positive' WHEN n = 0 THEN 'no_candidates' WHEN n < 6 THEN 'few_candidates' ELSE 'kept' END AS reason FROM c) GROUP BY reason""")
def group_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why queries have groups of hard and soft negatives or none."""
    counts = _pool(spark, d).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    reason = F.when(F.col("gold").isNull(), "no_positive").when(n == 0, "no_candidates").when(n < 6, "few_candidates").otherwise("kept")
    return base.gold(spark, d).join(counts, "qid", "left").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("queries"))


@query(f"""WITH {S.CORPUS}, {JUDGED}, p AS (SELECT run_id, qid, min(CASE WHEN rel > 0 AND rank <= 10 THEN rank END) AS hit, max(CASE WHEN rank = 1 AND rel > 0 THEN 1 ELSE 0 END) AS first FROM judged GROUP BY run_id, qid)
    SELECT run_id, round(avg(coalesce(1.0 / hit, 0)), 6) AS mrr_10, round(avg(first), 6) AS precision_1 FROM p GROUP BY run_id""")
def graded_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank within ten and precision at one over graded lists."""
    rel = F.col("rel") > 0
    p = _judged(spark, d).groupBy("run_id", "qid").agg(F.min(F.when(rel & (F.col("rank") <= 10), F.col("rank"))).alias("hit"), F.max((rel & (F.col("rank") == 1)).cast("int")).alias("first"))
    return p.groupBy("run_id").agg(F.round(F.avg(F.coalesce(1 / F.col("hit"), F.lit(0.0))), 6).alias("mrr_10"), F.round(F.avg("first"), 6).alias("precision_1"))


@query(f"""WITH {S.RUNS}, {S.GOLD}, s AS (SELECT r.run_id, r.qid, r.docid, r.rank, CAST(coalesce(r.docid = g.gold, false) AS INTEGER) AS label FROM runs r JOIN gold g ON r.qid = g.qid),
    g AS (SELECT run_id, qid, row_number() OVER (ORDER BY {_md5(42, 'run_id', 'qid')}, run_id, qid) AS k FROM s GROUP BY run_id, qid HAVING sum(label) >= 1 AND count(*) >= 2)
    SELECT s.run_id, s.qid, s.docid, s.label FROM s JOIN g USING (run_id, qid) WHERE g.k <= 500""")
def eval_sample_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a seeded sample of at most 500 groups that have a positive and another document."""
    label = F.coalesce(F.col("docid") == F.col("gold"), F.lit(False)).cast("int")
    rows = base.runs(spark, d).join(base.gold(spark, d), "qid").select("run_id", "qid", "docid", label.alias("label"))
    groups = rows.groupBy("run_id", "qid").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).filter("p >= 1 AND n >= 2")
    chosen = groups.orderBy(N.seeded(42, "run_id", "qid"), "run_id", "qid").limit(500).select("run_id", "qid")
    return rows.join(chosen, ["run_id", "qid"])


# Tables of evaluation runs.


@query(f"""WITH {S.RANKED}, m AS (SELECT run_id, qid, {", ".join(f"CAST({HIT[k]} AS DOUBLE) AS recall_{k}" for k in HIT)}, {", ".join(f"{HIT[k]} / {k} AS precision_{k}" for k in (1, 5, 10))},
        CAST({HIT[1]} AS DOUBLE) AS f1_1, CAST({MRR} AS DOUBLE) AS mrr_5, CAST({AP} AS DOUBLE) AS ap, {", ".join(f"CAST({v} AS DOUBLE) AS ndcg_{k}" for k, v in GAIN.items())} FROM ranked)
    SELECT run_id, qid, metric, round(value, 6) AS value FROM (UNPIVOT m ON COLUMNS(* EXCLUDE (run_id, qid)) INTO NAME metric VALUE value)""")
def metric_long(spark: SparkSession, d: str) -> DataFrame:
    """All measures of all systems and queries, one a row."""
    ranked = E.first_relevant_rank(base.runs(spark, d), base.gold(spark, d))
    return RP.long_metrics(E.per_query(ranked).drop("gold", "rank")).withColumn("value", F.round("value", 6))


@query(f"""WITH {S.RUNS}, {S.GOLD}, {PATHS}, c AS (SELECT run_id, path FROM (SELECT DISTINCT run_id, 'runs/dev/res_' || run_id || '_deDev.json' AS path FROM run_entry WHERE run_id IS NOT NULL)),
    n AS (SELECT run_id, count(*) AS ranking_qids, count(g.qid) AS matched_qids FROM (SELECT DISTINCT run_id, qid FROM runs) r LEFT JOIN (SELECT DISTINCT qid FROM gold) g USING (qid) GROUP BY run_id)
    SELECT n.run_id, CAST(ranking_qids AS BIGINT) AS ranking_qids, CAST(matched_qids AS BIGINT) AS matched_qids, round(matched_qids / (SELECT count(*) FROM gold), 6) AS coverage, x.split, x.lang
    FROM n JOIN c USING (run_id) JOIN contexts x USING (path) WHERE matched_qids / (SELECT count(*) FROM gold) >= 0.3""")
def run_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Systems with their coverage and what the names of their files tell."""
    names = table(spark, d, "run_entry").filter("run_id IS NOT NULL").select("run_id").distinct()
    split, lang, _ = run_context("path")
    contexts = names.withColumn("path", F.concat(F.lit("runs/dev/res_"), "run_id", F.lit("_deDev.json"))).select("run_id", split.alias("split"), lang.alias("lang"))
    return RP.manifest(base.runs(spark, d), base.gold(spark, d), contexts, 0.3).withColumn("coverage", F.round("coverage", 6))
