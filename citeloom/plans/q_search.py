"""Queries of retrieval, feedback, fusion, reranking and query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions import text as T
from citeloom.operators import evaluation as E
from citeloom.operators import retrieval as R
from citeloom.operators.wordvec import neighbours, trained
from citeloom.plans import base
from citeloom.plans import sqltext as S
from citeloom.plans.registry import query
from citeloom.session import materialise, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return base.corpus(spark, d).withColumnRenamed("pubkey", "docid")


def _fields() -> dict[str, Column]:
    return {c: T.tokenize_sparse(F.coalesce(c, F.lit(""))) for c in ("title", "abstract")}


def _index(spark: SparkSession, d: str) -> DataFrame:
    return R.write_index(_docs(spark, d).select("docid", "title", "abstract"), _fields())


INDEX = f"""{S.CORPUS}, docs AS (SELECT pubkey AS docid, 'title' AS field, {S.tok_sparse("coalesce(title, '')")} AS tokens FROM corpus
        UNION ALL SELECT pubkey, 'abstract', {S.tok_sparse("coalesce(abstract, '')")} FROM corpus),
    postings AS (SELECT field, term, docid, dl, count(*) AS tf FROM (SELECT field, docid, len(tokens) AS dl, unnest(tokens) AS term FROM docs) GROUP BY field, term, docid, dl)"""


def _weights(title: float) -> str:
    return f"""{INDEX}, lens AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT field, docid, dl FROM postings) GROUP BY field),
    dfs AS (SELECT field, term, count(*) AS df FROM postings GROUP BY field, term),
    weights AS (SELECT term, docid, sum(CASE WHEN field = 'title' THEN {title} ELSE 1.0 END * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS w
                FROM postings JOIN dfs USING (field, term) JOIN lens USING (field) GROUP BY term, docid)"""


def _search(name: str, terms: str, k: int) -> str:
    """CTEs of a BM25 run called ``name`` over the query terms CTE ``terms``."""
    return f"""{name}_s AS (SELECT qid, docid, round(sum(qw * w), 6) AS score FROM {terms} JOIN weights USING (term) GROUP BY qid, docid),
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM {name}_s) WHERE rank <= {k})"""


def _terms_sql(name: str, tokens: str, source: str = "topics", boost: float = 1.0) -> str:
    return f"{name} AS (SELECT qid, term, count(*) * {boost} AS qw FROM (SELECT qid, unnest({tokens}) AS term FROM {source}) GROUP BY qid, term)"


BM25 = f"{_weights(2.0)}, {S.TOPICS}, {_terms_sql('terms', S.tok_sparse('text'))}, {_search('bm', 'terms', 100)}"


def bm25_run(spark: SparkSession, d: str, k: int = 100, index: DataFrame | None = None) -> DataFrame:
    return R.bm25(R.query_terms(base.topics(spark, d), T.tokenize_sparse("text")), _index(spark, d) if index is None else index, k, {"title": 2.0})


def _run(spark: SparkSession, d: str, k: int, index: DataFrame | None = None) -> DataFrame:
    """``bm25_run`` written, to be joined: its size is known then."""
    return materialise(bm25_run(spark, d, k, index), "run")


def _words(spark: SparkSession, d: str, tokens: Column) -> DataFrame:
    """``docid, tokens`` made once a paper: written, so that the optimiser can't move it behind a join."""
    return materialise(_docs(spark, d).select("docid", tokens.alias("tokens")), "tokens")


@query(f"WITH {INDEX} SELECT field, term, docid, CAST(dl AS INTEGER) AS dl, CAST(tf AS BIGINT) AS tf FROM postings")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)


@query(f"WITH {BM25} SELECT qid, docid, score, CAST(rank AS INTEGER) AS rank FROM bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25_run(spark, d)


@query(f"""WITH {BM25}, r AS (SELECT t.qid, coalesce(min(b.rank), -1) AS rank FROM topics t LEFT JOIN bm b ON t.qid = b.qid AND t.gold = b.docid GROUP BY t.qid)
    SELECT 'bm25' AS run_id, CAST(count(*) AS BIGINT) AS queries, round(avg(CAST(rank BETWEEN 1 AND 1 AS INTEGER)), 6) AS recall_1, round(avg(CAST(rank BETWEEN 1 AND 100 AS INTEGER)), 6) AS recall_100,
    round(avg(CASE WHEN rank BETWEEN 1 AND 5 THEN 1.0 / rank ELSE 0 END), 6) AS mrr_5, round(avg(CASE WHEN rank BETWEEN 1 AND 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_10 FROM r""")
def bm25_evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval and its evaluation end to end."""
    run = materialise(bm25_run(spark, d).withColumn("run_id", F.lit("bm25")), "run")
    ranked = E.first_relevant_rank(run, base.topics(spark, d).select("qid", "gold"))
    return ranked.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg(E.hit(1)), 6).alias("recall_1"), F.round(F.avg(E.hit(100)), 6).alias("recall_100"),
        F.round(F.avg(E.reciprocal(5)), 6).alias("mrr_5"), F.round(F.avg(E.gain(10)), 6).alias("ndcg_10"),
    )


#: Topics with an expansion: title of the gold paper, where there is one.
EXPANDED = f"expanded AS (SELECT t.qid, t.text, c.title AS extra, {S.ws('c.venue')} AS third FROM topics t LEFT JOIN corpus c ON t.gold = c.pubkey)"


def _expanded(spark: SparkSession, d: str) -> DataFrame:
    papers = base.corpus(spark, d).select(F.col("pubkey").alias("gold"), F.col("title").alias("extra"), T.normalize_ws("venue").alias("third"))
    return base.topics(spark, d).select("qid", "text", "gold").join(papers, "gold", "left")


def _boosted(spark: SparkSession, d: str, boosts: tuple[float, ...], title: float) -> DataFrame:
    queries = _expanded(spark, d)
    clauses = [R.query_terms(queries, T.tokenize_sparse(F.coalesce(c, F.lit(""))), b) for c, b in zip(("text", "extra", "third"), boosts)]
    return R.bm25(R.merged_terms(*clauses), _index(spark, d), 100, {"title": title})


def _boosted_sql(boosts: tuple[float, ...], title: float) -> str:
    parts = [_terms_sql(f"c{i}", S.tok_sparse(f"coalesce({c}, '')"), "expanded", b) for i, (c, b) in enumerate(zip(("text", "extra", "third"), boosts))]
    union = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(boosts)))
    return f"""WITH {_weights(title)}, {S.TOPICS}, {EXPANDED}, {", ".join(parts)}, terms AS (SELECT qid, term, sum(qw) AS qw FROM ({union}) GROUP BY qid, term), {_search("bm", "terms", 100)}
    SELECT qid, docid, score, CAST(rank AS INTEGER) AS rank FROM bm"""


@query(_boosted_sql((2.0, 1.0), 1.5))
def bm25_boosted(spark: SparkSession, d: str) -> DataFrame:
    return _boosted(spark, d, (2.0, 1.0), 1.5)


@query(_boosted_sql((0.3, 12.6, 20.0), 1.0))
def bm25_three_way(spark: SparkSession, d: str) -> DataFrame:
    return _boosted(spark, d, (0.3, 12.6, 20.0), 1.0)


GRID = [(a, b) for a in (0.5, 1.0, 2.0) for b in (0.0, 1.0, 4.0)]


@query(f"""WITH {_weights(1.0)}, {S.TOPICS}, {EXPANDED}, {_terms_sql('c0', S.tok_sparse('text'), 'expanded')}, {_terms_sql('c1', S.tok_sparse("coalesce(third, '')"), 'expanded')},
    grid AS (SELECT unnest([{", ".join(f"{{'a': {a}, 'b': {b}}}" for a, b in GRID)}]) AS g),
    p AS (SELECT qid, docid, sum(x) AS x, sum(y) AS y FROM (SELECT qid, docid, sum(qw * w) AS x, 0.0 AS y FROM c0 JOIN weights USING (term) GROUP BY qid, docid
          UNION ALL SELECT qid, docid, 0.0, sum(qw * w) FROM c1 JOIN weights USING (term) GROUP BY qid, docid) GROUP BY qid, docid),
    s AS (SELECT g.a AS a, g.b AS b, qid, docid, row_number() OVER (PARTITION BY g.a, g.b, qid ORDER BY round(g.a * x + g.b * y, 6) DESC, docid) AS rank FROM p, grid)
    SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(count(*) FILTER (rank <= 10 AND docid = gold) AS BIGINT) AS hits FROM s JOIN topics USING (qid) GROUP BY a, b""")
def grid_eval(spark: SparkSession, d: str) -> DataFrame:
    """Clause weights tried at once: partial scores are computed a single time, each grid point only reranks."""
    queries = _expanded(spark, d)
    none = F.lit(0.0)
    text, venue = (R.query_terms(queries, T.tokenize_sparse(F.coalesce(c, F.lit("")))) for c in ("text", "third"))
    both = text.select("qid", "term", F.col("qw").alias("qx"), none.alias("qy")).unionByName(venue.select("qid", "term", none.alias("qx"), F.col("qw").alias("qy")))
    terms = both.groupBy("qid", "term").agg(F.sum("qx").alias("qx"), F.sum("qy").alias("qy")).join(queries.select("qid", "gold"), "qid")
    return R.bm25_grid(terms, _index(spark, d), GRID, 10)


@query(f"WITH {BM25} SELECT b.qid, b.docid, CAST(row_number() OVER (PARTITION BY b.qid ORDER BY b.score DESC, b.docid) AS INTEGER) AS rank FROM bm_s b JOIN topics t USING (qid) JOIN corpus g ON g.pubkey = t.gold JOIN corpus c ON c.pubkey = b.docid WHERE lower(c.venue) = lower(g.venue)")
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 with a mandatory venue: that of the gold paper; the filter acts before the ranking."""
    docs = _docs(spark, d).select("docid", "title", "abstract", F.lower("venue").alias("grp"))
    wanted = base.topics(spark, d).join(docs.select(F.col("docid").alias("gold"), "grp"), "gold").select("qid", "grp")
    terms = R.query_terms(base.topics(spark, d), T.tokenize_sparse("text")).join(wanted, "qid")
    return R.bm25_in_groups(terms, docs, _fields(), {"title": 2.0})


# Vectors. Query vectors are those whose id is divisible by 100, against all vectors.

VECS = """vecs AS (SELECT vec_id, pubkey, CAST(vec AS DOUBLE[64]) AS v, list_inner_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[])) AS sq FROM paper_vectors WHERE vec IS NOT NULL)"""
DENSE = """dense_s AS (SELECT q.vec_id AS qid, d.vec_id AS docid, round(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])), 6) AS score
        FROM vecs q JOIN vecs d ON q.vec_id <> d.vec_id AND q.vec_id % 100 = 0),
    dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM dense_s) WHERE rank <= 30)"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paper_vectors").filter("vec IS NOT NULL").select(F.col("vec_id").alias("docid"), "pubkey", F.col("vec").alias("v"))


def _dense(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    docs = _vectors(spark, d)
    return R.dense_top_k(docs.filter("docid % 100 = 0").select(F.col("docid").alias("qid"), "v"), docs, k)


@query(f"WITH {VECS}, {DENSE} SELECT qid, docid, score, CAST(rank AS INTEGER) AS rank FROM dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d)


@query(f"WITH {VECS} SELECT vec_id, round(CASE WHEN sq > 0 THEN sqrt(list_inner_product(list_transform(CAST(v AS DOUBLE[]), lambda x: x / sqrt(sq)), list_transform(CAST(v AS DOUBLE[]), lambda x: x / sqrt(sq)))) ELSE 0 END, 6) AS norm, round(CASE WHEN sq > 0 THEN v[1] / sqrt(sq) ELSE 0 END, 6) AS head FROM vecs")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).select("docid", R.unit("v").alias("u"))
    return rows.select(F.col("docid").alias("vec_id"), F.round(F.sqrt(R.dot("u", "u")), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("head"))


@query(f"WITH {VECS}, n AS (SELECT count(*) AS n FROM vecs) SELECT k, m, CAST(least(n, greatest(k, k * m)) AS BIGINT) AS pool FROM (SELECT unnest([10, 100, 2000]) AS k), (SELECT unnest([1, 3, 5]) AS m), n")
def candidate_size(spark: SparkSession, d: str) -> DataFrame:
    n = _vectors(spark, d).agg(F.count(F.lit(1)).alias("n"))
    sizes = n.select("n", F.explode(F.array(*map(F.lit, (10, 100, 2000)))).alias("k")).select("n", "k", F.explode(F.array(*map(F.lit, (1, 3, 5)))).alias("m"))
    return sizes.select("k", "m", F.least("n", F.greatest("k", F.col("k") * F.col("m"))).alias("pool"))


_LATE_BEST = "list_max(list_transform(range(8), lambda j: list_inner_product(CAST(q.v[i * 8 + 1:i * 8 + 8] AS DOUBLE[]), CAST(e.v[j * 8 + 1:j * 8 + 8] AS DOUBLE[]))))"
SIGNALS = f"""{S.CORPUS}, {VECS}, {DENSE}, toks AS (SELECT v.vec_id, {S.tok_sparse('c.doc_text')} AS tokens FROM vecs v JOIN corpus c ON c.pubkey = v.pubkey),
    tf AS (SELECT vec_id, term, count(*) AS tf FROM (SELECT vec_id, unnest(tokens) AS term FROM toks) GROUP BY vec_id, term),
    idf AS (SELECT term, ln((SELECT count(*) FROM toks) / count(*)) AS idf FROM tf GROUP BY term),
    sw AS (SELECT vec_id, term, tf / (tf + 1.0) * idf AS w FROM tf JOIN idf USING (term)),
    sparse AS (SELECT d.qid, d.docid, round(sum(a.w * b.w), 6) AS sparse FROM dense d JOIN sw a ON a.vec_id = d.qid JOIN sw b ON b.vec_id = d.docid AND a.term = b.term GROUP BY d.qid, d.docid),
    late AS (SELECT d.qid, d.docid, round(list_sum(list_transform(range(8), lambda i: {_LATE_BEST})) / 8, 6) AS late FROM dense d JOIN vecs q ON q.vec_id = d.qid JOIN vecs e ON e.vec_id = d.docid),
    cand AS (SELECT d.qid, d.docid, d.score AS dense, coalesce(s.sparse, 0) AS sparse, l.late FROM dense d JOIN late l USING (qid, docid) LEFT JOIN sparse s USING (qid, docid))"""


def _sparse_weights(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(``id, term, w`` of every vector's paper, the same of its title alone): damped tf times idf over the papers."""
    texts = base.corpus(spark, d).select("pubkey", T.tokenize_sparse("doc_text").alias("whole"), T.tokenize_sparse(F.coalesce("title", F.lit(""))).alias("title"))
    rows = materialise(_vectors(spark, d).join(texts, "pubkey").select(F.col("docid").alias("id"), "whole", "title"), "tokens")

    def tf(c: str) -> DataFrame:
        return rows.select("id", F.explode(c).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))

    idf = tf("whole").groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))))
    weight = (F.col("tf") / (F.col("tf") + 1.0) * F.log(F.col("n") / F.col("df"))).alias("w")
    return tuple(tf(c).join(idf, "term").select("id", "term", weight) for c in ("whole", "title"))


def _signals(spark: SparkSession, d: str, per_field: bool = False) -> DataFrame:
    pool = materialise(_dense(spark, d).select("qid", "docid", F.col("score").alias("dense")), "dense")
    w, titles = _sparse_weights(spark, d)
    asked = titles if per_field else w
    left = pool.select("qid", "docid").join(asked.select(F.col("id").alias("qid"), "term", F.col("w").alias("a")), "qid")
    sparse = left.join(w.select(F.col("id").alias("docid"), "term", F.col("w").alias("b")), ["docid", "term"]).groupBy("qid", "docid").agg(F.round(F.sum(F.col("a") * F.col("b")), 6).alias("sparse"))
    vectors = _vectors(spark, d).select(F.col("docid").alias("id"), R.tokens_of_vector("v").alias("t"))
    pieces = F.slice("t", 1, 4) if per_field else F.col("t")
    both = pool.join(vectors.select(F.col("id").alias("qid"), pieces.alias("x")), "qid").join(vectors.select(F.col("id").alias("docid"), F.col("t").alias("y")), "docid")
    late = both.select("qid", "docid", "dense", F.round(R.max_sim("x", "y"), 6).alias("late"))
    return late.join(sparse, ["qid", "docid"], "left").select("qid", "docid", "dense", F.coalesce("sparse", F.lit(0.0)).alias("sparse"), "late")


@query(f"WITH {SIGNALS} SELECT qid, docid, late FROM late")
def maxsim(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("qid", "docid", "late")


@query(f"WITH {SIGNALS} SELECT qid, docid, sparse FROM sparse")
def sparse_score(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).filter("sparse > 0").select("qid", "docid", "sparse")


def _hybrid_sql(a: float, b: float, c: float) -> str:
    return f"""WITH {SIGNALS}, h AS (SELECT qid, docid, round({a} * dense + {b} * sparse + {c} * late, 6) AS score FROM cand)
    SELECT * FROM (SELECT qid, docid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS INTEGER) AS rank FROM h) WHERE rank <= 10"""


@query(_hybrid_sql(0.5, 0.15, 0.35))
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.hybrid(_signals(spark, d), (0.5, 0.15, 0.35), 10).select("qid", "docid", "score", "rank")


PER_FIELD = (
    SIGNALS.replace("sparse AS (SELECT", f"""ft AS (SELECT v.vec_id, {S.tok_sparse("coalesce(c.title, '')")} AS tokens FROM vecs v JOIN corpus c ON c.pubkey = v.pubkey),
    fq AS (SELECT vec_id, term, tf / (tf + 1.0) * idf AS w FROM (SELECT vec_id, term, count(*) AS tf FROM (SELECT vec_id, unnest(tokens) AS term FROM ft) GROUP BY vec_id, term) JOIN idf USING (term)),
    sparse AS (SELECT""")
    .replace("JOIN sw a ON a.vec_id = d.qid", "JOIN fq a ON a.vec_id = d.qid")
    .replace("list_transform(range(8), lambda i: ", "list_transform(range(4), lambda i: ")
    .replace(")) / 8, 6) AS late", ")) / 4, 6) AS late")
)


@query(_hybrid_sql(0.35, 0.15, 0.5).replace(SIGNALS, PER_FIELD))
def hybrid_per_field(spark: SparkSession, d: str) -> DataFrame:
    """Each signal from its own field of the query: its vector for dense, its paper's title alone for sparse, the first half of its pieces for late."""
    return R.hybrid(_signals(spark, d, per_field=True), (0.35, 0.15, 0.5), 10).select("qid", "docid", "score", "rank")


def _scaled(s: str) -> str:
    span = f"max({s}) OVER (PARTITION BY qid) - min({s}) OVER (PARTITION BY qid)"
    return f"round(CASE WHEN {span} > 1e-12 THEN ({s} - min({s}) OVER (PARTITION BY qid)) / ({span}) ELSE 0 END, 6) AS {s}_scaled"


LTR = f"""{SIGNALS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, docid) - 1 AS r, count(*) OVER (PARTITION BY qid) AS n FROM cand)"""
LTR_COLUMNS = f"""qid, docid, dense, sparse, late, {", ".join(map(_scaled, ("dense", "sparse", "late")))}, round(CASE WHEN n > 1 THEN 1 - r / (n - 1) ELSE 1 END, 6) AS rank_fraction,
    round(1 / (r + 1), 6) AS rank_inverse, round(1 / log2(r + 2), 6) AS rank_log"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


@query(f"WITH {LTR} SELECT {LTR_COLUMNS} FROM r")
def ltr_features(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(R.ltr_features(_signals(spark, d)))


@query(f"""WITH {LTR}, l AS (SELECT {LTR_COLUMNS} FROM r), m AS (SELECT *, CAST(late > avg(late) OVER (PARTITION BY qid) AS INTEGER) AS label FROM l)
    SELECT * EXCLUDE (lo, hi) FROM (SELECT *, min(label) OVER (PARTITION BY qid) AS lo, max(label) OVER (PARTITION BY qid) AS hi FROM m) WHERE lo < hi""")
def ltr_train_set(spark: SparkSession, d: str) -> DataFrame:
    """Features with a stand-in label (late score above the query's mean); queries without a positive or a negative are skipped."""
    every = Window.partitionBy("qid")
    rows = _rounded(R.ltr_features(_signals(spark, d))).withColumn("label", (F.col("late") > F.avg("late").over(every)).cast("int"))
    return rows.withColumns({"lo": F.min("label").over(every), "hi": F.max("label").over(every)}).filter("lo < hi").drop("lo", "hi")


@query()
def ltr_model(spark: SparkSession, d: str) -> DataFrame:
    """A boosted-tree surrogate trained on the labelled features, applied to all candidates."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = ltr_train_set(spark, d)
    names = [c for c in rows.columns if c not in ("qid", "docid", "label")]
    if rows.isEmpty():
        return rows.select("qid", "docid", F.lit(0.0).alias("prediction"), F.lit(0).alias("rank"))
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    model = GBTRegressor(labelCol="label", maxIter=20, maxDepth=4, stepSize=0.1, seed=1).fit(ready)
    scored = model.transform(ready).select("qid", "docid", F.round("prediction", 6).alias("score"))
    return R.top_k(scored, 10).withColumnRenamed("score", "prediction")


@query(f"WITH {BM25} SELECT qid, docid, round(1 / (1 + exp(-score)), 6) AS p FROM bm")
def sigmoid(spark: SparkSession, d: str) -> DataFrame:
    return bm25_run(spark, d).select("qid", "docid", F.round(1 / (1 + F.exp(-F.col("score"))), 6).alias("p"))


# Reranking and candidate joins, over the runs of the German queries.

FIRST = f"{S.RUNS}, {S.CORPUS}, first AS (SELECT qid, docid, rank FROM runs WHERE run_id = 'pooled_deep'), dq AS (SELECT qid, min(text) AS text FROM final_de_tradottoen_test WHERE qid IS NOT NULL GROUP BY qid)"
_SCORE = f"len(list_intersect(list_distinct({S.tok_sparse('q.text')}), {S.tok_sparse('c.doc_text')})) / greatest(1, len(list_distinct({S.tok_sparse('q.text')})))"
RERANK = f"""{FIRST}, scored AS (SELECT f.qid, f.docid, f.rank AS first_rank, round({_SCORE}, 6) AS new_score FROM first f JOIN dq q USING (qid) JOIN corpus c ON c.pubkey = f.docid
        WHERE f.rank <= 100 AND q.text IS NOT NULL),
    again AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY new_score DESC, first_rank) AS INTEGER) AS rank FROM scored),
    kept AS (SELECT qid, docid, CAST(rank AS INTEGER) AS first_rank, CAST(NULL AS DOUBLE) AS new_score, CAST(rank AS INTEGER) AS rank FROM first WHERE qid NOT IN (SELECT qid FROM scored))"""


def _first(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    run = base.runs(spark, d).filter("run_id = 'pooled_deep'").select("qid", "docid", "rank")
    queries = table(spark, d, "final_de_tradottoen_test").filter("qid IS NOT NULL").groupBy("qid").agg(F.min("text").alias("text"))
    return run, queries, _docs(spark, d).select("docid", "doc_text")


@query(f"WITH {FIRST} SELECT f.qid, f.docid, CAST(f.rank AS INTEGER) AS rank, length(c.doc_text) AS chars FROM first f JOIN corpus c ON c.pubkey = f.docid")
def candidate_text_join(spark: SparkSession, d: str) -> DataFrame:
    run, _, docs = _first(spark, d)
    return run.join(docs, "docid").select("qid", "docid", "rank", F.length("doc_text").alias("chars"))


@query(f"WITH {FIRST} SELECT qid, docid, CAST(rank AS INTEGER) AS rank FROM first WHERE docid IN (SELECT pubkey FROM corpus)")
def corpus_semi(spark: SparkSession, d: str) -> DataFrame:
    run, _, docs = _first(spark, d)
    return run.join(docs, "docid", "left_semi").select("qid", "docid", "rank")


def _reranked(spark: SparkSession, d: str, keep: int | None, missing: str = "first_stage") -> DataFrame:
    run, queries, docs = _first(spark, d)
    # Tokenised once a text, not once a pair; written, so that the optimiser can't move it behind the join.
    queries = queries.withColumn("query_terms", F.array_distinct(T.tokenize_sparse("text")))
    docs = materialise(docs.withColumn("doc_terms", F.array_distinct(T.tokenize_sparse("doc_text"))), "doc_terms")
    return R.rerank(run, queries, docs, R.overlap_score, 100, keep, missing)


@query(f"WITH {RERANK} SELECT * FROM (SELECT * FROM again UNION ALL SELECT * FROM kept) WHERE rank <= 20")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d, 20)


@query(f"WITH {RERANK} SELECT * FROM again UNION ALL SELECT * FROM kept WHERE rank <= 100")
def rerank_all(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d, 100)


@query(f"WITH {RERANK} SELECT * FROM again")
def rerank_omit(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d, None, "omit")


@query(f"WITH {RERANK} SELECT qid, docid, rank FROM kept")
def rerank_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d, None).filter("new_score IS NULL").select("qid", "docid", "rank")


@query(f"""WITH {S.RUNS}, f AS (SELECT qid, docid, count(*) AS support, round(sum(1 / (60 + rank)), 9) AS rrf, min(rank) AS best, round(avg(rank), 6) AS mean_rank FROM runs GROUP BY qid, docid)
    SELECT qid, docid, CAST(support AS BIGINT) AS support, rrf, CAST(best AS INTEGER) AS best, mean_rank,
    CAST(row_number() OVER (PARTITION BY qid ORDER BY support DESC, rrf DESC, best, mean_rank, docid) AS INTEGER) AS rank FROM f""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return R.reciprocal_rank_fusion(base.runs(spark, d))


@query("""WITH n AS (SELECT run_id, qid, docid, min(CASE WHEN run_rank > 0 THEN run_rank END) AS given, max(CASE WHEN NOT isnan(score) THEN score END) AS score FROM run_entry GROUP BY run_id, qid, docid)
    SELECT run_id, qid, docid, score, CAST(row_number() OVER (PARTITION BY run_id, qid ORDER BY given ASC NULLS LAST, score DESC NULLS LAST, docid) AS INTEGER) AS rank FROM n""")
def normalize_ranks(spark: SparkSession, d: str) -> DataFrame:
    return R.normalize_ranks(table(spark, d, "run_entry").withColumnRenamed("run_rank", "rank"), ("run_id", "qid"))


# Pseudo-relevance feedback.

DOC_TOKENS = f"doc_tokens AS (SELECT pubkey AS docid, {S.tok_sparse('doc_text')} AS tokens FROM corpus)"
PRF = f"""{BM25}, {DOC_TOKENS}, freq AS (SELECT b.qid, x.term, count(*) AS freq FROM bm b JOIN (SELECT docid, unnest(tokens) AS term FROM doc_tokens) x USING (docid) WHERE b.rank <= 5 GROUP BY b.qid, x.term),
    fb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY freq DESC, term) AS pos FROM freq) WHERE pos <= 10),
    terms2 AS (SELECT qid, term, sum(qw) AS qw FROM (SELECT * FROM terms UNION ALL SELECT qid, term, 1.0 FROM fb) GROUP BY qid, term), {_search('bm2', 'terms2', 100)}"""


def _feedback(spark: SparkSession, d: str, run: DataFrame) -> DataFrame:
    return R.feedback_terms(run, _words(spark, d, T.tokenize_sparse("doc_text")), 5, 10)


@query(f"WITH {PRF} SELECT qid, docid, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 5")
def prf_pass1(spark: SparkSession, d: str) -> DataFrame:
    return bm25_run(spark, d, 5).select("qid", "docid", "rank")


@query(f"WITH {PRF} SELECT qid, term, CAST(freq AS BIGINT) AS freq, CAST(pos AS INTEGER) AS pos FROM fb")
def prf_terms(spark: SparkSession, d: str) -> DataFrame:
    return _feedback(spark, d, _run(spark, d, 5))


def _second_pass(spark: SparkSession, d: str, first: DataFrame, index: DataFrame) -> DataFrame:
    own = R.query_terms(base.topics(spark, d), T.tokenize_sparse("text"))
    extra = _feedback(spark, d, first).select("qid", "term", F.lit(1.0).alias("qw"))
    return R.bm25(R.merged_terms(own, extra), index, 100, {"title": 2.0})


@query(f"WITH {PRF} SELECT qid, docid, score, CAST(rank AS INTEGER) AS rank FROM bm2")
def prf_two_pass(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return _second_pass(spark, d, _run(spark, d, 5, index), index)


@query(f"""WITH {PRF}, u AS (SELECT qid, docid, min(p * 1000 + rank) AS seen_at FROM (SELECT qid, docid, 0 AS p, rank FROM bm UNION ALL SELECT qid, docid, 1, rank FROM bm2) GROUP BY qid, docid)
    SELECT * FROM (SELECT qid, docid, CAST(row_number() OVER (PARTITION BY qid ORDER BY seen_at) AS INTEGER) AS rank FROM u) WHERE rank <= 120""")
def prf_hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    first = _run(spark, d, 100, index)
    return R.ordered_union(first, _second_pass(spark, d, first, index), 120)


#: Papers looked at, terms taken, final depth.
PRESETS = {
    "balanced": (5, 10, 100), "high_recall": (10, 20, 1000), "high_recall_aggressive": (15, 30, 2000), "high_precision": (3, 5, 100),
    "high_precision_conservative": (2, 3, 100), "scientific_medical": (8, 15, 500), "short_query": (3, 8, 100), "long_query": (5, 12, 150),
    "niche_domain": (8, 12, 200), "fast": (3, 5, 50),
}


@query("SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {a}, {b}, {c}, {int(a * 1.5)}, {int(b * 1.5)}, {int(c * 1.5)}, {int(a / 2.0)}, {int(b / 2.0)})" for n, (a, b, c) in PRESETS.items()
) + ") AS t(name, docs, terms, depth, docs_recall, terms_recall, depth_recall, docs_precision, terms_precision)")
def prf_configs(spark: SparkSession, d: str) -> DataFrame:
    """Presets, tuned for recall (all counts x 1.5) and for precision (papers and terms / 2), truncated."""
    rows = spark.createDataFrame([(n, *v) for n, v in PRESETS.items()], "name string, docs int, terms int, depth int")
    scaled = {f"{c}_recall": (F.col(c) * 1.5).cast("int") for c in ("docs", "terms", "depth")} | {f"{c}_precision": (F.col(c) / 2.0).cast("int") for c in ("docs", "terms")}
    return rows.withColumns(scaled)


CHOSEN = f"""chosen AS (SELECT qid, text, CASE WHEN n <= 2 THEN 'short_query' WHEN n >= 5 THEN 'long_query' WHEN regexp_matches(lower(text), 'vaccine|covid|medical|disease') THEN 'scientific_medical'
    ELSE 'balanced' END AS preset FROM (SELECT qid, text, len(string_split({S.ws('text')}, ' ')) AS n FROM topics))"""


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.split(T.normalize_ws("text"), " "))
    medical = F.lower("text").rlike("vaccine|covid|medical|disease")
    preset = F.when(n <= 2, "short_query").when(n >= 5, "long_query").when(medical, "scientific_medical").otherwise("balanced")
    return base.topics(spark, d).select("qid", "text", preset.alias("preset"))


@query(f"WITH {S.TOPICS}, {CHOSEN} SELECT qid, preset FROM chosen")
def prf_adaptive_config(spark: SparkSession, d: str) -> DataFrame:
    """The preset of a query by its words: up to two, five and more, else by subject."""
    return _chosen(spark, d).select("qid", "preset")


PRESET_ROWS = "presets AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {b}, {c})" for n, (a, b, c) in PRESETS.items()) + ") AS t(preset, docs, n_terms, depth))"
ADAPTIVE = f"""{BM25}, {CHOSEN}, {PRESET_ROWS}, {DOC_TOKENS}, conf AS (SELECT qid, docs, n_terms, depth FROM chosen JOIN presets USING (preset)),
    freq AS (SELECT b.qid, x.term, count(*) AS freq FROM bm b JOIN conf c USING (qid) JOIN (SELECT docid, unnest(tokens) AS term FROM doc_tokens) x USING (docid) WHERE b.rank <= c.docs GROUP BY b.qid, x.term),
    fb AS (SELECT qid, term FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY freq DESC, term) AS pos FROM freq) JOIN conf USING (qid) WHERE pos <= n_terms),
    terms2 AS (SELECT qid, term, sum(qw) AS qw FROM (SELECT * FROM terms UNION ALL SELECT qid, term, 1.0 FROM fb) GROUP BY qid, term), {_search('bm2', 'terms2', 2000)}"""


@query(f"WITH {ADAPTIVE} SELECT qid, docid, score, CAST(rank AS INTEGER) AS rank FROM bm2 JOIN conf USING (qid) WHERE rank <= depth")
def prf_adaptive(spark: SparkSession, d: str) -> DataFrame:
    """Two passes with the counts of each query's own preset."""
    presets = F.create_map(*[x for n, v in PRESETS.items() for x in (F.lit(n), F.array(*map(F.lit, v)))])
    chosen = _chosen(spark, d).select("qid", presets[F.col("preset")].alias("v"))
    conf = materialise(chosen.select("qid", *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(("docs", "terms", "depth"))]), "presets")
    index = _index(spark, d)
    first = _run(spark, d, max(v[0] for v in PRESETS.values()), index).join(conf, "qid").filter(F.col("rank") <= F.col("docs")).select("qid", "docid", "rank")
    docs = _words(spark, d, T.tokenize_sparse("doc_text"))
    most = max(v[1] for v in PRESETS.values())
    extra = R.feedback_terms(first, docs, most, most).join(conf, "qid").filter(F.col("pos") <= F.col("terms")).select("qid", "term", F.lit(1.0).alias("qw"))
    own = R.query_terms(base.topics(spark, d), T.tokenize_sparse("text"))
    deepest = max(PRESETS[c][2] for c in ("short_query", "long_query", "scientific_medical", "balanced"))
    found = materialise(R.bm25(R.merged_terms(own, extra), index, deepest, {"title": 2.0}), "run")
    return found.join(conf, "qid").filter(F.col("rank") <= F.col("depth")).select("qid", "docid", "score", "rank")


# Query expansion.

NEIGHBOURS = f"""{BM25}, near AS (SELECT qid, docid, rank, score / max(score) OVER (PARTITION BY qid) AS s FROM bm WHERE rank <= 5),
    pool AS (SELECT n.qid, n.rank, round_even(5 * n.s, 0) AS times, x.term, x.pos FROM near n JOIN (SELECT pubkey AS docid, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos
             FROM (SELECT pubkey, {S.tok_expansion('doc_text')} AS toks FROM corpus)) x USING (docid)),
    counted AS (SELECT qid, term, sum(greatest(1, times)) AS n, min(rank * 1000000 + pos) AS seen FROM pool GROUP BY qid, term),
    top30 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, seen) AS k FROM counted) WHERE k <= 30),
    own AS (SELECT DISTINCT qid, unnest({S.tok_expansion('text')}) AS term FROM topics),
    picked AS (SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY t.qid ORDER BY k) AS pos FROM top30 t ANTI JOIN own o ON t.qid = o.qid AND t.term = o.term) WHERE pos <= 15)"""


def _neighbour_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the five nearest papers, each counted ``max(1, bround(5 s))`` times; 30 most frequent, own terms out, first 15."""
    near = _run(spark, d, 5).withColumn("s", F.col("score") / F.max("score").over(Window.partitionBy("qid")))
    pool = near.select("qid", "docid", "rank", F.greatest(F.lit(1.0), F.bround(5 * F.col("s"), 0)).alias("times"))
    pool = R.with_tokens(pool, _words(spark, d, T.tokenize_expansion("doc_text"))).select("qid", "rank", "times", F.posexplode("tokens").alias("at", "term"))
    counted = pool.groupBy("qid", "term").agg(F.sum("times").alias("n"), F.min(F.struct("rank", "at")).alias("seen"))
    order = Window.partitionBy("qid").orderBy(F.desc("n"), "seen")
    top = counted.withColumn("k", F.row_number().over(order)).filter("k <= 30")
    own = base.topics(spark, d).select("qid", F.explode(T.tokenize_expansion("text")).alias("term")).distinct()
    left = top.join(own, ["qid", "term"], "left_anti")
    return left.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("k"))).filter("pos <= 15")


@query(f"WITH {NEIGHBOURS} SELECT qid, term, CAST(n AS DOUBLE) AS n, CAST(pos AS INTEGER) AS pos FROM picked")
def neighbor_expansion(spark: SparkSession, d: str) -> DataFrame:
    return _neighbour_terms(spark, d).select("qid", "term", "n", "pos")


@query(f"""WITH {NEIGHBOURS}, e AS (SELECT qid, string_agg(term, ' ' ORDER BY pos) AS extra FROM picked GROUP BY qid)
    SELECT t.qid, concat_ws(' ', nullif({S.drop_handles('t.text')}, ''), nullif({S.joined(S.tok_expansion('t.text'))}, ''), e.extra) AS expanded FROM topics t LEFT JOIN e USING (qid)""")
def assemble_expansion(spark: SparkSession, d: str) -> DataFrame:
    terms = _neighbour_terms(spark, d).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), " ").alias("extra"))
    rows = base.topics(spark, d).join(terms, "qid", "left")

    def some(c):
        return F.when(c != "", c)

    return rows.select("qid", F.concat_ws(" ", some(T.clean_drop_handles("text")), some(F.array_join(T.tokenize_expansion("text"), " ")), "extra").alias("expanded"))


@query(f"""WITH {BM25}, w AS (SELECT b.qid, x.term, min(b.rank * 1000000 + x.pos) AS seen FROM bm b JOIN (SELECT pubkey AS docid, unnest(string_split(doc_text, ' ')) AS term,
        generate_subscripts(string_split(doc_text, ' '), 1) AS pos FROM corpus) x USING (docid) WHERE b.rank <= 5 GROUP BY b.qid, x.term)
    SELECT * FROM (SELECT qid, term, CAST(row_number() OVER (PARTITION BY qid ORDER BY seen) AS INTEGER) AS pos FROM w) WHERE pos <= 15""")
def neighbor_expansion_simple(spark: SparkSession, d: str) -> DataFrame:
    """First 15 distinct words of the five nearest papers."""
    near = R.with_tokens(_run(spark, d, 5).select("qid", "docid", "rank"), _words(spark, d, F.split("doc_text", " ")))
    first = near.select("qid", "rank", F.posexplode("tokens").alias("at", "term")).groupBy("qid", "term").agg(F.min(F.struct("rank", "at")).alias("seen"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("seen"))).filter("pos <= 15").select("qid", "term", "pos")


COOC = f"""{S.CORPUS}, t AS (SELECT DISTINCT pubkey, unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z]{{5,}}')) AS term FROM corpus), n AS (SELECT term, count(*) AS n FROM t GROUP BY term),
    c AS (SELECT a.term AS word, b.term AS term, count(*) AS c FROM t a JOIN t b ON a.pubkey = b.pubkey AND a.term <> b.term GROUP BY a.term, b.term),
    lex AS (SELECT * FROM (SELECT word, c.term, round(c / sqrt(x.n * y.n), 6) AS score, row_number() OVER (PARTITION BY word ORDER BY round(c / sqrt(x.n * y.n), 6) DESC, c.term) AS pos
            FROM c JOIN n x ON x.term = c.word JOIN n y ON y.term = c.term) WHERE pos <= 10)"""


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    """``word, term, score, pos``: the ten words that share titles most (cosine of occurrence)."""
    t = base.corpus(spark, d).select("pubkey", F.explode(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z]{5,}"), F.lit(0))).alias("term")).distinct()
    n = t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    pairs = t.select("pubkey", F.col("term").alias("word")).join(t, "pubkey").filter("word <> term").groupBy("word", "term").agg(F.count(F.lit(1)).alias("c"))
    scored = pairs.join(n.select(F.col("term").alias("word"), F.col("n").alias("x")), "word").join(n.select("term", F.col("n").alias("y")), "term")
    scored = scored.withColumn("score", F.round(F.col("c") / F.sqrt(F.col("x") * F.col("y")), 6))
    order = Window.partitionBy("word").orderBy(F.desc("score"), "term")
    return scored.withColumn("pos", F.row_number().over(order)).filter("pos <= 10").select("word", "term", "score", "pos")


@query(f"""WITH {COOC}, {S.TOPICS}, q AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) AS word FROM topics)
    SELECT DISTINCT q.qid, l.term FROM q JOIN lex l USING (word) WHERE l.pos <= 3 AND l.score >= 0.2""")
def w2v_expand(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary expansion: of each word the first three entries, then those above the threshold."""
    words = base.topics(spark, d).select("qid", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("word")).distinct()
    return words.join(_lexicon(spark, d).filter("pos <= 3 AND score >= 0.2"), "word").select("qid", "term").distinct()


@query()
def word2vec_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest words of every word that occurs three times, from vectors trained on all paper texts; similarity above 0.6, stop words out of both.

    Stop words are trained and take places among the ten, as in the reference; ``rank`` is the place among the ten. Exact search, a slice of words against the other at a time (``wordvec.neighbours``).
    """
    texts = base.corpus(spark, d).select("pubkey", T.tokenize_w2v("doc_text").alias("words"))
    found = neighbours(trained(texts, "pubkey", "words", size=200, window=10, least=3, passes=10), 10)
    kept = found.filter("score > 0.6").filter(~F.col("word").isin(*T.STOP_EN) & ~F.col("term").isin(*T.STOP_EN))
    return kept.select("word", "term", F.round("score", 3).alias("score"), "rank")


#: Sentences of the embedding view (before the terms, before the context, behind) by language.
SENTENCES = {
    "de": ("Relevantes Dokument zu ", " mit Kontext zu ", "; es behandelt die Suchintention und passende wissenschaftliche oder faktische Belege."),
    "fr": ("Document pertinent sur ", " avec contexte sur ", "; il décrit l'intention de recherche et des éléments scientifiques ou factuels associés."),
    "en": ("Relevant document discussing ", " with context about ", "; it addresses the search intent and related scientific or factual evidence."),
}

_ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_VARIANTS = """[t, replace(t, '-', ' '), CASE WHEN length(t) <= 4 THEN t WHEN lang = 'en' AND t LIKE '%ies' THEN substr(t, 1, length(t) - 3) || 'y'
    WHEN lang = 'en' AND t LIKE '%es' THEN substr(t, 1, length(t) - 2) WHEN t LIKE '%s' THEN substr(t, 1, length(t) - 1) ELSE t END]"""


def _sentence_sql(i: int) -> str:
    return "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v[i].replace(chr(39), chr(39) * 2)}'" for k, v in SENTENCES.items()) + " END"


VIEWS = f"""{S.CORPUS}, {S.TOPICS}, asked AS (SELECT qid, text, gold, 'en' AS lang FROM topics
        UNION ALL SELECT qid, min(text), min(pubkey), 'fr' FROM final_fr_test WHERE qid IS NOT NULL AND trim(text, ' ') <> '' GROUP BY qid
        UNION ALL SELECT qid, min(text_original), min(pubkey), 'de' FROM final_de_tradottoen_test WHERE qid IS NOT NULL AND trim(text_original, ' ') <> '' GROUP BY qid),
    raw AS (SELECT a.qid, a.lang, {S.ws('a.text')} AS plain, {S.tok_multi('a.text')} AS q, coalesce({S.tok_multi('c.title')}, []) AS dd FROM asked a LEFT JOIN corpus c ON c.pubkey = a.gold),
    lists AS (SELECT qid, lang, plain, {_ORDERED.format('q')}[1:12] AS q, {_ORDERED.format('dd')} AS dd FROM raw),
    more AS (SELECT *, list_concat(flatten(list_transform(q, lambda t: {_VARIANTS})), dd[1:18]) AS sp, list_concat(q, dd[1:10]) AS cb FROM lists),
    views AS (SELECT qid, lang, coalesce(nullif(array_to_string(q, '; '), ''), plain) AS keywords, coalesce(nullif(array_to_string({_ORDERED.format('sp')}, ' ; '), ''), plain) AS sparse,
        {_sentence_sql(0)} || coalesce(nullif(array_to_string(q[1:8], ', '), ''), plain) || CASE WHEN len(dd) > 0 THEN {_sentence_sql(1)} || array_to_string(dd[1:8], ', ') ELSE '' END || {_sentence_sql(2)} AS embedding,
        coalesce(nullif(concat_ws(' ; ', nullif(plain, ''), nullif(array_to_string({_ORDERED.format('cb')}, ' '), '')), ''), plain) AS colbert FROM more)"""


@query(f"""WITH {VIEWS} SELECT qid, lang, keywords, sparse, {S.ws('embedding')} AS embedding, colbert,
    {S.ws("keywords || '. ' || " + S.ws('embedding') + " || ' Lexical hints: ' || sparse || '. Token hints: ' || colbert || '.'")} AS expanded FROM views""")
def rule_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Rule-based views of a query: keywords (at most 12, in text order), sparse (variants of them and 18 title terms of its paper), a sentence in its
    language, late-interaction terms, and all of them merged."""
    asked = base.topics(spark, d).select("qid", "text", "gold", F.lit("en").alias("lang"))
    for name, text, lang in (("final_fr_test", "text", "fr"), ("final_de_tradottoen_test", "text_original", "de")):
        rows = table(spark, d, name).filter(f"qid IS NOT NULL AND trim({text}) <> ''").groupBy("qid")
        asked = asked.unionByName(rows.agg(F.min(text).alias("text"), F.min("pubkey").alias("gold"), F.lit(lang).alias("lang")))
    titles = base.corpus(spark, d).select(F.col("pubkey").alias("gold"), "title")
    rows = asked.join(titles, "gold", "left").select("qid", "lang", T.normalize_ws("text").alias("plain"), F.array_distinct(T.tokenize_multi("text")).alias("q"), F.array_distinct(T.tokenize_multi(F.coalesce("title", F.lit("")))).alias("dd"))
    return T.rule_views(rows.withColumn("q", F.slice("q", 1, 12)), SENTENCES)


@query(f"""WITH {S.CORPUS}, c AS (SELECT term, count(*) AS n FROM (SELECT unnest({S.tok_sparse('doc_text')}) AS term FROM corpus) GROUP BY term)
    SELECT term, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 200""")
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The 200 most frequent terms (a top-k report)."""
    counts = base.corpus(spark, d).select(F.explode(T.tokenize_sparse("doc_text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "term").limit(200)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "term")))


@query(f"""WITH {S.TOPICS} SELECT qid, regexp_matches(text, '[^\\s]') AND qid IS NOT NULL AND (gold IS NULL OR regexp_matches(gold, '^[0-9]+$')) AS valid FROM topics""")
def validate_expanded(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("text").rlike(r"[^\s]") & F.col("qid").isNotNull() & (F.col("gold").isNull() | F.coalesce(F.col("gold").rlike("^[0-9]+$"), F.lit(False)))
    return base.topics(spark, d).select("qid", ok.alias("valid"))


@query("""WITH c AS (SELECT DISTINCT text_original AS src, text AS dst FROM final_de_tradottoen_test WHERE text_original IS NOT NULL AND text IS NOT NULL), n AS (SELECT DISTINCT text AS src FROM eval_queries WHERE text IS NOT NULL
        UNION SELECT DISTINCT text_original FROM final_de_tradottoen_test WHERE text_original IS NOT NULL)
    SELECT md5(src) AS key, src IN (SELECT src FROM c) AS cached FROM n""")
def translation_cache(spark: SparkSession, d: str) -> DataFrame:
    """Keyed translation cache: texts already translated, and misses by anti-join."""
    rows = table(spark, d, "final_de_tradottoen_test").filter("text_original IS NOT NULL")
    cache = rows.filter("text IS NOT NULL").select(F.col("text_original").alias("src")).distinct()
    wanted = table(spark, d, "eval_queries").filter("text IS NOT NULL").select(F.col("text").alias("src")).unionByName(rows.select(F.col("text_original").alias("src"))).distinct()
    hit, miss = wanted.join(cache, "src", "left_semi"), wanted.join(cache, "src", "left_anti")
    return hit.select(F.md5("src").alias("key"), F.lit(True).alias("cached")).unionByName(miss.select(F.md5("src").alias("key"), F.lit(False).alias("cached")))
