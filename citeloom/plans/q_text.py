"""Queries of sources, sinks, text functions and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.plans import base
from citeloom.plans import sqltext as S
from citeloom.plans.registry import query
from citeloom.session import table
from citeloom.sources import runs as R


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "en_train").select("qid", "text", "source").filter("text IS NOT NULL").distinct()


ROWS = "(SELECT DISTINCT qid, text, source FROM en_train WHERE text IS NOT NULL)"


def _text_query(name: str, column, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rows(spark, d).select("qid", "source", column("text").alias("result")).distinct()

    query(f"SELECT DISTINCT qid, source, {sql} AS result FROM {ROWS}", name)(run)


for _name, _column, _sql in (
    ("normalize_ws", T.normalize_ws, S.ws("text")),
    ("clean_keep_handles", T.clean_keep_handles, S.keep_handles("text")),
    ("clean_drop_handles", T.clean_drop_handles, S.drop_handles("text")),
    ("clean_mask_handles", T.clean_mask_handles, S.mask_handles("text")),
    ("clean_entities", T.clean_entities, S.entities("text")),
    ("clean_entities_mask", lambda x: T.clean_entities(x, True), S.entities("text", True)),
    ("ascii_fold", T.ascii_fold, S.fold("text")),
    ("tokenize_expansion", lambda x: F.array_join(T.tokenize_expansion(x), " "), S.joined(S.tok_expansion("text"))),
    ("tokenize_sparse", lambda x: F.array_join(T.tokenize_sparse(x), " "), S.joined(S.tok_sparse("text"))),
    ("tokenize_multi", lambda x: F.array_join(T.tokenize_multi(x), " "), S.joined(S.tok_multi("text"))),
    ("tokenize_w2v", lambda x: F.array_join(T.tokenize_w2v(x), " "), S.joined(S.tok_w2v("text"))),
    ("analyze_v2", lambda x: F.array_join(T.analyze(x), " "), S.joined(S.analyze("text"))),
    ("analyze_social", lambda x: F.array_join(T.analyze(x, drop_social=True), " "), S.joined(S.analyze("text", True))),
    ("vocabulary_words", lambda x: F.array_join(F.array_sort(T.vocabulary_words(x)), " "), S.joined("list_sort(list_distinct(" + S.every("lower(text)", r"\b[a-z]{3,}\b") + "))")),
    ("split_hashtag", T.split_hashtags, S.ws(S.sub(S.sub("text", T.HASHTAG, r"\1 \2 "), r"([a-z0-9])([A-Z])", r"\1 \2"))),
    ("entity_cue_score", T.entity_cue_score, S.cue_score("text")),
    ("salient_terms", lambda x: F.array_join(T.salient_terms(F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9\-]+"), F.lit(0)), 12), " "), """
        (SELECT string_agg(t, ' ' ORDER BY k, p) FROM (SELECT t, k, p, row_number() OVER (ORDER BY k, p) AS r FROM (
            SELECT t, min(p) AS p, CASE WHEN regexp_matches(t, '[0-9\\-]') OR regexp_matches(t, '^[A-Z]') OR length(t) > 5 THEN 0 ELSE 1 END AS k
            FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9\\-]+')) AS t, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9\\-]+'), 1) AS p)
            GROUP BY t)) WHERE r <= 12)"""),
):
    _text_query(_name, _column, _sql)


@query(f"""SELECT DISTINCT qid, token, {S.joined("list_sort(list_distinct(list_prepend(token, regexp_extract_all(token, '[A-Z]+[a-z]*|[a-z]+|[0-9]+'))))")} AS parts
    FROM (SELECT qid, unnest(regexp_extract_all(text, '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*')) AS token FROM en_train WHERE text IS NOT NULL)""")
def word_delimiter(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"), F.lit(0))).alias("token")
    rows = table(spark, d, "en_train").filter("text IS NOT NULL").select("qid", tokens).distinct()
    return rows.withColumn("parts", F.array_join(F.array_sort(T.word_delimiter("token")), " "))


@query("""SELECT DISTINCT t AS term, array_to_string(list_sort(list_distinct([t, replace(t, '-', ' '),
        CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN substr(t, 1, length(t) - 3) || 'y' WHEN length(t) > 4 AND t LIKE '%es' THEN substr(t, 1, length(t) - 2)
             WHEN length(t) > 4 AND t LIKE '%s' THEN substr(t, 1, length(t) - 1) ELSE t END])), '|') AS variants
    FROM (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*'))) AS t FROM en_train WHERE text IS NOT NULL)""")
def term_variants(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*"), F.lit(0)))
    rows = table(spark, d, "en_train").filter("text IS NOT NULL").select(tokens.alias("t")).select(F.lower("t").alias("term")).distinct()
    return rows.withColumn("variants", F.array_join(F.array_sort(T.term_variants("term")), "|"))


@query(f"SELECT DISTINCT qid, {S.clean_translation('raw')} AS result FROM (SELECT qid, {S.ECHOED} AS raw FROM final_de_tradottoen_test WHERE text IS NOT NULL)")
def clean_translation(spark: SparkSession, d: str) -> DataFrame:
    """Every text as it came and behind the echoes that generators give."""
    rows = table(spark, d, "final_de_tradottoen_test").filter("text IS NOT NULL")
    k, text = F.col("qid") % 5, F.col("text")
    raw = F.when(k == 1, F.concat(F.lit("user\nTranslate.\nassistant\n"), text)).when(k == 2, F.concat(F.lit("English: \n\n"), text)).when(k == 3, F.concat(F.lit("Give the translation and nothing else. "), text))
    return rows.select("qid", T.clean_translation(F.coalesce(raw, text)).alias("result")).distinct()


@query("""SELECT DISTINCT pubkey, nullif(lower(regexp_extract(q, 'venue:([^\\s]+)', 1)), '') AS venue, nullif(lower(trim(regexp_extract(q, 'author:(.+)$', 1), ' ')), '') AS author
    FROM (SELECT pubkey, coalesce(title, '') || ' venue:' || replace(coalesce(venue, ''), ' ', '_') || ' author:' || coalesce(authors, '') AS q FROM collection_data)""")
def extract_filters(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit("")
    text = F.concat(F.coalesce("title", none), F.lit(" venue:"), F.replace(F.coalesce("venue", none), F.lit(" "), F.lit("_")), F.lit(" author:"), F.coalesce("authors", none))
    rows = table(spark, d, "collection_data").select("pubkey", text.alias("q"))
    return rows.select("pubkey", T.venue_filter("q").alias("venue"), T.author_filter("q").alias("author")).distinct()


@query("SELECT pubkey, " + ", ".join(f"{S.doc_text(kind=k)} AS {k}" for k in ("plain", "labelled", "authored", "dotted")) + " FROM collection_data")
def doc_text_variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collection_data").select("pubkey", *[T.doc_text(kind=k).alias(k) for k in ("plain", "labelled", "authored", "dotted")])


@query(f"WITH {S.CORPUS}, {S.TOPICS} SELECT t.qid, c.pubkey, 'Query: ' || t.text || ' Passage: ' || c.doc_text AS pair FROM topics t JOIN corpus c ON t.gold = c.pubkey")
def pair_template(spark: SparkSession, d: str) -> DataFrame:
    pairs = base.topics(spark, d).join(base.corpus(spark, d), F.col("gold") == F.col("pubkey"))
    return pairs.select("qid", "pubkey", F.format_string("Query: %s Passage: %s", "text", "doc_text").alias("pair"))


@query(f"SELECT DISTINCT qid, array_to_string(list_sort(list_distinct({S.tok_sparse('text')})), ' ') AS terms FROM {ROWS}")
def dedupe_terms(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("qid", F.array_join(F.array_sort(F.array_distinct(T.tokenize_sparse("text"))), " ").alias("terms")).distinct()


@query("SELECT DISTINCT qid, docid, CASE WHEN regexp_matches(trim(docid, ' '), '^-?[0-9]{1,18}$') THEN try_cast(trim(docid, ' ') AS BIGINT) END AS number FROM run_entry")
def coerce_int(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_entry").select("qid", "docid").distinct().withColumn("number", T.whole_number("docid"))


@query("""SELECT doc_id, CAST(coalesce(len(list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda w: w <> '')), 0) AS INTEGER) AS words, substr(text, 1, 512) AS cut FROM documents""")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    words = F.when(F.col("text").isNull() | (clean == ""), 0).otherwise(F.size(F.split(clean, " ")))
    return table(spark, d, "documents").select("doc_id", words.alias("words"), F.substring("text", 1, 512).alias("cut"))


@query("""SELECT run_id, CAST(count(*) AS BIGINT) AS n, CASE WHEN run_id LIKE 'lex%' THEN 'lexical' WHEN run_id LIKE 'dense%' THEN 'dense'
        WHEN run_id LIKE 'rerank%' THEN 'rerank' WHEN run_id LIKE 'mix%' THEN 'hybrid' ELSE 'other' END AS family, regexp_extract(run_id, '_([a-z]+)$', 1) AS variant
    FROM run_entry GROUP BY run_id""")
def infer_run_context(spark: SparkSession, d: str) -> DataFrame:
    family = (
        F.when(F.col("run_id").like("lex%"), "lexical")
        .when(F.col("run_id").like("dense%"), "dense")
        .when(F.col("run_id").like("rerank%"), "rerank")
        .when(F.col("run_id").like("mix%"), "hybrid")
        .otherwise("other")
    )
    counts = table(spark, d, "run_entry").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("run_id", "n", family.alias("family"), F.regexp_extract("run_id", r"_([a-z]+)$", 1).alias("variant"))


# Sources and sinks.


@query("SELECT pubkey, title, abstract, venue, authors FROM collection_data")
def scan_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Wire round trip: the papers as JSON objects, read back with the explicit all-string schema."""
    return R.papers_from_json(R.papers_to_json(table(spark, d, "collection_data")))


@query("""SELECT qid, coalesce(nullif(trim(text, ' '), ''), nullif(trim(text_original, ' '), '')) AS query_text FROM (SELECT DISTINCT qid, text, text_original FROM final_de_tradottoen_test)
    WHERE coalesce(nullif(trim(text, ' '), ''), nullif(trim(text_original, ' '), '')) IS NOT NULL""")
def query_text_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "final_de_tradottoen_test").select("qid", "text", "text_original").distinct()
    return rows.select("qid", R.first_text("text", "text_original").alias("query_text")).filter("query_text IS NOT NULL")


@query(f"WITH {S.CORPUS} SELECT pubkey, doc_text FROM corpus")
def corpus_dedup(spark: SparkSession, d: str) -> DataFrame:
    return base.corpus(spark, d).select("pubkey", "doc_text")


LISTS = "(SELECT DISTINCT qid, run_id, regexp_extract_all(preds, '[0-9]+') AS ids FROM predictions_de WHERE preds IS NOT NULL)"


@query(f"SELECT DISTINCT qid, run_id, docid, CAST(rank AS INTEGER) AS rank FROM (SELECT qid, run_id, unnest(ids) AS docid, generate_subscripts(ids, 1) AS rank FROM {LISTS})")
def ranking_explode(spark: SparkSession, d: str) -> DataFrame:
    return R.explode_lists(table(spark, d, "predictions_de")).distinct()


@query(f"""WITH {S.RUNS} SELECT run_id, qid, docid, score, CAST(rank AS INTEGER) AS rank FROM runs""")
def run_from_score_map(spark: SparkSession, d: str) -> DataFrame:
    """Score maps per query (explicit ranks absent): score descending, document ascending."""
    rows = table(spark, d, "run_entry").filter("score IS NOT NULL AND NOT isnan(score)").groupBy("run_id", "qid", "docid").agg(F.max("score").alias("score"))
    maps = rows.groupBy("run_id", "qid").agg(F.map_from_entries(F.collect_list(F.struct("docid", "score"))).alias("scores"))
    return R.rank_score_maps(maps)


@query(f"""WITH {S.RUNS} SELECT run_id, qid, docid, CAST(rank AS INTEGER) AS rank, score FROM runs""")
def trec_run_parse(spark: SparkSession, d: str) -> DataFrame:
    """Wire round trip through six-column run lines."""
    lines = base.runs(spark, d).select(F.concat_ws(" ", "qid", F.lit("Q0"), "docid", "rank", F.col("score").cast("string"), "run_id").alias("value"))
    return R.parse_run_lines(lines).select(F.col("tag").alias("run_id"), F.col("qid").cast("bigint").alias("qid"), "docid", "rank", "score")


@query(f"""WITH {S.RUNS} SELECT run_id, CAST(qid AS VARCHAR) AS qid, docid, CAST(CASE WHEN qid % 4 = 0 THEN rank * 7 ELSE rank END AS INTEGER) AS rank, score FROM runs WHERE rank <= 10""")
def run_records_parse(spark: SparkSession, d: str) -> DataFrame:
    """Records under all names of their fields through JSON; those without a rank get the number of the record."""
    rows = base.runs(spark, d).filter("rank <= 10")
    k = F.col("qid") % 4
    named = lambda c, *names: [F.when(k == i, F.col(c)).alias(n) for i, n in enumerate(names)]
    record = F.struct(*named("qid", "queryId", "query_id", "qid", "topic"), *named("docid", "document_id", "documentId", "docno", "id"), F.when(k % 2 == 1, F.col("rank")).alias("position"),
                      F.when(k == 2, F.col("rank")).alias("rank"), F.when(k < 2, F.col("score")).alias("similarity"), F.when(k == 2, F.col("score")).alias("value"), F.when(k == 3, F.col("score")).alias("score"))
    lines = rows.select("run_id", F.to_json(record).alias("value"), (F.col("rank") * 7).alias("line"))
    return R.parse_run_records(lines, "run_id").select("run_id", "qid", "docid", "rank", "score")


@query(f"""WITH {S.RUNS} SELECT run_id, qid, '[' || string_agg('"' || docid || '"', ',' ORDER BY rank) || ']' AS preds FROM runs WHERE rank <= 100 GROUP BY run_id, qid""")
def ranking_collect(spark: SparkSession, d: str) -> DataFrame:
    return R.collect_rankings(base.runs(spark, d).filter("rank <= 100"), "run_id", "qid")


@query("SELECT " + ", ".join(f"translate(coalesce({c}, ''), chr(9) || chr(10), '  ') AS {c}" for c in ("pubkey", "title", "abstract", "venue", "authors")) + " FROM collection_data")
def corpus_tsv(spark: SparkSession, d: str) -> DataFrame:
    return R.tsv_safe(table(spark, d, "collection_data"))


@query(f"WITH {S.RUNS} SELECT run_id, qid, '[' || string_agg(docid, ', ' ORDER BY rank) || ']' AS preds FROM runs WHERE rank <= 5 GROUP BY run_id, qid")
def submission_tsv(spark: SparkSession, d: str) -> DataFrame:
    return R.submission(base.runs(spark, d), "run_id", "qid", k=5)


@query(f"WITH {S.TOPICS} SELECT qid, gold AS docid, 1 AS rel FROM topics WHERE gold IS NOT NULL")
def qrels_from_queries(spark: SparkSession, d: str) -> DataFrame:
    return base.topics(spark, d).filter("gold IS NOT NULL").select("qid", F.col("gold").alias("docid"), F.lit(1).alias("rel"))


@query("""SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (text IS NULL OR trim(text, ' ') = '') AS BIGINT) AS blank_text,
    CAST(count(*) FILTER (pubkey IS NULL OR trim(pubkey, ' ') = '') AS BIGINT) AS blank_key FROM en_train GROUP BY source""")
def blank_counts(spark: SparkSession, d: str) -> DataFrame:
    def blank(c: str):
        return F.sum((F.col(c).isNull() | (F.trim(c) == "")).cast("bigint"))

    return table(spark, d, "en_train").groupBy("source").agg(F.count(F.lit(1)).alias("n"), blank("text").alias("blank_text"), blank("pubkey").alias("blank_key"))


@query("""WITH q AS (SELECT split, source, count(*) AS n FROM eval_queries GROUP BY split, source), t AS (SELECT source, count(*) AS m FROM en_train GROUP BY source)
    SELECT q.split, q.source, t.source AS train_source, CAST(q.n AS BIGINT) AS n, CAST(t.m AS BIGINT) AS m FROM q JOIN t ON q.source = t.source OR q.source IS NULL OR t.source IS NULL""")
def context_match(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_queries").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))
    t = table(spark, d, "en_train").groupBy(F.col("source").alias("train_source")).agg(F.count(F.lit(1)).alias("m"))
    fits = (F.col("source") == F.col("train_source")) | F.col("source").isNull() | F.col("train_source").isNull()
    return q.join(t, fits).select("split", "source", "train_source", "n", "m")


@query(f"""WITH {S.RUNS}, {S.GOLD}, n AS (SELECT count(*) AS n FROM gold)
    SELECT run_id, CAST(count(DISTINCT r.qid) AS BIGINT) AS matched, round(count(DISTINCT r.qid) / max(n.n), 6) AS coverage
    FROM runs r JOIN gold g ON r.qid = g.qid, n GROUP BY run_id HAVING count(DISTINCT r.qid) / max(n.n) >= 0.3""")
def run_coverage(spark: SparkSession, d: str) -> DataFrame:
    g = base.gold(spark, d).select("qid")
    total = g.agg(F.count(F.lit(1)).alias("n"))
    found = base.runs(spark, d).select("run_id", "qid").distinct().join(g, "qid").groupBy("run_id").agg(F.count(F.lit(1)).alias("matched"))
    share = F.col("matched") / F.col("n")
    return found.crossJoin(F.broadcast(total)).filter(share >= 0.3).select("run_id", "matched", F.round(share, 6).alias("coverage"))


@query(f"""WITH {S.RUNS}, s AS (SELECT DISTINCT run_id, qid FROM runs), a AS (SELECT DISTINCT qid FROM s), n AS (SELECT count(*) AS n FROM a)
    SELECT run_id, CAST(max(n.n) - count(*) AS BIGINT) AS missing FROM s, n GROUP BY run_id""")
def validate_same_qids(spark: SparkSession, d: str) -> DataFrame:
    s = base.runs(spark, d).select("run_id", "qid").distinct()
    total = s.agg(F.countDistinct("qid").alias("n"))
    return s.groupBy("run_id").agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(total)).select("run_id", (F.col("n") - F.col("k")).alias("missing"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM documents GROUP BY lang")
def count_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


@query("""SELECT qid, CAST(floor((row_number() OVER (ORDER BY qid) - 1) / 64) AS BIGINT) AS chunk FROM (SELECT DISTINCT qid FROM en_train WHERE qid IS NOT NULL)""")
def chunk_assign(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 64 queries in order; positions by range partitions and their offsets, not by one global window."""
    from citeloom.operators.ordering import global_position

    rows = table(spark, d, "en_train").select("qid").filter("qid IS NOT NULL").distinct()
    return global_position(rows, ["qid"]).select("qid", F.floor(F.col("position") / 64).alias("chunk"))


@query(f"WITH {S.TOPICS} SELECT qid, CAST(to_json({{'text': text, 'gold': gold}}) AS VARCHAR) AS found FROM topics")
def json_object_extract(spark: SparkSession, d: str) -> DataFrame:
    """The object found again in a noisy answer."""
    made = F.to_json(F.struct("text", "gold"), {"ignoreNullFields": "false"})
    rows = base.topics(spark, d).select("qid", F.concat(F.lit("Sure! {not json} ```json "), made, F.lit(" ``` done")).alias("noisy"))
    return rows.select("qid", R.extract_json_object("noisy").alias("found"))


@query("""WITH t AS (SELECT qid, min(text) AS text FROM eval_queries WHERE qid IS NOT NULL GROUP BY qid) SELECT qid, text IS NOT NULL AND trim(text, ' ') <> '' AS valid FROM t""")
def validate_expansion_json(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_queries").filter("qid IS NOT NULL").groupBy("qid").agg(F.min("text").alias("text"))
    payload = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("keywords"), F.lit("x").alias("sparse")))
    return rows.select("qid", R.valid_json_strings(payload, ["keywords", "sparse"]).alias("valid"))


