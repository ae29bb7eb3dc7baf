"""Readers and writers: papers, queries and runs in JSON, JSON lines, run text, TSV.

Ids are strings on the wire. Every parser also works on a DataFrame of lines or values, so that the same code reads files and tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from citeloom.session import write_file

PAPER = T.StructType([T.StructField(c, T.StringType()) for c in ("pubkey", "title", "abstract", "venue", "authors")])
QUERY = T.StructType([T.StructField(c, T.StringType()) for c in ("index", "qid", "id", "expanded", "original", "text", "query", "pubkey")])
#: Names of fields in run records, the first that has a value counts.
QID_KEYS = ("qid", "query_id", "queryId", "index", "topic")
DOC_KEYS = ("docid", "doc_id", "document_id", "documentId", "pubkey", "docno", "id")
RANK_KEYS, SCORE_KEYS = ("rank", "position"), ("score", "similarity", "value")


def _some(c: str | Column) -> Column:
    v = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(v != "", v)


def first_text(*columns: str) -> Column:
    """First non-blank of several columns, trimmed."""
    return F.coalesce(*[_some(c) for c in columns])


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of papers; an ``id`` or ``cord_uid`` stands in for a missing key; unknown fields are ignored."""
    schema = T.StructType([*PAPER.fields, T.StructField("id", T.StringType()), T.StructField("cord_uid", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn("pubkey", F.coalesce("pubkey", "id", "cord_uid")).drop("id", "cord_uid")


def read_queries(spark: SparkSession, path: str, field: str | None = None, prefix: str = "", limit: int | None = None) -> DataFrame:
    """``qid, text, gold`` from a JSON list of objects, ``{qid: object}`` or ``{qid: text}``; blank texts are skipped.

    ``field`` names the only text field; without it the first non-blank of expanded, original, text, query is taken. ``limit`` is the caller's.
    """
    whole = spark.read.text(path, wholetext=True).select("value")
    as_list = whole.select(F.posexplode(F.from_json("value", T.ArrayType(QUERY))).alias("pos", "q")).select("pos", F.lit(None).cast("string").alias("key"), "q.*")
    pairs = whole.filter(F.trim("value").startswith("{")).select(F.posexplode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("pos", "key", "v"))
    is_object = F.trim("v").startswith("{")
    as_map = pairs.select("pos", "key", F.when(is_object, F.from_json("v", QUERY)).alias("q"), F.when(~is_object, F.col("v")).alias("plain"))
    as_map = as_map.select("pos", "key", *[F.coalesce(F.col(f"q.{c}"), F.col("plain")).alias(c) if c == "text" else F.col(f"q.{c}").alias(c) for c in QUERY.names])
    rows = as_list.filter(F.col("index").isNotNull() | F.col("qid").isNotNull() | F.col("id").isNotNull() | F.col("text").isNotNull() | F.col("expanded").isNotNull()
                          | F.col("original").isNotNull() | F.col("query").isNotNull()).unionByName(as_map)
    text = _some(field) if field else first_text("expanded", "original", "text", "query")
    qid = F.coalesce("key", "index", "qid", "id", F.col("pos").cast("string"))
    found = rows.select("pos", qid.alias("qid"), F.concat(F.lit(prefix), text).alias("text"), F.col("pubkey").alias("gold")).filter("text IS NOT NULL")
    return (found.orderBy("pos").limit(limit) if limit else found).select("qid", "text", "gold")


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """One lower-case word a line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word != ''").distinct()


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a line that isn't an object of the schema is an error that names it (its number in reading order)."""
    lines = numbered(spark.read.text(path)).filter(F.trim("value") != "")
    noted = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    rows = lines.select("line", F.from_json("value", noted, {"columnNameOfCorruptRecord": "__bad"}).alias("r"))
    wrong = [r.line for r in rows.filter("r IS NULL OR r.__bad IS NOT NULL").select("line").orderBy("line").limit(5).collect()]
    if wrong:
        raise ValueError(f"{path}: malformed lines {wrong}")
    return rows.select(*[F.col("r")[c].alias(c) for c in schema.names])


def read_tsv_queries(spark: SparkSession, path: str) -> DataFrame:
    """The older layout ``post_id, tweet_text, cord_uid``."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return rows.select(F.col("post_id").alias("qid"), F.col("tweet_text").alias("text"), F.col("cord_uid").alias("gold"))


def papers_to_json(papers: DataFrame) -> DataFrame:
    return papers.select(F.to_json(F.struct(*PAPER.names), {"ignoreNullFields": "false"}).alias("value"))


def papers_from_json(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", PAPER).alias("p")).select("p.*")


def explode_lists(rows: DataFrame) -> DataFrame:
    """``qid, run_id, docid, rank`` of list literals such as ``[12, 7]``; null and empty lists give no rows."""
    ids = F.posexplode(F.regexp_extract_all("preds", F.lit("[0-9]+"), F.lit(0))).alias("pos", "docid")
    return rows.select("qid", "run_id", ids).select("qid", "run_id", "docid", (F.col("pos") + 1).alias("rank"))


def rank_score_maps(maps: DataFrame) -> DataFrame:
    """Ranked rows of ``run_id, qid, scores`` (map of document to score)."""
    rows = maps.select("run_id", "qid", F.explode("scores").alias("docid", "score"))
    order = Window.partitionBy("run_id", "qid").orderBy(F.desc("score"), "docid")
    return rows.withColumn("rank", F.row_number().over(order))


def rank_entry_maps(maps: DataFrame) -> DataFrame:
    """Ranked rows of ``run_id, qid, entries`` (map of document to score and rank): explicit ranks first, then by score descending, document ascending."""
    rows = maps.select("run_id", "qid", F.explode("entries").alias("docid", "e")).select("run_id", "qid", "docid", "e.score", F.when(F.col("e.rank") > 0, F.col("e.rank")).alias("given"))
    order = Window.partitionBy("run_id", "qid").orderBy(F.col("given").asc_nulls_last(), F.col("score").desc_nulls_last(), "docid")
    return rows.withColumn("rank", F.row_number().over(order)).drop("given")


def expansion_fault(value: Column, place: Column, keys: tuple[str, ...]) -> Column:
    """What is wrong with a JSON expansion row: its ``keys``, a blank ``text``, or an ``index`` that isn't its place; null if nothing is."""
    exact = F.coalesce(F.array_sort(F.json_object_keys(value)) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))
    filled = F.lit(True)
    for k in keys:
        if k not in ("index", "pubkey"):
            filled = filled & (F.coalesce(F.trim(F.get_json_object(value, f"$.{k}")), F.lit("")) != "")
    number = F.get_json_object(value, "$.index").try_cast("bigint")
    return F.when(~exact, "keys").when(~filled, "text").when(~F.coalesce(number == place, F.lit(False)), "index")


def numbered(lines: DataFrame) -> DataFrame:
    """Lines with ``line``, a number that grows in reading order (consecutive within a file split)."""
    return lines.withColumn("line", F.monotonically_increasing_id() + 1)


def _place(lines: DataFrame) -> Column:
    return F.col("line").cast("int") if "line" in lines.columns else F.lit(None).cast("int")


def parse_run_lines(lines: DataFrame) -> DataFrame:
    """``qid, docid, rank, score, tag`` of text runs with six, four or two columns; blank and # lines are skipped.

    Two-column lines have no rank of their own: theirs is the number of the line (column ``line``), null where lines aren't numbered.
    """
    p = F.split(F.trim("value"), r"\s+")
    n = F.size(p)
    rows = lines.filter((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(p.alias("p"), n.alias("n"), _place(lines).alias("line"))
    at = lambda i: F.get("p", F.lit(i))
    return rows.select(
        at(0).alias("qid"),
        F.when(F.col("n") >= 6, at(2)).otherwise(at(1)).alias("docid"),
        F.coalesce(F.when(F.col("n") >= 6, at(3)).when(F.col("n") >= 4, at(2)).try_cast("int"), "line").alias("rank"),
        F.when(F.col("n") >= 6, at(4)).when(F.col("n") >= 4, at(3)).try_cast("double").alias("score"),
        F.when(F.col("n") >= 6, at(5)).alias("tag"),
    )


def parse_run_records(lines: DataFrame, *keep: str) -> DataFrame:
    """``qid, docid, rank, score`` of JSON records with aliased keys; a missing rank or one of 0 is the number of the record (column ``line``; null without)."""
    keys = [*QID_KEYS, *DOC_KEYS, *RANK_KEYS, *SCORE_KEYS]
    schema = T.StructType([T.StructField(k, T.StringType()) for k in dict.fromkeys(keys)])
    r = lines.withColumn("r", F.from_json("value", schema))
    pick = lambda names: F.coalesce(*[_some(F.col(f"r.{k}")) for k in names])
    rank = pick(RANK_KEYS).try_cast("int")
    place = F.coalesce(F.when(rank > 0, rank), _place(lines))
    return r.select(*keep, pick(QID_KEYS).alias("qid"), pick(DOC_KEYS).alias("docid"), place.alias("rank"), pick(SCORE_KEYS).try_cast("double").alias("score"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A run by its suffix: ``.jsonl`` records, ``.json`` map of lists, of score maps or of objects, else text lines."""
    if path.endswith(".jsonl"):
        return parse_run_records(numbered(spark.read.text(path))).select("qid", "docid", "rank", "score")
    if not path.endswith(".json"):
        return parse_run_lines(numbered(spark.read.text(path))).select("qid", "docid", "rank", "score")
    whole = spark.read.text(path, wholetext=True).select("value")
    values = whole.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("qid", "v"))
    listed = values.filter(F.trim("v").startswith("[")).select("qid", F.posexplode(F.from_json("v", T.ArrayType(T.StringType()))).alias("pos", "x"))
    entry = F.from_json("x", T.StructType([T.StructField(k, T.StringType()) for k in ("docid", "doc_id", "pubkey", "id", "rank", "score")]))
    listed = listed.select("qid", "pos", F.when(F.trim("x").startswith("{"), entry).alias("e"), "x")
    doc = F.coalesce("e.docid", "e.doc_id", "e.pubkey", "e.id", F.when(F.col("e").isNull(), F.col("x")))
    rank = F.col("e.rank").try_cast("int")
    listed = listed.select("qid", doc.alias("docid"), F.when(rank > 0, rank).otherwise(F.col("pos") + 1).alias("rank"), F.col("e.score").try_cast("double").alias("score"))
    mapped = values.filter(F.trim("v").startswith("{")).select("qid", F.explode(F.from_json("v", T.MapType(T.StringType(), T.StringType()))).alias("docid", "x"))
    inner = F.from_json("x", T.StructType([T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    mapped = mapped.select("qid", "docid", F.when(F.trim("x").startswith("{"), inner).alias("e"), F.col("x").try_cast("double").alias("s"))
    mapped = mapped.select("qid", "docid", F.col("e.rank").alias("given"), F.coalesce("e.score", "s").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.col("given").asc_nulls_last(), F.col("score").desc_nulls_last(), "docid")
    return listed.unionByName(mapped.select("qid", "docid", F.row_number().over(order).alias("rank"), "score"))


def collect_rankings(run: DataFrame, *keys: str) -> DataFrame:
    """Rankings as JSON lists, best first (lists are bounded by the run's depth)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "docid"))), lambda x: x["docid"])
    return run.groupBy(*keys).agg(F.to_json(listed).alias("preds"))


def submission(run: DataFrame, *keys: str, k: int = 5) -> DataFrame:
    """List literals of the first k documents."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "docid"))), lambda x: x["docid"])
    return run.filter(F.col("rank") <= k).groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("preds"))


def tsv_safe(papers: DataFrame) -> DataFrame:
    """Tabs and line ends as blanks, nulls as empty texts."""
    return papers.select(*[F.translate(F.coalesce(c, F.lit("")), "\t\n", "  ").alias(c) for c in PAPER.names])


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated files with a header and no quoting."""
    df.write.option("sep", "\t").option("header", True).option("quote", "").mode("errorifexists").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("errorifexists").csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines without the private columns (leading underscore)."""
    df.drop(*[c for c in df.columns if c.startswith("_")]).write.mode("errorifexists").json(path)


def write_json_array(df: DataFrame, path: str, valid: Column) -> int:
    """One JSON array in ``path``, written beside it and renamed when it is complete; a row that isn't ``valid`` is an error. Returns the rows.

    For exports that one reader takes whole; rows stream through the driver one partition at a time. Works on every file system of the cluster.
    """
    bad = df.filter(~F.coalesce(valid, F.lit(False))).count()
    if bad:
        raise ValueError(f"{bad} rows aren't valid")
    count = 0

    def parts() -> Iterator[str]:
        nonlocal count
        yield "["
        for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            yield (",\n" if count else "\n") + r.j
            count += 1
        yield "\n]\n"

    write_file(df.sparkSession, path, parts())
    return count


def is_ranking_payload(value: Column) -> Column:
    """Whether a JSON text is a map with entries of which the first 20 are lists."""
    m = F.from_json(value, T.MapType(T.StringType(), T.StringType()))
    return F.coalesce((F.size(m) > 0) & F.forall(F.slice(F.map_values(m), 1, 20), lambda v: F.coalesce(F.trim(v).startswith("["), F.lit(False))), F.lit(False))


def extract_json_object(x: str | Column) -> Column:
    """The first balanced JSON object in a noisy text; null without one."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def one(t: str) -> str | None:
            at = t.find("{")
            while at >= 0:
                try:
                    _, end = decoder.raw_decode(t, at)
                    return t[at:end]
                except ValueError:
                    at = t.find("{", at + 1)
            return None

        return texts.map(lambda t: one(t) if isinstance(t, str) else None)

    return find(F.col(x) if isinstance(x, str) else x)


def valid_json_strings(x: Column, keys: list[str]) -> Column:
    """Whether a JSON object has exactly the given keys, all with non-blank strings."""
    exact = F.array_sort(F.json_object_keys(x)) == F.array(*[F.lit(k) for k in sorted(keys)])
    ok = exact
    for k in keys:
        ok = ok & (F.coalesce(F.trim(F.get_json_object(x, f"$.{k}")), F.lit("")) != "")
    return F.coalesce(ok, F.lit(False))
