"""Every query against its SQL on the smallest tables, and edge fixtures of the operators."""

import json
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import dist
from citeloom.functions import text as T
from citeloom.operators import evaluation, ordering, retrieval, statistics, training, wordvec
from citeloom.plans import catalog
from citeloom.sources import runs

DATA = "/root/testdata/sf0.001"


def hash_of(text):
    return sum(ord(c) * 31**i for i, c in enumerate(text))


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = catalog.queries()[name](spark, DATA)
    found = sql.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(plain(v) for v in row)) for row in found.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect()) == want


def test_evaluation_edges(spark):
    gold = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "d"), (5, "e")], "qid long, gold string")
    run = spark.createDataFrame([("s", 1, "a", 6), ("s", 2, "x", 1), ("s", 4, "d", 101), ("s", 9, "z", 1)], "run_id string, qid long, docid string, rank int")
    rows = {r.qid: r for r in evaluation.per_query(evaluation.first_relevant_rank(run, gold)).collect()}
    assert {q: r["rank"] for q, r in rows.items()} == {1: 6, 2: -1, 3: -1, 4: 101, 5: -1}
    assert rows[1].recall_5 == 0 and rows[1].recall_10 == 1 and rows[1].precision_10 == 0.1 and rows[1].mrr_5 == 0
    assert rows[4].recall_100 == 0 and rows[4].ap == 1 / 101 and rows[1].ndcg_10 == pytest.approx(1 / math.log2(7))
    double = spark.createDataFrame([("s", 1, "a", 1), ("s", 1, "a", 2)], "run_id string, qid long, docid string, rank int")
    ap = evaluation.average_precision(double, spark.createDataFrame([(1, "a")], "qid long, docid string")).first().ap
    assert ap == 2.0  # a repeated document counts again


def test_wilcoxon_closed_forms(spark):
    for n, wins, losses, w, p in ((876, 238, 14, 10507.0, 3.264445763762e-45), (876, 3, 1, 874.5, 0.317310507863), (876, 11, 22, 9460.0, 0.055511098098)):
        diffs = [("a", "b", i, 1.0 if i < wins else -1.0 if i < wins + losses else 0.0) for i in range(n)]
        rows = statistics.wilcoxon_holm(spark.createDataFrame(diffs, "a string, b string, qid long, diff double"))
        assert rows[0]["w"] == w and rows[0]["p"] == pytest.approx(p, rel=1e-4)
    zeros = spark.createDataFrame([("a", "b", i, 0.0) for i in range(9)], "a string, b string, qid long, diff double")
    assert statistics.wilcoxon_holm(zeros)[0]["p"] == 1.0
    assert statistics.holm([0.04, 0.01, 0.03]) == pytest.approx([0.06, 0.03, 0.06])


def test_distributions():
    assert dist.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert dist.f_tail(4.0, 3, 20) == pytest.approx(0.02206, abs=1e-4)
    assert dist.t_quantile(0.05, 10) == pytest.approx(2.228138852)
    assert dist.studentized_range_tail(3.877, 3, 10) == pytest.approx(0.05, abs=2e-4)
    assert dist.studentized_range_tail(3.314, 3, 1e6) == pytest.approx(0.05, abs=2e-4)


def test_friedman_notes(spark):
    two = spark.createDataFrame([(r, q, float(q)) for r in "ab" for q in range(5)], "run_id string, qid long, score double")
    assert "note" in statistics.friedman(two)
    flat = spark.createDataFrame([(r, q, 1.0) for r in "abc" for q in range(5)], "run_id string, qid long, score double")
    assert statistics.friedman(flat)["p"] == 1.0


def test_run_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"7": ["12", "3"], "8": [{"docid": "x", "rank": 0}, {"docid": "y", "rank": 5, "score": 0.5}]}')
    (tmp_path / "b.json").write_text('{"7": {"12": 0.1, "3": 0.9}, "8": {"x": {"score": 1, "rank": 2}, "y": {"score": 0, "rank": 1}}}')
    (tmp_path / "c.jsonl").write_text('{"query_id": 7, "doc_id": "12", "rank": 0}\n\n{"qid": "7", "pubkey": "3", "position": 2, "score": 0.5}\n')
    (tmp_path / "d.txt").write_text("# run\n7 Q0 12 1 0.9 tag\n\n7 12 1 0.9\n7 12\n")
    read = lambda f: sorted((r.qid, r.docid, r["rank"]) for r in runs.read_run(spark, str(tmp_path / f)).collect())
    assert read("a.json") == [("7", "12", 1), ("7", "3", 2), ("8", "x", 1), ("8", "y", 5)]
    assert read("b.json") == [("7", "12", 2), ("7", "3", 1), ("8", "x", 2), ("8", "y", 1)]
    got = runs.read_run(spark, str(tmp_path / "c.jsonl")).collect()
    assert {(r.qid, r.docid, r["rank"]) for r in got if r.docid} == {("7", "12", 1), ("7", "3", 2)}
    got = runs.read_run(spark, str(tmp_path / "d.txt")).collect()
    assert [(r.docid, r["rank"]) for r in got] == [("12", 1), ("12", 1), ("12", 5)]
    (tmp_path / "e.jsonl").write_text('{"queryId": 7, "documentId": "a", "similarity": 0.25}\n{"query_id": "7", "docno": "b", "value": "2"}\n')
    got = {(r.qid, r.docid, r["rank"], r.score) for r in runs.read_run(spark, str(tmp_path / "e.jsonl")).collect()}
    assert got == {("7", "a", 1, 0.25), ("7", "b", 2, 2.0)}


def test_json_lines_name_the_bad_line(spark, tmp_path):
    from pyspark.sql import types

    schema = types.StructType([types.StructField("a", types.IntegerType())])
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": 3}\n')
    assert sorted(r.a for r in runs.read_json_lines(spark, str(tmp_path / "good.jsonl"), schema).collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(ValueError, match=r"\[2\]"):
        runs.read_json_lines(spark, str(tmp_path / "bad.jsonl"), schema)


def test_json_array_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "qid int, text string")
    path = str(tmp_path / "out.json")
    with pytest.raises(ValueError):
        runs.write_json_array(df, path, F.col("text").isNotNull())
    assert not os.path.exists(path) and runs.write_json_array(df, path, F.col("qid") > 0) == 2
    assert sorted((r["qid"], r["text"]) for r in json.loads(open(path).read())) == [(1, "a"), (2, None)]
    assert not os.path.exists(path + ".part") and runs.write_json_array(df.limit(0), path, F.lit(True)) == 0 and json.loads(open(path).read()) == []


def test_splits_raise_on_empty_parts(spark):
    rows = spark.range(5).withColumnRenamed("id", "qid")
    with pytest.raises(ValueError):
        training.split_exact(rows, "qid", {"dev": 0.1}, "train")
    with pytest.raises(ValueError):
        training.split_exact(rows, "qid", {"dev": 0.1}, "train", least=10)


def test_losses_and_heads_at_the_extremes(spark):
    row = spark.range(1).select(
        training.logistic_loss(F.lit(800.0), F.lit(1)).alias("a"), training.logistic_loss(F.lit(-800.0), F.lit(1)).alias("b"),
        retrieval.log_softmax(F.lit(900.0), F.lit(-900.0)).alias("c"), dist.normal_two_sided(F.lit(1.959964)).alias("d"), dist.normal_two_sided(F.lit(0.0)).alias("e"),
    ).first()
    assert row.a == 0 and row.b == 800 and row.c == 0 and abs(row.d - 0.05) < 1e-6 and abs(row.e - 1) < 1e-6


def test_translation_and_cues(spark):
    raw = "user\nTranslate and give nothing else. \nassistant\nEnglish: \n\nA line.\n  \n  Another. \n"
    row = spark.createDataFrame([(raw, "RT by Smith: WHO and FDA, the Mayo Clinic says. J.D. Miller et al")], "t string, c string").select(T.clean_translation("t"), T.entity_cue_score("c")).first()
    assert row[0] == "A line.\n  Another." and row[1] == 2 * 4 + 2 + 3 + 4 + 2
    folded = spark.createDataFrame([("Škoda Łódź ﬁne Ｗide Ǆ",)], "t string").select(T.ascii_fold("t")).first()[0]
    assert folded == "Skoda odz fine Wide DZ"


def test_query_and_paper_readers(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"index": 7, "text": " a ", "pubkey": 1}, {"qid": "8", "expanded": "", "original": "b"}, {"text": "c"}, {"index": 9, "text": " "}]')
    (tmp_path / "m.json").write_text('{"7": {"text": "a"}, "8": "b"}')
    rows = sorted((r.qid, r.text, r.gold) for r in runs.read_queries(spark, str(tmp_path / "q.json")).collect())
    assert rows == [("2", "c", None), ("7", "a", "1"), ("8", "b", None)]
    assert sorted((r.qid, r.text) for r in runs.read_queries(spark, str(tmp_path / "m.json"), prefix="q: ").collect()) == [("7", "q: a"), ("8", "q: b")]
    (tmp_path / "c.json").write_text('[{"pubkey": 1, "title": "t", "extra": 5}, {"id": "2", "abstract": null}]')
    assert sorted((r.pubkey, r.title) for r in runs.read_papers(spark, str(tmp_path / "c.json")).collect()) == [("1", "t"), ("2", None)]
    (tmp_path / "t.tsv").write_text('post_id\ttweet_text\tcord_uid\n1\tsay "hi\tx9\n')
    assert [tuple(r) for r in runs.read_tsv_queries(spark, str(tmp_path / "t.tsv")).collect()] == [("1", 'say "hi', "x9")]
    out = str(tmp_path / "out")
    runs.write_json_lines(spark.createDataFrame([(1, 2)], "a int, _b int"), out)
    assert spark.read.json(out).columns == ["a"]


def test_noisy_json(spark):
    df = spark.createDataFrame([('Sure! ```json {"a": {"b": "}"}} ```',), ("none",), (None,), ("{ {\"a\": 1}",)], "t string")
    assert [r.f for r in df.select(runs.extract_json_object("t").alias("f")).collect()] == ['{"a": {"b": "}"}}', None, None, '{"a": 1}']
    good = spark.createDataFrame([('{"a": "x", "b": "y"}',), ('{"a": "x"}',), ('{"a": " ", "b": "y"}',), ("no",)], "t string")
    assert [r.f for r in good.select(runs.valid_json_strings(F.col("t"), ["a", "b"]).alias("f")).collect()] == [True, False, False, False]


def test_text_functions(spark):
    df = spark.createDataFrame([("RT @you: see #Tag https://x.y 🙂 &amp;amp; Café's",)], "t string")
    row = df.select(T.clean_keep_handles("t"), T.clean_drop_handles("t"), T.clean_mask_handles("t"), T.clean_entities("t", True), T.ascii_fold("t")).first()
    assert row[0] == "RT you: see Tag https://x.y &amp;amp; Café's"
    assert row[1] == "RT : see Tag &amp;amp; Café's" and row[2] == "RT @user: see Tag &amp;amp; Café's"
    assert row[3] == "RT @user: see Tag &amp; Café's" and row[4].endswith("Cafe's")
    assert df.select(T.word_delimiter(F.lit("WiFi4You"))).first()[0] == ["WiFi4You", "Wi", "Fi", "4", "You"]


def test_social_terms(spark):
    df = spark.createDataFrame([("IMO the \U0001f637 helps #LongCOVID_Study2 a b",), ("",), (None,)], "t string")
    got = [r.x for r in df.select(T.social_terms("t", {"\U0001f637": "mask"}, {"imo": "in my opinion"}).alias("x")).collect()]
    assert got == [["in my opinion", "mask", "helps", "long", "covid", "study"], [], None]


def test_retrieval_edges(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 0.0])], "docid long, v array<double>")
    queries = docs.filter("docid in (1, 3)").withColumnRenamed("docid", "qid")
    got = [(r.qid, r.docid, r.score) for r in retrieval.dense_top_k(queries, docs, 5).orderBy("rank").collect()]
    assert got == [(1, 4, 1.0), (1, 2, 0.0)]
    assert retrieval.dense_top_k(queries.limit(0), docs, 5).count() == 0
    pair = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0]], [[1.0, 1.0]]), ([], [[1.0]]), ([[1.0]], [])], "q array<array<double>>, d array<array<double>>")
    assert [r.s for r in pair.select(retrieval.max_sim("q", "d").alias("s")).collect()] == [1.5, 0.0, 0.0]
    one = spark.createDataFrame([(1, 9, 3.0, 3.0, 3.0)], "qid long, docid long, dense double, sparse double, late double")
    row = retrieval.ltr_features(one).first()
    assert row.dense_scaled == 0 and row.rank_fraction == 1 and row.rank_inverse == 1
    run = spark.createDataFrame([(1, "a", 2.0, 0), (1, "b", 5.0, None), (1, "c", float("nan"), 3), (1, "c", 1.0, 2)], "qid long, docid string, score double, rank int")
    assert [r.docid for r in retrieval.normalize_ranks(run, ("qid",)).orderBy("rank").collect()] == ["c", "b", "a"]
    with pytest.raises(ValueError):
        retrieval.hybrid(one, (0.0, 0.0, 0.0), 5)


def test_bm25_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    # Skewed terms, equal documents (ties), a query without known terms.
    docs = [(f"d{i:03}", [f"t{int(rng.random() ** 3 * 60)}" for _ in range(rng.randrange(1, 30))]) for i in range(300)]
    docs += [(f"e{i}", docs[i][1]) for i in range(40)]
    weights = [(d, t, round(0.1 + (hash_of(t) % 97) / 30 + ts.count(t) / 7, 3)) for d, ts in docs for t in set(ts)]
    terms = [(q, f"t{int(rng.random() ** 2 * 62)}", rng.choice([1.0, 2.0, 0.5])) for q in range(30) for _ in range(rng.randrange(1, 9))] + [(99, "unknown", 1.0)]
    terms = sorted({(q, t): (q, t, b) for q, t, b in terms}.values())
    scores = {}
    for q, t, b in terms:
        for d, t2, w in weights:
            if t == t2:
                scores[q, d] = scores.get((q, d), 0.0) + b * w
    want = set()
    for q in {q for q, _ in scores}:
        best = sorted((-round(s, 6), d) for (q2, d), s in scores.items() if q2 == q)[:7]
        want |= {(q, d, -s, i) for i, (s, d) in enumerate(best, 1)}
    asked, known = spark.createDataFrame(terms, "qid long, term string, qw double"), spark.createDataFrame(weights, "docid string, term string, w double")
    for size in (retrieval.BLOCK_POSTINGS, 200):
        monkeypatch.setattr(retrieval, "BLOCK_POSTINGS", size)
        got = {(r.qid, r.docid, round(r.score, 6), r["rank"]) for r in retrieval.bm25(asked, known, 7).collect()}
        assert got == want
    assert retrieval.bm25(asked.limit(0), known, 7).count() == retrieval.bm25(asked, known.limit(0), 7).count() == 0


def test_bm25_shuffles_no_answers(spark, monkeypatch):
    rng = random.Random(7)
    docs = spark.createDataFrame([(f"d{i:03}", [f"t{int(rng.random() ** 2 * 30)}" for _ in range(8)], [f"t{int(rng.random() * 40)}" for _ in range(20)]) for i in range(150)], "docid string, a array<string>, b array<string>")
    asked = spark.createDataFrame([(q, f"t{t}", 1.0 + t % 2) for q in range(25) for t in rng.sample(range(45), 6)], "qid long, term string, qw double")
    index = retrieval.write_index(docs.repartition(3), {"a": F.col("a"), "b": F.col("b")})
    weights = retrieval.weighted_postings(index, {"a": 2.0})
    scores = asked.join(weights, "term").groupBy("qid", "docid").agg(F.round(F.sum(F.col("qw") * F.col("w")), 6).alias("score"))
    want = {(r.qid, r.docid, r.score, r["rank"]) for r in retrieval.top_k(scores, 9).collect()}
    for size in (retrieval.BLOCK_POSTINGS, 700, 90):
        monkeypatch.setattr(retrieval, "BLOCK_POSTINGS", size)
        found = retrieval.bm25(asked, index, 9, {"a": 2.0})
        assert {(r.qid, r.docid, r.score, r["rank"]) for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_filtered_search_shuffles_no_pairs(spark, sql, monkeypatch):
    want = sorted(map(tuple, sql.execute(catalog.oracle_sql()["filtered_search"]).fetchall()))
    for size in (retrieval.BLOCK_POSTINGS, 300):
        monkeypatch.setattr(retrieval, "BLOCK_POSTINGS", size)
        found = catalog.queries()["filtered_search"](spark, DATA)
        assert sorted((r.qid, r.docid, r["rank"]) for r in found.collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_grid_eval_makes_no_pairs(spark, sql, monkeypatch):
    want = sorted(map(tuple, sql.execute(catalog.oracle_sql()["grid_eval"]).fetchall()))
    for size in (retrieval.BLOCK_POSTINGS, 300):
        monkeypatch.setattr(retrieval, "BLOCK_POSTINGS", size)
        found = catalog.queries()["grid_eval"](spark, DATA)
        assert sorted((r.a, r.b, r.hits) for r in found.collect()) == want
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["prf_terms", "neighbor_expansion", "neighbor_expansion_simple"])
def test_terms_of_papers_are_not_shuffled_one_by_one(spark, name):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(qid#\d+L?, term#", plan)
    assert "MapInArrow" not in plan


def test_dense_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(200)] + [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [1.0])]
    docs = spark.createDataFrame(rows, "docid long, v array<double>")
    usable = {i: v for i, v in rows if v and len(v) == 4 and None not in v}
    want = set()
    for q in range(0, 200, 9):
        best = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)[:6]
        want |= {(q, i, -s, k) for k, (s, i) in enumerate(best, 1)}
    for size in (retrieval.DENSE_ROWS, 30):
        monkeypatch.setattr(retrieval, "DENSE_ROWS", size)
        found = retrieval.dense_top_k(docs.filter("docid % 9 = 0 AND docid < 200").withColumnRenamed("docid", "qid"), docs.repartition(3), 6)
        assert {(r.qid, r.docid, r.score, r["rank"]) for r in found.collect()} == want


def test_shared_folder(spark):
    from types import SimpleNamespace

    from citeloom import session

    kept = session.materialise(spark.range(3), "kept")
    assert kept.count() == 3
    none = SimpleNamespace(isDefined=lambda: False)
    remote = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), getConf=lambda: SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError):
        session.shared_dir(SimpleNamespace(sparkContext=remote, conf=SimpleNamespace(get=lambda *a: None)))
    session.clear_scratch(spark)
    assert not os.path.exists(session._own_dir(spark).removeprefix("file://"))


def test_positions_and_interleaving(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 5003).alias("x"))
    rows = sorted((r.x, r.position) for r in ordering.global_position(df, ["x"]).collect())
    assert [p for _, p in rows] == list(range(5000))
    words = df.select(F.concat(F.lit("k"), F.col("x")).alias("x"))
    rows = sorted((r.x, r.position) for r in ordering.global_position(words, ["x"]).collect())
    assert [p for _, p in rows] == list(range(5000))
    mixed = training.interleave(spark.range(900), spark.range(1000, 1100), "id")
    places = sorted((r.place, r.source) for r in mixed.collect())
    assert [p for p, _ in places] == list(range(1000)) and 8 <= sum(s == "b" for _, s in places[:128]) <= 18


def test_results_do_not_depend_on_partitions(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    seen = set()
    for n in ("1", "3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(repr(sorted(map(repr, catalog.queries()["bm25_topk"](spark, DATA).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_plugins_and_stems(spark):
    from citeloom.functions.stem import stem, stemmed
    from citeloom.operators import plugins

    assert [stem(w) for w in ("caresses", "ponies", "running", "h1n1", "is")] == ["caress", "poni", "run", "h1n1", "is"]
    assert stem("connections") == stem("connection") and stem("retrieved") == stem("retrieves")
    df = spark.createDataFrame([(1, "alpha beta"), (2, None)], "id long, text string")
    rows = {r.id: list(r.v) for r in plugins.encode(df, "text", "v", plugins.hashing_encoder(8)).collect()}
    assert sum(x * x for x in rows[1]) == pytest.approx(1) and rows[2] == [0.0] * 8
    assert [r.t for r in df.select(stemmed(F.split("text", " ")).alias("t")).collect()] == [["alpha", "beta"], None]
    # Examples published with the algorithm.
    pairs = "agreed agre motoring motor hopping hop filing file relational relat digitizer digit vietnamization vietnam decisiveness decis electrical electr replacement replac adoption adopt controll control cease ceas rate rate sky sky".split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]
    made = plugins.generate(df, "text", "out", lambda: lambda ts: [f"{len(t)}" if "not valid: short" in t else "x" for t in ts], F.lit("rule"), lambda c: c != "", lambda a: "short" if a == "x" else None)
    assert {r.out for r in made.collect()} == {str(len(t) + len("\n\nThe answer before was not valid: short")) for t in ("alpha beta", "")}
    made = plugins.generate(df, "text", "out", lambda: lambda ts: [None for _ in ts], F.lit("rule"), lambda c: c != "")
    assert {r.out for r in made.collect()} == {"rule"}
    assert plugins.check_scorer(lambda ps: [float(q in d) for q, d in ps], "a", "a b", "c")


def test_stream_intake_drops_repeats(spark, tmp_path):
    from citeloom.streaming import intake

    rows = [("r", 1, "2026-01-01 00:00:00", "2026-01-01 00:05:00"), ("r", 2, "2026-01-01 00:30:00", "2026-01-20 00:00:00")]
    df = spark.createDataFrame(rows, "run_id string, qid long, run_at string, loaded_at string").select("run_id", "qid", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("run_at", "loaded_at")])
    df.union(df).write.parquet(str(tmp_path / "in"))
    df.write.mode("append").parquet(str(tmp_path / "in"))
    got = intake.take_in(spark, str(tmp_path / "in"), str(tmp_path / "sink"))
    assert sorted(r.qid for r in got.collect()) == [1, 2]
    df.withColumn("qid", F.col("qid") + 10).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r.qid for r in intake.take_in(spark, str(tmp_path / "in"), str(tmp_path / "sink")).collect()) == [1, 2, 11, 12]


def test_settings_and_reports(spark, tmp_path):
    from citeloom.operators.config import RetrievalConfig, canonical_metric, encoder_rule, usable_run
    from citeloom.sources.reports import write_report

    assert RetrievalConfig(top_k=10).pool(25) == 25 and RetrievalConfig(top_k=10).pool(100) == 30
    assert RetrievalConfig(mode="auto").resolved_mode(True) == "hybrid" and RetrievalConfig(mode="auto").resolved_mode(False) == "dense"
    rule = encoder_rule("BAAI/bge-large-en")
    assert (rule.mode, rule.query_prefix.endswith(": "), rule.max_length) == ("dense", True, None) and encoder_rule("BAAI/bge-m3").mode == "hybrid" and encoder_rule("BAAI/bge-m3").max_length
    assert encoder_rule("other", "multivector", "q: ", 64).mode == "hybrid" and encoder_rule("other", query_prefix="q: ").query_prefix == "q: " and encoder_rule("other").query_prefix == ""
    with pytest.raises(ValueError):
        encoder_rule("other", max_length=0)
    for bad in ({"dense_weight": 0, "sparse_weight": 0, "late_weight": 0}, {"top_k": 0}, {"mode": "x"}, {"late_weight": -1}):
        with pytest.raises(ValueError):
            RetrievalConfig(**bad)
    assert [canonical_metric(m) for m in ("hit@10", "MAP", "ndcg@5", "f1", "mrr")] == ["recall_10", "ap", "ndcg_5", "f1_1", "mrr_5"]
    assert usable_run("a/b.json") and not usable_run("a/archive/b.json") and usable_run("a/archive/b.json", True)
    rows = spark.createDataFrame([(1, 0.5)], "qid long, mrr_5 double")
    first = write_report(spark, str(tmp_path / "e.json"), {"system": "s"}, {"mrr_5": 0.5}, rows)
    second = write_report(spark, str(tmp_path / "e.json"), {}, {})
    assert first.endswith("e.json") and second.endswith("e_1.json") and '"qid": 1' in open(first).read()


def test_draws_are_whole(spark):
    docs = spark.createDataFrame([(f"d{i}",) for i in range(40)], "docid string")
    asked = spark.createDataFrame([(q, f"d{q % 40}") for q in range(100)] + [(500, None)], "qid long, gold string")
    lists = {}
    for r in training.random_negatives(asked, docs, 15).collect():
        lists.setdefault(r.qid, []).append(r.docid)
    assert len(lists) == 101 and all(len(v) == len(set(v)) == 15 and f"d{q % 40}" not in v or q == 500 for q, v in lists.items())
    # A small pool is given whole, an empty one gives nothing.
    few = training.random_negatives(asked, docs.filter("docid IN ('d1', 'd2', 'd3')"), 15).groupBy("qid").count().collect()
    assert {r["count"] for r in few} == {2, 3} and training.random_negatives(asked, docs.limit(0), 15).count() == 0
    # All documents come up, none far more often than others.
    often = training.random_negatives(asked, docs, 15).groupBy("docid").count().collect()
    assert len(often) == 40 and max(r["count"] for r in often) < 4 * 1500 / 40


def test_hard_negatives_are_filled(spark):
    rows = spark.createDataFrame([(1, x, t, i) for t, docs in enumerate(("abc", "abcdef", "fgh")) for i, x in enumerate(docs, 1)], "qid long, docid string, tier int, place int")
    got = sorted((r.pos, r.docid, r.tier) for r in training.quota_negatives(rows, {0: 2, 1: 3, 2: 15}, 7).collect())
    # b and a are known and take no place of the second tier; f is new to the third.
    assert got == [(1, "a", 0), (2, "b", 0), (3, "c", 1), (4, "d", 1), (5, "e", 1), (6, "f", 2), (7, "g", 2)]
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    from citeloom.plans import base

    papers = {r.pubkey for r in base.corpus(spark, DATA).select("pubkey").collect()}
    gold = {r.qid: r.gold for r in base.gold(spark, DATA).collect()}
    lists = {}
    for r in catalog.queries()["hard_negatives_filled"](spark, DATA).collect():
        lists.setdefault(r.qid, []).append(r.docid)
    assert lists.keys() == gold.keys()
    for qid, docs in lists.items():
        assert len(docs) == len(set(docs)) == min(15, len(papers - {gold[qid]})) and set(docs) <= papers - {gold[qid]}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_word2vec_covers_rare_words_without_stop_words(spark):
    from citeloom.plans import base

    counts = {r.w: r["count"] for r in base.corpus(spark, DATA).select(F.explode(T.tokenize_w2v("doc_text")).alias("w")).groupBy("w").count().collect()}
    rows = catalog.queries()["word2vec_neighbors"](spark, DATA).collect()
    seen = {w for r in rows for w in (r.word, r.term)}
    assert rows and not seen & set(T.STOP_EN)
    assert min(counts[w] for w in seen) == 3


@pytest.mark.parametrize("step", [1, 7])
def test_word_vectors_equal_plain_training(step):
    rng = np.random.default_rng(5)
    ids, ends, counts = rng.integers(0, 9, 45).astype(np.int32), np.array([4, 5, 30, 45]), np.arange(20, 11, -1)
    size, window, passes, negative = 6, 3, 4, 5
    rng = np.random.default_rng(1)
    vectors, out = (rng.random((9, size), dtype=np.float32) * 2 - 1).astype(float) / size, np.zeros((9, size))
    share = np.cumsum(counts**0.75) / np.sum(counts**0.75)
    whole = 45 - 45 % step
    for done in range(passes):
        for a, z in ((0, whole), (whole, 45)):
            if a == z:
                continue
            reach, drawn = rng.integers(1, window + 1, z - a), rng.random((z - a, negative))
            for b in range(a, z, step):
                # All errors of a step are taken against the vectors before it.
                old, old_out = vectors.copy(), out.copy()
                rate = 0.025 - (0.025 - 0.0001) * (done * 45 + b) / (passes * 45)
                for i in range(b, min(b + step, z)):
                    start, end = max([0, *(e for e in ends if e <= i)]), min(e for e in ends if e > i)
                    near = [j for j in range(max(start, i - reach[i - a]), min(end, i + reach[i - a] + 1)) if j != i]
                    mean = old[ids[near]].mean(axis=0) if near else np.zeros(size)
                    for k, w in enumerate([ids[i], *np.searchsorted(share, drawn[i - a], "right")]):
                        if k == 0 or w != ids[i]:
                            g = ((k == 0) - 1 / (1 + np.exp(-old_out[w] @ mean))) * rate
                            out[w] += g * mean
                            for j in near:
                                vectors[ids[j]] += g * old_out[w]
    found = wordvec.train(ids, ends, counts, size, window, passes, step=step)
    assert np.abs(out).max() > 1e-3 and np.allclose(found, vectors, atol=1e-6)


def test_word_vectors_do_not_depend_on_partitions(spark):
    texts = [(f"{i:03}", [f"w{(i * i + j * (i % 5 + 1)) % 23}" for j in range(i % 40)]) for i in range(120)] + [("long", [f"w{j % 19}" for j in range(3000)]), ("rare", ["once"]), ("null", None)]
    rows = spark.createDataFrame(texts, "pubkey string, words array<string>")
    one, other = ({r.word: r.v for r in wordvec.word_vectors(t, "pubkey", "words", 8, 4, 3, 2).collect()} for t in (rows.repartition(1), rows.repartition(5, "pubkey").orderBy(F.desc("pubkey"))))
    assert one == other and one.keys() == {f"w{i}" for i in range(23)}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in one.values())


def test_word_vectors_with_shared_draws_equal_plain_training():
    rng = np.random.default_rng(6)
    ids, ends, counts = rng.integers(0, 9, 45).astype(np.int32), np.array([4, 5, 30, 45]), np.arange(20, 11, -1)
    size, window, negative, pool, step = 6, 3, 5, 8, 7
    rng = np.random.default_rng(1)
    vectors, out = (rng.random((9, size), dtype=np.float32) * 2 - 1).astype(float) / size, np.zeros((9, size))
    for done in range(3):
        for a, z, t in ((0, 42, 7), (42, 45, 3)):
            reach, drawn = rng.integers(1, window + 1, z - a), rng.random(((z - a) // t, pool))
            for s, b in enumerate(range(a, z, t)):
                old, old_out = vectors.copy(), out.copy()
                rate = 0.025 - (0.025 - 0.0001) * (done * 45 + b) / (3 * 45)
                for i in range(b, b + t):
                    start, end = max([0, *(e for e in ends if e <= i)]), min(e for e in ends if e > i)
                    near = [j for j in range(max(start, i - reach[i - a]), min(end, i + reach[i - a] + 1)) if j != i]
                    mean = old[ids[near]].mean(axis=0) if near else np.zeros(size)
                    for k, w in enumerate([ids[i], *np.searchsorted(wordvec.shares(counts), drawn[s], "right")]):
                        if k == 0 or w != ids[i]:
                            g = ((k == 0) - 1 / (1 + np.exp(-old_out[w] @ mean))) * rate * (1 if k == 0 else negative / pool)
                            out[w] += g * mean
                            for j in near:
                                vectors[ids[j]] += g * old_out[w]
    found = wordvec.train(ids, ends, counts, size, window, 3, step=step, pool=pool)
    assert np.abs(out).max() > 1e-3 and np.allclose(found, vectors, atol=1e-6)


def test_word_vectors_are_trained_in_several_tasks(spark):
    # Words of a topic stand together; every tenth text has one that is rare.
    rng = random.Random(1)
    texts = [(f"{i:04}", [f"{'rare' if j == 9 and i % 50 < 5 else 'often'}-{i % 5}-{rng.choice('abcd') if j != 9 else ''}" for j in range(20)]) for i in range(2000)]
    rows = spark.createDataFrame(texts, "pubkey string, words array<string>")
    one, other = ({r.word: np.array(r.v) for r in wordvec.word_vectors(t, "pubkey", "words", 16, 5, 3, 10, part=13_000, parts=9).collect()} for t in (rows.repartition(1), rows.repartition(5)))
    assert one.keys() == {w for _, words in texts for w in words} and all((one[w] == other[w]).all() for w in one)
    for w, v in one.items():
        near = sorted(one, key=lambda x: -(one[x] @ v))[:4]
        assert {x.split("-")[1] for x in near} == {w.split("-")[1]} and abs(v @ v - 1) < 1e-9
    # Three tasks train, each on its own part of the texts.
    trained = [spark.sparkContext.statusTracker().getStageInfo(s) for j in spark.sparkContext.statusTracker().getJobIdsForGroup() for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    assert sum(s.numTasks == 3 and s.numCompletedTasks == 3 for s in trained if s) >= 20


def test_neighbours_equal_brute_force(spark, monkeypatch):
    # Several slices, the last of them smaller than the list.
    monkeypatch.setattr(wordvec, "SLICE", 31)
    rng = random.Random(2)
    texts = spark.createDataFrame([(f"{i:03}", [f"w{int(rng.paretovariate(0.4)) % 97}" for _ in range(60)]) for i in range(150)], "pubkey string, words array<string>")
    given = texts, "pubkey", "words", 8, 4, 3, 2
    v = {r.word: np.array(r.v) for r in wordvec.word_vectors(*given).collect()}
    assert len(v) > 62
    got = sorted((r.word, r["rank"], r.term, r.score) for r in wordvec.neighbours(wordvec.trained(*given), 10).collect())
    want = [(w, i, x, -s) for w in v for i, (s, x) in enumerate(sorted((-round(float(v[w] @ v[x]), 6), x) for x in v if x != w)[:10], 1)]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and np.allclose([x[3] for x in got], [x[3] for x in sorted(want)], atol=2e-6)
    none = wordvec.trained(texts, "pubkey", "words", 8, 4, 10**6, 2)
    assert wordvec.neighbours(none, 10).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pivot_and_samples_cover_every_run(spark):
    from citeloom.plans import base

    runs_of = {r.run_id for r in base.runs(spark, DATA).select("run_id").distinct().collect()}
    assert len(runs_of) > 4 and set(catalog.queries()["pivot_scores_all"](spark, DATA).columns) == runs_of | {"qid"}
    hits = base.runs(spark, DATA).join(base.gold(spark, DATA), "qid").filter("docid = gold").select("run_id").distinct().collect()
    for name in ("pairwise_margin_runs", "eval_samples_runs"):
        assert {r.run_id for r in catalog.queries()[name](spark, DATA).select("run_id").distinct().collect()} == {r.run_id for r in hits}, name


def test_mined_negatives_reach_rank_50(spark, tmp_path):
    # 40 close copies before 9 valid vectors: nothing valid up to rank 30, eight from rank 41 on.
    vectors = [(100, "q", [1.0] + [0.0] * 63)] + [(i, "c", [0.99 - i / 1000] + [0.0] * 63) for i in range(1, 41)] + [(i, "v", [0.8 - i / 1000] + [0.0] * 63) for i in range(41, 50)]
    spark.createDataFrame(vectors, "vec_id long, pubkey string, vec array<float>").write.parquet(str(tmp_path / "paper_vectors.parquet"))
    short, whole = (catalog.queries()[n](spark, str(tmp_path)).collect() for n in ("mined_negatives", "mined_negatives_50"))
    assert not short and sorted(r.docid for r in whole) == list(range(41, 49))
