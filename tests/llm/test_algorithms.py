"""Overlap, splitting, top-N and vector neighbours against brute force, and their edge cases."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm import curves, overlap, splitter, topn

WORDS = [f"w{i}" for i in range(60)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12), st.integers(0, 4))
def test_word_edit_distance(a, b, limit):
    true = edits(a, b)
    assert overlap.word_edit_distance(a, b, limit) == (true if true <= limit else limit + 1)


def test_overlap_matches_brute_force(spark):
    rng = random.Random(5)
    texts = [[rng.choice(WORDS) for _ in range(rng.choice([3, 6, 7, 8, 14, 15, 16, 17, 24, 40, 56, 57, 80]))] for _ in range(60)]

    def changed(words):
        out = list(words)
        for _ in range(rng.randrange(0, 2 + len(out) // 8)):
            at = rng.randrange(len(out))
            rng.choice([lambda: out.__setitem__(at, "new"), lambda: out.insert(at, "more"), lambda: out.pop(at) if len(out) > 1 else None])()
        return out

    train = [(i, " ".join(t)) for i, t in enumerate(texts + [changed(t) for t in texts])]
    held = [(1000 + i, " ".join(changed(rng.choice(texts)))) for i in range(120)]
    true = {(a, b) for a, t in train for b, h in held if edits(t.split(), h.split()) <= max(len(t.split()), len(h.split())) // 8}
    schema = "qid long, text string"
    got = overlap.cross_split_overlap(spark.createDataFrame(train, schema), spark.createDataFrame(held, schema)).collect()
    assert {(r.train_id, r.eval_id) for r in got} == true and len(got) == len(true) > 50


def test_every_allowed_pair_shares_a_hash():
    rng = random.Random(12)
    for _ in range(1500):
        n = rng.choice([7, 8, 9, 13, 14, 15, 16, 20, 21, 23, 24, 31, 32, 40, 48, 54, 55, 56, 57, 58, 63, 64, 65, 100, 150])
        a = [rng.randrange(50) for _ in range(n)]
        b = list(a)
        for _ in range(n // 7):
            if len(b) > 1:
                at = rng.randrange(len(b))
                rng.choice([lambda: b.__setitem__(at, 99), lambda: b.insert(at, 98), lambda: b.pop(at)])()
        most = max(len(a), len(b)) // 8
        if edits(a, b) > most or min(len(a), len(b)) < 7:
            continue
        keys = [{(int(g[0]), p) for g, p in overlap._keys_of(np.array([[x * 7919 + 13 for x in t]], dtype=np.uint64), kind)} for t, kind in ((a, True), (b, False))]
        assert any(g == h and abs(p - q) <= most for g, p in keys[0] for h, q in keys[1] if g == h), (a, b)


def test_copies_stay_classes(spark):
    schema = "qid long, text string, split string, source string"
    text = "the quick brown fox jumps over the lazy dog and runs away"
    train = spark.createDataFrame([(i, text, "", "") for i in range(300)] + [(400, text.replace("lazy", "sleepy"), "", "")], schema)
    held = spark.createDataFrame([(1000 + i, text, "dev", "s") for i in range(200)] + [(2000, "other words", "dev", "s")], schema)
    links, t, e = overlap.class_links(train, held)
    assert links.count() == 2 and t.count() == 301 and e.count() == 201
    report = overlap.overlap_report(train, held).collect()
    assert [(r.records, r.overlapping, r.pairs) for r in report] == [(201, 200, 200 * 301)]
    assert overlap.word_edit_distance(["w"] * 9000 + ["x"], ["y"] + ["w"] * 9000, 1200) == 2


def test_overlap_edge_cases(spark):
    schema = "qid long, text string, w string, c string"
    train = spark.createDataFrame([(1, "Same Words &amp; more!", "x", "y"), (1, "Same Words &amp; more!", "x", "y"), (2, None, "", ""), (3, "", "", ""), (None, "same words more", "", ""), (4, "🙂 https://a.example", "", "")], schema)
    held = spark.createDataFrame([(9, "@you same wörds, more #", "a", "b"), (10, None, "", ""), (11, " ", "", "")], schema)
    got = overlap.cross_split_overlap(train, held).collect()
    assert [(r.train_id, r.eval_id, r.edits, r.containment) for r in got] == [(1, 9, 0, 1.0)]
    assert overlap.cross_split_overlap(train.limit(0), held).count() == 0
    assert overlap.cross_split_overlap(train, held.limit(0)).count() == 0


def test_overlap_of_a_very_long_text(spark):
    long = " ".join(f"t{i}" for i in range(5000))
    other = long.replace("t17 ", "changed ")
    schema = "qid long, text string"
    got = overlap.cross_split_overlap(spark.createDataFrame([(1, long)], schema), spark.createDataFrame([(2, other)], schema)).collect()
    assert [(r.train_id, r.eval_id, r.edits) for r in got] == [(1, 2, 1)]


MARKUP = ["# ", "## ", "\n", "\n\n", "- ", "  - ", "1. ", "```\n", "| a | b |", "<p>", "</p>", "<ul><li>", "</li></ul>", "<h2>", "</h2>", "====", "word", "two words. ", "a:", "é", ";"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet="ab .\n,;*-é", max_size=400), st.lists(st.sampled_from(MARKUP), max_size=80).map("".join)), st.integers(12, 60), st.integers(0, 10))
def test_pieces_cover_the_text(text, limit, overlap_by):
    stripped = text.strip()
    found = splitter.pieces(text, limit, overlap_by)
    assert "".join(stripped[a:b] for a, b, _ in found) == stripped
    for k, (a, b, piece) in enumerate(found):
        at = b - len(piece)
        assert len(piece) <= limit and piece == stripped[at:b] and (a - overlap_by <= at <= a if k else at == a)
        assert k == 0 or a == found[k - 1][1]
        # The overlap begins with a word, unless none begins in its reach.
        assert at == 0 or stripped[at - 1].isspace() or not any(stripped[i - 1].isspace() and not stripped[i].isspace() for i in range(max(1, a - overlap_by), a))


def heads(text, limit=200, overlap_by=0):
    return [p for _, _, p in splitter.pieces(text, limit, overlap_by)]


BODY = "This sentence has some forty characters. "


def test_headings_stay_with_their_body():
    for one, two in (("# One\n", "# Two\n"), ("One\n===\n", "Two\n===\n"), ("<h2>One</h2>", "<h2>Two</h2>")):
        for n in range(1, 9):
            got = heads(f"{one}{BODY * n}\n\n{two}{BODY * 3}")
            assert sum(p.startswith(two.split("\n")[0]) or two.split("\n")[0] in p for p in got) == 1
            holder = next(p for p in got if two.split("\n")[0] in p)
            assert "This sentence" in holder[holder.index(two.split("\n")[0]) :]
    # A heading over a heading keeps with the first words of the body, even of an oversized one.
    got = heads("# Top\n\n## Sub\n\n" + BODY * 20)
    assert got[0].startswith("# Top\n\n## Sub\n\nThis sentence") and all(len(p) <= 200 for p in got)
    # Sections are cut before headings first: two small sections never share a piece with half of another.
    text = "".join(f"## Part {i}\n{BODY * 2}\n" for i in range(6))
    assert all(p.startswith("## Part") for p in heads(text))


def test_lists_code_tables_and_html_are_nodes():
    listed = "Some reasons are:\n" + "".join(f"- item {i} with a number of words in it\n  - deeper {i} one\n  - deeper {i} two\n" for i in range(6))
    got = heads(listed)
    assert got[0].startswith("Some reasons are:\n- item 0") and all(p.startswith("- item") for p in got[1:])
    code = "Text before. " * 8 + "\n\n```\n" + "x = 1\n\n" * 8 + "```\n\n" + "Text behind. " * 9
    assert any("```\n" + "x = 1\n\n" * 8 + "```" in p for p in heads(code))
    table = "Text before. " * 8 + "\n\n" + "| a | b |\n" * 9 + "\nText behind. " * 9
    assert any("| a | b |\n" * 9 in p for p in heads(table))
    page = "<div>" + "".join(f"<p>{BODY * 2}</p>" for _ in range(5)) + "<ul>" + "".join(f"<li>{BODY}</li>" for _ in range(5)) + "</ul></div>"
    assert all(p.startswith(("<div>", "<p>", "<li>", "<ul>")) for p in heads(page))
    lines = splitter.blocks("```\n# no heading\n- no item\n```\n# Heading\n1. item")
    assert [k for _, _, k, _ in lines] == ["leaf", "heading", "item"]


def test_pieces_end_at_natural_boundaries():
    sentences = [f"Sentence number {i} has some words in it." for i in range(100)]
    found = splitter.pieces(" ".join(sentences), 500, 50)
    assert all(p.rstrip().endswith(".") for _, _, p in found) and len(found) > 5
    listed = splitter.pieces("\n".join(f"- item {i} " + "x" * 90 for i in range(40)), 500, 50)
    assert all(p.endswith(("x", "\n")) for _, _, p in listed)
    assert [len(p) for _, _, p in splitter.pieces("x" * 1000, 500, 50)] == [450, 500, 150]


def test_deep_nesting_is_bounded():
    deep = "\n".join(" " * i + "- item with some words" for i in range(1500))
    page = "<ul><li>word " * 1500 + "</li></ul>" * 1500
    for text in (deep, page, "# a\n" * 3000, "- a:\n" * 3000, "```\n" * 3001):
        found = splitter.pieces(text, 300, 20)
        assert "".join(text.strip()[a:b] for a, b, _ in found) == text.strip() and max(len(p) for _, _, p in found) <= 300


def test_splitting_table(spark):
    rows = [("a", "x" * 10, 1), ("b", None, 2), ("c", "  \n", 3), ("d", "word " * 400, 4), ("d", "word " * 400, 4), (None, "y " * 2000, 5)]
    df = spark.createDataFrame(rows, "pubkey string, abstract string, end_at_ int")
    got = splitter.split_oversized(df, "abstract", ["pubkey", "end_at_"]).collect()
    assert {r.pubkey for r in got} == {"a", "d", None} and max(len(r.piece) for r in got) <= 1500
    assert sum(r.n_pieces == 2 and r.piece_no == 1 and r.pubkey == "d" for r in got) == 2
    assert splitter.split_oversized(df.limit(0), "abstract", ["pubkey"]).count() == 0
    with pytest.raises(ValueError):
        splitter.split_oversized(df.withColumn("piece", df.pubkey), "abstract", ["piece"])


def test_top_n_matches_brute_force_and_skips(spark):
    rng = random.Random(3)
    rows = [("hot", 1, str(rng.randrange(2000)), float(rng.randrange(900))) for _ in range(6000)]
    rows += [(f"r{rng.randrange(3)}", rng.randrange(40), str(rng.randrange(30)), rng.choice([None, math.nan, 1.0, 2.0, -5.5])) for _ in range(2000)]
    rows += [(None, 7, "5", 1.0), ("r0", None, "6", 1.0), ("r0", 3, None, 99.0), ("x", 1, "abc", 1.0), ("x", 1, "10", 1.0), ("x", 1, "9", 1.0)]
    df = spark.createDataFrame(rows, "run_id string, qid long, docid string, score double").withColumnRenamed("score", "score")
    best = {}
    for run, qid, doc, score in rows:
        if doc is not None and score is not None and not math.isnan(score):
            own = best.setdefault((run, qid), {})
            own[doc] = max(own.get(doc, -math.inf), score)
    order = lambda x: (-x[1], not x[0].isdigit(), int(x[0]) if x[0].isdigit() else 0, x[0])
    true = {(r, q, d) for (r, q), own in best.items() for d, _ in sorted(own.items(), key=order)[:5]}
    got = topn.top_n_per_group(df, ["run_id", "qid"], "docid", "score", 5, row_group_rows=200, files=3).collect()
    assert {(r.run_id, r.qid, r.docid) for r in got} == true and len(got) == len(true)

    path = topn.cluster_by_group(df, ["run_id", "qid"], "docid", "score", 200, 3)
    files = [p if "://" in p else p.replace("file:/", "file:///", 1) for p in spark.read.parquet(path).inputFiles()]
    seen = {}
    assert sum(len(f) for f in topn.winners_of_files(files, ["run_id", "qid"], "docid", "score", 5, seen)) < 2000
    assert seen["skipped"] >= 25
    assert topn.top_n_per_group(df.limit(0), ["run_id", "qid"], "docid", "score", 5).count() == 0
    lists = topn.prediction_lists(topn.top_n_per_group(df.filter("run_id = 'x'"), ["run_id", "qid"], "docid", "score", 5), ["run_id", "qid"], "docid")
    assert lists.first().preds == "[9, 10, abc]"


def test_top_n_keeps_whole_number_keys_exact(spark):
    rows = [(2**53 + 1, "1", 1.0), (2**53, "2", 2.0), (None, "3", 3.0), (None, "4", 4.0)]
    got = topn.top_n_per_group(spark.createDataFrame(rows, "qid long, docid string, score double"), ["qid"], "docid", "score", 1).collect()
    assert {(r.qid, r.docid) for r in got} == {(2**53 + 1, "1"), (2**53, "2"), (None, "4")}


def test_hilbert_keys_are_a_continuous_bijection():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        keys = curves.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 64))
    rows = [(i, (base[i % 40] + 0.15 * rng.standard_normal(64)) * (1 + i % 3)) for i in range(400)]
    rows += [(1000 + i, base[0] * (i + 1)) for i in range(30)]
    data = [(i, [float(x) for x in v], "z") for i, v in rows] + [(5000, None, ""), (5001, [0.0] * 64, ""), (5002, [math.nan] + [1.0] * 63, ""), (5003, [1.0], ""), (None, [1.0] * 64, "")]
    df = spark.createDataFrame(data, "vec_id long, vec array<float>, id string")
    got = curves.neighbours(df, "vec_id", "vec", k=5).collect()
    ids = np.array([i for i, _ in rows])
    unit = np.array([np.float32(v) for _, v in rows], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    s = np.round(unit @ unit.T, 6)
    np.fill_diagonal(s, -2)
    true = {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:5]}
    found = {(r.id, r.other) for r in got}
    assert len(found & true) >= 0.97 * len(true) and len(got) == len(found) == 5 * len(ids)
    copies = [r.other for r in sorted(got, key=lambda r: r["rank"]) if r.id == 1010]
    assert copies == [1000, 1001, 1002, 1003, 1004]
    pairs = curves.similar_pairs(curves.neighbours(df, "vec_id", "vec", k=5, least=0.9), 0.9).collect()
    assert {(r.vec_id_a, r.vec_id_b) for r in pairs} == {(min(a, b), max(a, b)) for a, b in true if s[list(ids).index(a), list(ids).index(b)] >= 0.9}
    assert curves.neighbours(df.limit(0), "vec_id", "vec").count() == 0


def test_neighbours_hold_recall_beyond_the_windows(spark, monkeypatch):
    monkeypatch.setattr(curves, "BLOCK_ROWS", 700)
    unit = np.random.default_rng(5).standard_normal((3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(unit)], "vec_id long, vec array<float>")
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    true = {(i, int(j)) for i in range(len(s)) for j in np.argsort(-s[i])[:5]}

    def recall(curve_count, window, **more):
        rows = curves.neighbours(df, "vec_id", "vec", k=5, curves=curve_count, window=window, **more).collect()
        return len({(r.id, r.other) for r in rows} & true) / len(true)

    assert recall(2, 64) < 0.5  # what fixed windows see of random vectors
    assert recall(2, 64, hold=0.95) >= 0.94  # rounds of second neighbours until a sample has it
    monkeypatch.setattr(curves, "ROUNDS", 0)
    assert recall(2, 64, hold=0.95) > 0.999  # measured, then all pairs
    assert recall(16, 64, hold=0.95) > 0.999  # all pairs at once


def test_windows_do_not_depend_on_batches():
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((500, 8))
    ids = rng.permutation(500)
    whole = curves.best_in_windows(ids, unit, 4, 32, -1.0)
    want = set(zip(*(x.tolist() for x in whole[:2])))
    for size in (1, 30, 77, 499):
        got, first, start = set(), 0, 0
        for end in [*range(size, 500, size), 500]:
            left, right, _, start = curves.best_in_windows(ids[first:end], unit[first:end], 4, 32, -1.0, start, end == 500)
            got |= set(zip(left.tolist(), right.tolist()))
            first, start = first + max(0, start - 32), min(start, 32)
        assert got == want


def test_second_neighbours_against_brute_force():
    rng = np.random.default_rng(4)
    unit = rng.standard_normal((60, 8))
    ids = np.arange(60) * 7
    owner, member = np.unique(np.stack([rng.integers(0, 12, 200), rng.integers(0, 60, 200)]), axis=1)
    floor = rng.uniform(-1, 1, 60)
    got = curves.compared(owner, ids[member], unit[member], floor[member], 3)
    best = {}
    for o in set(owner.tolist()):
        for x in member[owner == o]:
            for y in member[owner == o]:
                s = float(unit[x] @ unit[y])
                if x != y and s > floor[x]:
                    best.setdefault(int(ids[x]), {})[int(ids[y])] = s
    want = {(c, d) for c, own in best.items() for d, _ in sorted(own.items(), key=lambda t: (-t[1], t[0]))[:3]}
    assert {(c, d) for c, d in zip(got.c.tolist(), got.d.tolist()) } == want
