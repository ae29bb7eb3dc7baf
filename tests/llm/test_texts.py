"""Language, pair defects, encoding, leakage and toxicity: brute force, round trips, held-out accuracy, edge cases."""

import base64
import os
import random

import pytest

from citeloom.llm import bpe, langid, leakage, pairs, text, toxicity

RANKS = bpe.DEFAULT_RANKS
DATA = "/root/testdata/sf0.01"
SAMPLES = {
    "en": "The patients were asked about their sleep and the answers did not change over the weeks. Nobody knows why this happened in the larger group. We have seen it before and it will come again when the weather is cold.",
    "de": "Die Patienten wurden nach ihrem Schlaf gefragt und die Antworten haben sich nicht verändert. Niemand weiß, warum das in der größeren Gruppe geschehen ist. Wir haben es schon gesehen und es wird wieder kommen, wenn das Wetter kalt ist.",
    "fr": "Les patients ont été interrogés sur leur sommeil et les réponses n'ont pas changé. Personne ne sait pourquoi cela est arrivé dans le plus grand groupe. Nous avons déjà vu cela et cela reviendra quand le temps sera froid.",
    "es": "Se preguntó a los pacientes por su sueño y las respuestas no cambiaron. Nadie sabe por qué ocurrió esto en el grupo más grande. Lo hemos visto antes y volverá cuando haga frío en las ciudades.",
    "it": "Ai pazienti è stato chiesto del loro sonno e le risposte non sono cambiate. Nessuno sa perché questo sia accaduto nel gruppo più grande. Lo abbiamo già visto e tornerà quando il tempo sarà freddo nelle città.",
}


@pytest.fixture(scope="module")
def made(spark):
    rows = [(t, code) for code, t in SAMPLES.items()] + [(None, "en"), ("x", None), ("", "fr")]
    return langid.profiles(spark.createDataFrame(rows, "text string, lang string"))


def test_words():
    assert text.words("Ｈéllo,&nbsp;@you #Tag’s https://x.example/a 🙂 ﬁne​!") == ["hello", "tag", "s", "fine"]
    assert text.words(None) == text.words("") == []


def test_language_of_sentences(made):
    judge = langid.Judge(made)
    for code, want in (
        ("We asked them about the weather and they did not know.", "en"),
        ("Wir haben sie gefragt und niemand weiß, warum das Wetter kalt ist.", "de"),
        ("Personne ne sait pourquoi les patients ont changé de groupe.", "fr"),
        ("Nadie sabe por qué los pacientes cambiaron de grupo antes.", "es"),
        ("Nessuno sa perché i pazienti abbiano già cambiato gruppo.", "it"),
    ):
        assert judge.segments(code)[0] == want
    main, sure, parts = judge.segments(SAMPLES["fr"] + " " + SAMPLES["de"] + " #tag https://a.example")
    assert [p[0] for p in parts] == ["fr", "de"] and 0 < sure <= 1
    mixed = SAMPLES["fr"] + " " + SAMPLES["de"] + " #tag https://a.example"
    assert [mixed[a:b].strip()[:4] for _, _, _, a, b in parts] == ["Les ", "Die "] and parts[0][3] == 0 and parts[1][4] == len(mixed) and parts[0][4] == parts[1][3]
    for strange in ("Пациентов спрашивали об их сне, и ответы не менялись в течение недель.", "患者被问及他们的睡眠情况，答案在几周内没有变化。", "Potilailta kysyttiin heidän unestaan, eivätkä vastaukset muuttuneet viikkojen aikana."):
        assert judge.segments(strange)[0] == langid.UNKNOWN
    # A quotation is an aside at any length.
    for n in (1, 9):
        quoted = f'Niemand weiß, warum das „{"nobody knows why this happened " * n}“ in der größeren Gruppe so geschehen ist und wieder kommen wird.'
        assert [x[0] for x in judge.segments(quoted)[2]] == ["de"]
    assert judge.segments(None) == judge.segments("") == judge.segments("123 🙂") == (None, 0.0, [])


def test_label_faults(spark, made):
    rows = [(1, SAMPLES["fr"], "français"), (2, SAMPLES["fr"], "en"), (3, SAMPLES["fr"], "und"), (4, SAMPLES["fr"] + " " + SAMPLES["it"], "fr"), (5, None, "fr"), (6, "", None), (7, SAMPLES["en"], "en-GB"), (7, SAMPLES["en"], "en-GB")]
    df = spark.createDataFrame(rows, "qid long, text string, lang string").withColumn("confidence", langid.F.lit("kept?"))
    got = {(r.qid, r.fault) for r in langid.label_faults(df, made).collect()}
    assert got == {(1, None), (2, "wrong"), (3, "missing"), (4, "mixed"), (5, None), (6, None), (7, None)}
    assert langid.label_faults(df.limit(0), made).count() == 0


def test_common_subsequence_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert pairs.longest_common_subsequence(a, b) == table[-1][-1]


def test_defects(spark, made):
    prompt = SAMPLES["de"].replace("Patienten", "Patienten von Morbax").replace("kalt ist", "in KLX-12 kalt ist")
    answer = SAMPLES["en"].replace("patients", "patients of Morbax").replace("is cold", "is cold in KLX-12")
    cases = [
        (prompt, None, "empty"), (prompt, " 🙂 … ", "empty"), (prompt, prompt, "copy"), (prompt, prompt.replace("Die", "die").replace("ß", "ss"), "copy"),
        (prompt, "I'm sorry, but I can't help with translating this.", "refusal"), (prompt, "Als Sprachmodell darf ich keine Übersetzung anbieten.", "refusal"),
        (prompt, SAMPLES["it"], "wrong_language"), (prompt, answer[:90], "truncated"), (prompt, answer[: answer.index("We have")], "truncated"),
        (prompt, answer, None), (prompt, '"Translation: ' + answer + '"', None), (prompt, answer.lower(), None), (None, answer, None), ("", answer[:90], None),
        (prompt, SAMPLES["fr"] + " " + answer, None), (None, None, "empty"),
    ]
    df = spark.createDataFrame([(i, a, b, "e") for i, (a, b, _) in enumerate(cases)], "qid long, text_original string, text string, defect string")
    got = {r.qid: r.defect for r in pairs.defects(df, made).collect()}
    assert [got[i] for i in range(len(cases))] == [c for _, _, c in cases]
    assert pairs.defects(df.limit(0), made).count() == 0
    assert pairs.is_copy(["a"] * 5000, ["a"] * 5000)
    # Order counts at any length.
    words = [f"w{i}" for i in range(3000)]
    for n in (1900, 3000):
        mixed = random.Random(n).sample(words[:n], n)
        assert pairs.is_copy(words[:n], words[:n]) and not pairs.is_copy(words[:n], mixed)


def test_all_defects_and_padded_refusals(made):
    judge, refusals = langid.Judge(made), pairs.Refusals()
    assert pairs.all_defects(SAMPLES["de"], SAMPLES["de"], judge, refusals) == ["copy", "wrong_language"]
    padding = " ".join(["It was a calm day and the people went home early."] * 9)
    assert "refusal" in pairs.all_defects(SAMPLES["de"], f"{padding} I'm sorry, but I can't help with this request. {padding}", judge, refusals)


#: Phrasings of refusals and of harmless sentences, written for this test.
DECLINES = """\
Sorry, I cannot translate that post.
Regrettably I am not able to provide you a translation of it.
I'm afraid I can't translate this for you.
As an AI, I must decline this translation.
This text cannot be translated.
I would prefer not to translate this.
Leider kann ich diesen Text nicht übersetzen.
Ich möchte dafür keine Übersetzung anfertigen.
Malheureusement, je ne peux pas traduire ce message.
Lamentablemente no puedo traducir este texto.
Purtroppo non posso tradurre questo messaggio.""".splitlines()
HARMLESS = """\
The team could not help the patients with this treatment.
Doctors cannot provide a firm answer to this question yet.
We must refuse the idea that sleep does not matter.
Sie können diesen Effekt nicht erklären.
Personne ne peut dire pourquoi cela ne marche pas.
The protein is not able to translate the signal.""".splitlines()


def test_refusal_templates():
    made = pairs.Refusals()
    assert [t for t in DECLINES if not made.in_text(t)] == []
    assert [t for t in HARMLESS if made.in_text(t)] == []
    # The key words never hide a template that aligns.
    rng = random.Random(3)
    vocabulary = sorted(set().union(*made.words))
    for _ in range(60):
        words = list(rng.choice(made.templates))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        assert made.in_sentence(words) == any(made.aligned(t, words) >= made.needed(words) for t in made.templates)


needs_ranks = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")


@needs_ranks
def test_encoding_matches_the_reference_library():
    tiktoken = pytest.importorskip("tiktoken")
    raw = open(RANKS, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    true = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    alphabet = "ab eéßñ́\x1c\x85​ 　\xa0\t\n 'tsre’日本🙂🏽01½ⅷ.-<|endoftext|>zq"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(2000)] + ["a" * 20000, " " * 3000, "ab" * 5000, "<|endoftext|>", "", None]
    encoder = bpe.Encoder(raw)
    got = encoder.encode_all(texts)
    assert [g.tolist() for g in got] == [true.encode_ordinary(t or "") for t in texts]
    assert 0 < encoder.pair_good.mean() < 1  # both outcomes of the check occur
    assert all(b"".join(encoder.bytes_of[i] for i in g.tolist()).decode() == (t or "") for t, g in zip(texts, got))


@needs_ranks
def test_encoding_a_table(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (1, "hello world", "x"), (2, None, ""), (3, "", ""), (4, "  ", "")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode(df, "text").collect())
    assert got[0] == got[1] and got[2:4] == [(2, []), (3, [])] and len(got[4][1]) > 0
    assert bpe.encode(df.limit(0), "text").count() == 0


def item(rng, n=60):
    return [f"{rng.choice('bcdfg')}{rng.randrange(400)}" if rng.random() < 0.4 else rng.choice(["the", "of", "and", "to", "in", "trial"]) for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(8)
    items = [item(rng) for _ in range(40)]
    docs, true = [], set()
    for i in range(300):
        words = item(rng, 80)
        if i % 3 == 0:
            k = rng.randrange(40)
            size = rng.choice([32, 45, 60])
            at = rng.randrange(61 - size)
            part = list(items[k][at : at + size])
            for p in rng.sample(range(2, size - 2), max(0, size // 10 - 1)):
                part[p] = "changed"
            words[20:20] = part
            true.add((i, k))
        elif i % 3 == 1:
            k = rng.randrange(40)
            words[20:20] = items[k][:20]  # a third isn't half
        docs.append((i, " ".join(words).capitalize() + "."))
    docs += [(900, None), (901, ""), (902, "&amp;"), (None, " ".join(items[0])), (903, " ".join(items[1])), (903, " ".join(items[1]))]
    true.add((903, 1))
    rows = [(k, " ".join(w), "s") for k, w in enumerate(items)] + [(99, None, ""), (98, "", ""), (None, "a b", "")]
    corpus, held = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string, doc_id string")
    got = leakage.leaked_passages(corpus, held).collect()
    assert {(r.doc_id, r.item_id) for r in got} == true and len(got) == len(true)
    assert leakage.leaked_passages(corpus, held.limit(0)).count() == leakage.leaked_passages(corpus.limit(0), held).count() == 0


def test_leaks_in_several_indexes_and_lengths(spark, monkeypatch):
    rng = random.Random(9)
    items = [item(rng, rng.choice([9, 20, 60, 400])) for _ in range(16)]
    corpus = spark.createDataFrame([(k, " ".join(item(rng, 300) + w)) for k, w in enumerate(items)], "doc_id long, text string").repartition(2)
    held = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 200)
    for size in (leakage.HELD_BYTES, 0):
        monkeypatch.setattr(leakage, "HELD_BYTES", size)
        got = {(r.doc_id, r.item_id) for r in leakage.leaked_passages(corpus, held).collect()}
        assert got >= {(k, k) for k in range(16)}
        words = {k: text.plain_words(r.text) for k, r in enumerate(corpus.orderBy("doc_id").collect())}
        # What else is found really holds half of a short item.
        assert all(d == i or len(items[i]) < 30 for d, i in got) and len(words) == 16


def test_least_half_against_brute_force():
    rng = random.Random(4)
    for n in (3, 8, 21, 60):
        words = item(rng, n)
        weight = {w: rng.random() for w in words}
        half, lost = leakage.half_of(n), leakage.half_of(n) // 10 + 1 if n >= leakage.LEAST_WORDS else 0
        windows = [sorted((weight[t] for t in set(words[a : a + half])), reverse=True) for a in range(n - half + 1)]
        want = min(sum(own[lost:]) if len(own) > lost else own[-1] for own in windows)
        assert leakage.least_half(words, weight) == pytest.approx(want, abs=1e-6)


def test_block_bound_never_loses_an_item(monkeypatch):
    rng = random.Random(2)
    items = [item(rng) for _ in range(50)]
    index = leakage.ItemIndex(list(enumerate(items)))
    texts = [items[k][:30] for k in range(50)] + [item(rng, 200) + items[7] for _ in range(9)] + [[], ["unknown"]]
    want = set()
    for d, words in enumerate(texts):
        for a in range(0, max(1, len(words) - index.span), index.span):
            score = [0.0] * 50
            for t in {w for w in words[a : a + 2 * index.span] if w in index.term}:
                for p in range(index.start[index.term[t]], index.start[index.term[t] + 1]):
                    score[index.item[p]] += index.weight[p]
            want |= {(d, k) for k in range(50) if score[k] >= 1}
    for cells in (leakage.CELLS, 100):
        monkeypatch.setattr(leakage, "CELLS", cells)
        assert set(index.candidates(texts)) == want and {(k, index.ids.index(k)) for k in range(50)} <= want


def test_spelling_tricks():
    assert toxicity.tokens("You are a h4lfw1t$, C R A P and tittttts, s******d fu​cking!") == ["you", "are", "a", "halfwits", "crap", "and", "tits", "s***", "fucking"]


def test_toxicity_held_out(spark, monkeypatch):
    rng = random.Random(6)
    fine = ["the archive shows a stable signal in the second year", "figures from the clinic were compared with the survey", "a clown visited the ward and the children laughed", "half of the forms skipped the question on sleep"]
    bad = ["you are a {} clown and nobody wants you here", "nobody asked for your opinion you {} fool", "we should throw the {} lot of them into the sea"]
    fill = ["rotten", "filthy", "pathetic", "lying"]

    def make(n, noise):
        rows = []
        for i in range(n):
            sentences = [rng.choice(fine).capitalize() + f" {rng.randrange(999)}." for _ in range(5)]
            y = rng.random() < 0.2
            if y:
                sentences[rng.randrange(5)] = rng.choice(bad).format(rng.choice(fill)).capitalize() + "."
            rows.append((i, " ".join(sentences), int(y), int(y if rng.random() > noise else not y)))
        return rows

    train, test = make(400, 0.05), make(300, 0)
    documents = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in train] + [(None, 1), (3, None), (5, 7)], "doc_id long, toxic int")
    terms = spark.createDataFrame([("clown", "abusive"), (None, "x")], "term string, category string")
    model = toxicity.fit(documents, labels, terms)
    score = model.scorer()([r[1] for r in test])
    right = sum((s >= 0.5) == bool(r[2]) for s, r in zip(score, test))
    assert right >= 0.97 * len(test)
    rows = [(1, "a", None), (2, "a", ""), (3, None, "🙂"), (4, "b", "You are a filthy clown and nobody wants you here."), (4, "b", "You are a filthy clown and nobody wants you here."), (5, "b", "word " * 5000)]
    scored = toxicity.score(spark.createDataFrame(rows, "doc_id long, source string, text string"), model)
    got = {(r.doc_id, round(r.toxicity)) for r in scored.collect()}
    assert got == {(1, 0), (2, 0), (3, 0), (4, 1), (5, 0)}
    rates = {r.source: (r.documents, r.flagged) for r in toxicity.source_rates(scored).collect()}
    assert rates == {"a": (2, 0), None: (1, 0), "b": (3, 2)}
    assert toxicity.score(scored.limit(0), model).count() == 0
    assert max(toxicity.fit(documents.limit(0), labels.limit(0)).scorer()(["you stupid idiot shut up", "the paper"])) <= 0.5
    monkeypatch.setattr(toxicity, "MAX_TERMS", 0)
    with pytest.raises(ValueError):
        toxicity.fit(documents, labels, terms)
