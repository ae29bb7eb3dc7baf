"""Problem 9: a score for abusive, hateful or sexually explicit language, by FTRL-proximal logistic regression.

Features of a sentence are hashed word n-grams (1 to 3) and skip-grams (one and two words left out), after case, accents,
invisible characters, stretched letters, spelled-out letters (``c r a p``), digit and sign spellings (``h4lfw1t``) are undone; a
masked word becomes its first letter and a mark. Terms of a caller's word list add a weak feature per category. A text's score
is that of its highest-scoring sentence, so length doesn't dilute it.

Training is FTRL-proximal with per-coordinate rates and L1, in mini-batches on the driver, over at most ``MAX_FINE`` unflagged and
``MAX_BAD`` flagged texts (those of smallest id hash; documented bounds); the features are made on the executors, and nothing but labels and
the word list goes in. Labels stand for whole texts: of a flagged text only the sentence counts that is most telling, first by the lift of its
features, then also by the model so far; a flagged text without a telling sentence hardly counts. Texts whose annotators disagree
aren't used. L1 leaves few weights; they are broadcast (at most ``SPACE``, 4 MB).

Scale: scoring is a narrow map; rates per source are one combined aggregation.

Defined results: null, empty and wordless texts score 0; repeated rows are scored each; without any flagged label no text
scores over 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.text import HANDLE, URL, fold

#: Bounds of the labelled sample that is collected for training: unflagged and flagged texts.
MAX_FINE, MAX_BAD = 10_000, 2_000
#: Largest word list; a longer one is an error.
MAX_TERMS = 100_000
#: A word tells when flagged texts have it so many times as often; a flagged text counts in full when this share of a sentence's words tells.
LIFT, TELLING = 4.0, 0.3
CACHE_WORDS = 500_000
#: Hashed features; a model has at most so many weights.
SPACE = 1 << 20
#: Score from which a text counts as flagged.
FLAG_AT = 0.5

# ``[^\\W_]`` is a letter or number, ``[^\\W\\d_]`` a letter.
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|\n+")
TOKEN = re.compile(r"[^\W_]+(?:[*@$!|]+[^\W_]+)*[*$]*")
SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![^\W_])")
GAP = re.compile(r"[ .\-_*]")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
MASKED = re.compile(r"^[^\W\d_]+\*{1,}[^\W\d_]*$|^[^\W\d_]*\*{2,}[^\W\d_]*$")
#: Digits and signs read as the letters they stand for inside a word.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"})
CODE = re.compile(r"^[a-z]+\d+$|^\d+[a-z]?$")


def unmasked(text: str) -> str:
    """A text without case, accents, links and handles; stretched and spelled-out letters undone."""
    text = fold(text)
    if "://" in text or "www." in text:
        text = URL.sub(" ", text)
    if "@" in text:
        text = HANDLE.sub(" ", text)
    return STRETCHED.sub(r"\1", SPELLED.sub(lambda m: GAP.sub("", m[0]), text))


def _plain(token: str) -> str:
    if MASKED.match(token):
        return token[0] + "***"
    return "0" if CODE.match(token) else STRETCHED.sub(r"\1", token.translate(SIGNS).replace("*", ""))


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence or line of a text that has any, spelling tricks undone."""
    if not text:
        return []
    found = (TOKEN.findall(s) for s in SENTENCE.split(unmasked(text)))
    return [words if "".join(words).isalpha() else [t if t.isalpha() else _plain(t) for t in words] for words in found if words]


def tokens(sentence: str) -> list[str]:
    """Words of a text as one sentence."""
    return [t for words in sentences(sentence) for t in words]


class Features:
    """Hashed n-grams, skip-grams and list categories of tokenised sentences, for whole batches at a time."""

    def __init__(self, terms: dict[str, str]) -> None:
        self.terms: dict[tuple[str, ...], str] = {}
        for term, category in terms.items():
            if words := tokens(term):
                self.terms[tuple(words)] = f"category {category}"
        self.sizes: dict[str, set[int]] = {}
        for words in self.terms:
            self.sizes.setdefault(words[0], set()).add(len(words))
        self.codes: dict[str, int] = {}

    def _codes(self, words: list[str]) -> list[int]:
        codes = self.codes
        if len(codes) > CACHE_WORDS:
            codes.clear()
        for w in set(words).difference(codes):
            codes[w] = zlib.crc32(w.encode())
        return [codes[w] for w in words]

    def listed(self, words: list[str]) -> list[str]:
        """Categories of the list terms in a sentence, each once."""
        found: set[str] = set()
        if self.sizes.keys().isdisjoint(words):
            return []
        for i, w in enumerate(words):
            for n in self.sizes.get(w, ()):
                category = self.terms.get(tuple(words[i : i + n]))
                if category:
                    found.add(category)
        return sorted(found)

    def of(self, batch: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(columns, owning sentence) of all features of tokenised sentences."""
        sizes = np.array([len(w) for w in batch], dtype=np.int64)
        h = np.array(self._codes([t for w in batch for t in w]), dtype=np.uint64)
        owner = np.repeat(np.arange(len(batch)), sizes)
        cols, owners = [h * np.uint64(0x9E3779B1)], [owner]
        for gap, kind in ((1, 2), (2, 3), (3, 4)):
            if len(h) > gap:
                inner = owner[gap:] == owner[:-gap]
                cols.append((h[:-gap][inner] * np.uint64(0x85EBCA6B) + h[gap:][inner] * np.uint64(0xC2B2AE35) + np.uint64(kind * 0x27D4EB2F)))
                owners.append(owner[gap:][inner])
        if len(h) > 2:
            inner = owner[2:] == owner[:-2]
            cols.append(h[:-2][inner] * np.uint64(0x85EBCA6B) + h[1:-1][inner] * np.uint64(0xC2B2AE35) + h[2:][inner] * np.uint64(0x165667B1))
            owners.append(owner[2:][inner])
        extra = [(i, c) for i, w in enumerate(batch) for c in self.listed(w)] if self.terms else []
        cols.append(np.array(self._codes([c for _, c in extra]), dtype=np.uint64) * np.uint64(0x9E3779B1))
        owners.append(np.array([i for i, _ in extra], dtype=np.int64))
        mixed = np.concatenate(cols)
        mixed ^= mixed >> np.uint64(29)
        return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64) % SPACE, np.concatenate(owners)


class Ftrl:
    """FTRL-proximal logistic regression over hashed features."""

    def __init__(self, alpha: float = 0.15, beta: float = 1.0, l1: float = 0.08, l2: float = 0.05) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(SPACE)
        self.n = np.zeros(SPACE)
        self.bias_z = self.bias_n = 0.0

    def _weight(self, z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def weights(self) -> tuple[np.ndarray, float]:
        """All weights and the bias."""
        return self._weight(self.z, self.n, self.l1), float(self._weight(np.float64(self.bias_z), np.float64(self.bias_n), 0.0))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, batch: int = 128, seed: int = 1) -> None:
        """One pass in seeded random order."""
        order = np.random.default_rng(seed).permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            own = [rows[i] for i in part]
            cols = np.concatenate(own)
            owner = np.repeat(np.arange(len(part)), [len(c) for c in own])
            unique, back = np.unique(cols, return_inverse=True)
            w = self._weight(self.z[unique], self.n[unique], self.l1)
            bias = float(self._weight(np.float64(self.bias_z), np.float64(self.bias_n), 0.0))
            raw = np.bincount(owner, w[back], minlength=len(part)) + bias
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]) * importance[part]
            g = np.bincount(back, error[owner], minlength=len(unique))
            g2 = np.bincount(back, error[owner] ** 2, minlength=len(unique))
            step = (np.sqrt(self.n[unique] + g2) - np.sqrt(self.n[unique])) / self.alpha
            self.z[unique] += g - step * w
            self.n[unique] += g2
            gb, gb2 = float(error.sum()), float((error**2).sum())
            self.bias_z += gb - (np.sqrt(self.bias_n + gb2) - np.sqrt(self.bias_n)) / self.alpha * bias
            self.bias_n += gb2


class Model:
    """Sparse weights; scores texts by their worst sentence."""

    def __init__(self, ftrl: Ftrl, terms: dict[str, str]) -> None:
        weights, self.bias = ftrl.weights()
        self.at = np.nonzero(weights)[0]
        self.value = weights[self.at].astype(np.float32)
        self.terms = terms

    def scorer(self) -> Callable[[list[str | None]], np.ndarray]:
        """A function that scores lists of texts: probability for the worst sentence; 0 without words."""
        dense = np.zeros(SPACE, dtype=np.float32)
        dense[self.at] = self.value
        made = Features(self.terms)

        def run(texts: list[str | None]) -> np.ndarray:
            batch, doc = [], []
            for i, t in enumerate(texts):
                own = sentences(t)
                batch += own
                doc += [i] * len(own)
            worst = np.full(len(texts), -np.inf)
            if batch:
                cols, owner = made.of(batch)
                np.maximum.at(worst, doc, np.bincount(owner, dense[cols], minlength=len(batch)) + self.bias)
            return np.where(np.isinf(worst), 0.0, 1 / (1 + np.exp(-np.clip(worst, -30, 30))))

        return run


def sentence_features(text: str | None, made: Features) -> list[np.ndarray]:
    """Feature columns of each sentence with words; the first columns are its words in order."""
    batch = sentences(text)
    if not batch:
        return []
    cols, owner = made.of(batch)
    order = np.argsort(owner, kind="stable")
    return np.split(cols[order].astype(np.int32), np.cumsum(np.bincount(owner, minlength=len(batch)))[:-1])


def suspicion(texts: list[list[np.ndarray]], labels: list[int]) -> Callable[[np.ndarray], float]:
    """Share of a sentence's words that flagged texts use over ``LIFT`` times as often as others."""
    counts = np.zeros((2, SPACE))
    for own, y in zip(texts, labels):
        if own:
            counts[y][np.unique(np.concatenate(own))] += 1
    total = [max(1, sum(1 for y in labels if y == k)) for k in (0, 1)]
    telling = counts[1] / total[1] > LIFT * counts[0] / total[0]

    def share(f: np.ndarray) -> float:
        # A sentence of n words has 5n - 8 columns (from three words on), the words first.
        words = max(1, min(len(f), (len(f) + 8) // 5))
        return float(telling[f[:words]].mean())

    return share


def train(texts: list[list[np.ndarray]], labels: list[int], terms: dict[str, str], passes: int = 3) -> Model:
    """Fit on texts given as sentence features, by alternating between choosing sentences and weighting them."""
    made = Features(terms)
    odd = suspicion(texts, labels)
    fine = [f for own, y in zip(texts, labels) if not y for f in own]
    bad = [own for own, y in zip(texts, labels) if y and own]
    # Of two equally likely explanations of a flagged text without any telling sentence, a wrong label is the better one.
    shares = [[odd(f) for f in own] for own in bad]
    model, weights, bias = Ftrl(), None, 0.0
    for step in range(passes):
        rows, ys, ws = list(fine), [0] * len(fine), [1.0] * len(fine)
        if weights is not None:
            ws = [0.05 if weights[f].sum() + bias > 3 else 1.0 for f in fine]
        for own, share in zip(bad, shares):
            worth = share if weights is None else [4 * s + float(np.clip(weights[f].sum() + bias, -4, 4)) / 2 for s, f in zip(share, own)]
            at = int(np.argmax(worth))
            rows.append(own[at])
            ys.append(1)
            ws.append(3.0 if share[at] >= TELLING else 0.02)
        model = Ftrl()
        for k in range(3):
            model.fit(rows, np.array(ys, dtype=float), np.array(ws), seed=step * 10 + k)
        weights, bias = model.weights()
    return Model(model, terms)


def _word_list(terms: DataFrame) -> dict[str, str]:
    rows = terms.filter("term IS NOT NULL").groupBy("term").agg(F.min("category").alias("category")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a word list may have {MAX_TERMS} terms")
    return {r.term: r.category for r in sorted(rows)}


def fit(documents: DataFrame, labels: DataFrame, terms: DataFrame | None = None, max_fine: int = MAX_FINE, max_bad: int = MAX_BAD) -> Model:
    """Train on a bounded sample of texts whose annotators agree."""
    listed = {} if terms is None else _word_list(terms)
    agreed = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi"))
    agreed = agreed.filter("lo = hi").select("doc_id", F.col("hi").alias("y"))
    parts = [agreed.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((0, max_fine), (1, max_bad))]
    chosen = documents.select("doc_id", "text").filter("text IS NOT NULL").join(parts[0].unionByName(parts[1]), "doc_id")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = Features(listed)
        for batch in batches:
            blobs = [[f.tobytes() for f in sentence_features(t, made)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "f": blobs})

    found = chosen.mapInPandas(extract, "doc_id long, y int, f array<binary>").collect()
    found.sort(key=lambda r: (r.doc_id, r.y, len(r.f)))
    return train([[np.frombuffer(b, dtype=np.int32) for b in r.f] for r in found], [int(r.y) for r in found], listed)


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with column ``toxicity`` (replaced if it exists)."""
    # Pickled with its class, so that executors need no copy of the package.
    shared = documents.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = pickle.loads(shared.value).scorer()
        for texts in batches:
            rows = [t if isinstance(t, str) else None for t in texts]
            yield pd.Series(np.concatenate([run(rows[k : k + 500]) for k in range(0, len(rows), 500)] or [np.empty(0)]))

    return documents.withColumn("toxicity", judge(F.col(text)))


def source_rates(scored: DataFrame, flag_at: float = FLAG_AT) -> DataFrame:
    """Per source: texts, flagged texts, their rate and the mean score."""
    flagged = F.sum((F.col("toxicity") >= flag_at).cast("long"))
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), flagged.alias("flagged"), (flagged / F.count(F.lit(1))).alias("rate"), F.avg("toxicity").alias("mean_score")
    )
