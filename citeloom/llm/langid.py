"""Problem 5: languages of texts and of their segments, by rank-order profiles (out-of-place distance).

A language's profile is its most frequent character n-grams (1 to 4, with word borders) in frequency order. A text's n-grams are
ranked the same way; its distance to a language is the sum, over its n-grams, of how far each stands from its place in
the profile (at most ``PROFILE``). The nearest language wins; confidence is its share of the softened closeness of all.
Sentences are judged one by one; those too short or too close to call take the language of the surrounding text. Runs of
one language form segments.

Scale: profiles are counted on the executors over a bounded, documented sample of labelled texts (``SAMPLE`` different ones a language,
smallest hash first, taken in one pass) and are a few thousand short strings, broadcast. Judging is a narrow map.

A text or sentence far from every profile is of an unknown language (``und``).

Defined results: handles, links, hashtags, emoji, and quoted and bracketed asides within a sentence don't speak for a language; segments cover the text; null, empty and wordless
texts have no language (null, confidence 0, no segment); very long texts are judged whole, sentence by sentence; repeated rows
are judged each; an empty table gives no rows; other columns are kept by ``identify``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.llm.text import HANDLE, URL, fold

#: The language of what is far from every profile.
UNKNOWN = "und"
#: Mean out-of-place distance from which no profile is near (sentences of the profiled languages stay below 0.56).
FOREIGN = 0.56
#: n-grams in a profile, and labelled rows of each language it is made from.
PROFILE, SAMPLE = 1200, 1500
GRAMS = 4
#: Words that a sentence must have to speak for itself, and the lead of the nearest language (share of the runner-up's distance).
LEAST_WORDS, LEAD = 4, 0.04
#: Confidence that a run of sentences must reach to stand as a segment of its own.
SURE = 0.8
#: Softness of the confidence.
SOFT = 0.03
CACHE_WORDS = 200_000

SENTENCE = regex.compile(r"(?<=[.!?…])[\"'”’»)]*\s+(?=[^\p{Ll}])|\n+|(?<=[!?…])\s+")
ASIDE = regex.compile(r"«[^»]*»|\([^)]*\)|\[[^\]]*\]|“[^”]*”|„[^“]*“|\"[^\"]*\"")
TAG = regex.compile(r"#[\p{L}\p{N}_]+")
CODE = regex.compile(r"[\p{L}\p{N}_\-]*\p{N}[\p{L}\p{N}_\-]*")
LETTERS = regex.compile(r"\p{L}+")
#: Usual spellings of language labels.
SPELLINGS = {
    "de": "de deu ger german deutsch allemand alemán aleman tedesco",
    "en": "en eng english englisch anglais inglés ingles inglese",
    "es": "es spa esp spanish spanisch espagnol español espanol castellano spagnolo",
    "fr": "fr fra fre french französisch franzoesisch franzosisch français francais francés frances francese",
    "it": "it ita italian italienisch italien italiano",
}
LABELS = {fold(name): code for code, names in SPELLINGS.items() for name in names.split()}


def known_label(label: str | Column) -> Column:
    """The language code that a label names; null for missing, undetermined and unknown labels."""
    text = F.lower(F.trim(F.col(label) if isinstance(label, str) else label))
    first = F.element_at(F.split(text, r"[-_\s(]"), 1)
    accents = F.translate(first, "äöüàâçéèêñ", "aouaaceeen")
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return table[accents]


def speaking_part(text: str) -> str:
    """A text with blanks in place of the parts that don't speak for its language."""

    def blank(m: regex.Match) -> str:
        return " " * len(m[0])

    if "://" in text or "www." in text.lower():
        text = URL.sub(blank, text)
    if "@" in text:
        text = HANDLE.sub(blank, text)
    if "#" in text:
        text = TAG.sub(blank, text)
    return text


def language_words(sentence: str) -> list[str]:
    """Folded words of a sentence without quoted and bracketed asides (unless it is nothing else) and code-like names."""
    own = CODE.sub(" ", sentence)
    return LETTERS.findall(fold(ASIDE.sub(" ", own))) or LETTERS.findall(fold(own))


def word_grams(word: str) -> list[str]:
    """Character n-grams of a word with its borders."""
    w = f"_{word}_"
    return [w[i : i + n] for n in range(1, GRAMS + 1) for i in range(len(w) - n + 1) if n > 1 or w[i] != "_"]


def profiles(df: DataFrame, text: str = "text", label: str = "lang", sample: int = SAMPLE, size: int = PROFILE) -> dict[str, list[str]]:
    """Profiles of the languages that ``label`` names, most frequent n-gram first."""
    rows = df.select(F.col(text).alias("t"), known_label(label).alias("l")).filter("t IS NOT NULL AND l IS NOT NULL")
    # Smallest hashes first: a bound of the hash, from the label counts, leaves some four times the sample to sort.
    sizes = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}
    place = F.shiftrightunsigned(F.xxhash64("t"), 1)
    bound = F.lit(0).cast("bigint")
    for code, n in sizes.items():
        bound = F.when(F.col("l") == code, F.lit(min(2**63 - 1, (2**63 - 1) // n * 4 * sample))).otherwise(bound)
    few = rows.withColumn("p", place).filter(F.col("p") <= bound).dropDuplicates(["l", "t"])
    order = Window.partitionBy("l").orderBy("p", "t")
    chosen = few.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample).select("l", "t").repartition("t")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, Counter] = {}
        for batch in batches:
            for t, code in zip(batch["t"], batch["l"]):
                total.setdefault(code, Counter()).update(language_words(speaking_part(t)))
        for code, words in total.items():
            # The n-grams of a word once, however often it stands.
            found: Counter = Counter()
            for w, n in words.items():
                for g in word_grams(w):
                    found[g] += n
            yield pd.DataFrame({"l": code, "g": list(found), "n": list(found.values())})

    counts = chosen.mapInPandas(count, "l string, g string, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    ranked = counts.groupBy("l").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "g"))), 1, size).alias("top"))
    return {r.l: [x.g for x in r.top] for r in ranked.collect()}


class Judge:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, made: dict[str, list[str]]) -> None:
        self.codes = sorted(made)
        self.size = max((len(v) for v in made.values()), default=1)
        grams = sorted({g for v in made.values() for g in v})
        self.row = {g: i for i, g in enumerate(grams)}
        self.place = np.full((len(grams) + 1, len(self.codes)), -1.0)
        for k, code in enumerate(self.codes):
            for rank, g in enumerate(made[code]):
                self.place[self.row[g], k] = rank
        self.cache: dict[str, np.ndarray] = {}

    def grams(self, words: list[str]) -> np.ndarray:
        """n-grams of words as numbers: the place in the sorted profile n-grams, behind them a hash for others."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = np.array([self.row.get(g, len(self.row) + zlib.crc32(g.encode())) for g in word_grams(w)], dtype=np.int64)
        return np.concatenate([cache[w] for w in words]) if words else np.empty(0, dtype=np.int64)

    def distances(self, found: np.ndarray) -> np.ndarray | None:
        """Mean out-of-place distance of a text's n-grams to each language, in [0, 1]; None without n-grams."""
        if not len(found) or not self.codes:
            return None
        grams, counts = np.unique(found, return_counts=True)
        grams = grams[np.lexsort((grams, -counts))]
        place = self.place[np.minimum(grams, len(self.row))]
        own = np.minimum(np.arange(len(grams)), self.size)[:, None]
        gap = np.where(place < 0, self.size, np.minimum(np.abs(place - own), self.size))
        return gap.mean(axis=0) / self.size

    def closeness(self, d: np.ndarray) -> np.ndarray:
        """Shares of the languages in the softened closeness."""
        near = np.exp(-(d - d.min()) / SOFT)
        return near / near.sum()

    def sure(self, d: np.ndarray, code: str) -> float:
        """Confidence that n-grams at these distances are of a language; of an unknown one, how far they are from all."""
        if code == UNKNOWN:
            return float(np.clip(0.5 + 2 * (d.min() - FOREIGN), 0.0, 1.0))
        return float(self.closeness(d)[self.codes.index(code)])

    def verdict(self, d: np.ndarray | None) -> tuple[str | None, float, float]:
        """(language, confidence, lead over the runner-up) at distances to all languages."""
        if d is None:
            return None, 0.0, 0.0
        best = int(np.argmin(d))
        if d[best] > FOREIGN:
            return UNKNOWN, self.sure(d, UNKNOWN), 1.0
        rest = np.delete(d, best)
        lead = float(1 - d[best] / rest.min()) if len(rest) and rest.min() > 0 else 1.0
        return self.codes[best], float(self.closeness(d)[best]), lead

    def judge(self, found: np.ndarray) -> tuple[str | None, float, float]:
        """(language, confidence, lead over the runner-up) of n-grams."""
        return self.verdict(self.distances(found))

    def segments(self, text: str | None) -> tuple[str | None, float, list[tuple[str, float, int, int, int]]]:
        """(main language, confidence, segments as (language, confidence, words, start, end)); the segments cover the text."""
        text = text or ""
        said = speaking_part(text)
        starts: list[int] = []
        sizes: list[int] = []
        grams: list[np.ndarray] = []
        at = 0
        for end in [*(m.end() for m in SENTENCE.finditer(said)), len(said)]:
            words = language_words(said[at:end]) if at < end else []
            if words:
                starts.append(at)
                sizes.append(len(words))
                grams.append(self.grams(words))
            at = end
        known: dict[tuple[int, int], np.ndarray | None] = {}

        def between(i: int, j: int) -> np.ndarray | None:
            # Distances of sentences i to j - 1; short texts ask for the same ones again and again.
            if (i, j) not in known:
                known[i, j] = self.distances(grams[i] if j == i + 1 else np.concatenate(grams[i:j])) if i < j else None
            return known[i, j]

        main, sure, _ = self.verdict(between(0, len(grams)))
        if main is None:
            return None, 0.0, []
        clear = []
        for i, n in enumerate(sizes):
            code, _, lead = self.verdict(between(i, i + 1)) if n >= LEAST_WORDS else (None, 0.0, 0.0)
            clear.append((code if lead >= LEAD else None, i, i + 1))
        # Sentences that can't speak for themselves follow the one before, else the first that can, else the whole.
        runs = self._joined(clear, main)
        # A run that isn't sure enough joins its neighbours.
        runs = self._joined([(code if sum(sizes[i:j]) > LEAST_WORDS and self.sure(between(i, j), code) >= SURE else None, i, j) for code, i, j in runs], main)
        amount: Counter = Counter()
        for code, i, j in runs:
            amount[code] += sum(sizes[i:j])
        first = amount.most_common(1)[0][0]
        borders = [0, *(starts[i] for _, i, _ in runs[1:]), len(text)]
        done = [(code, self.sure(between(i, j), code), sum(sizes[i:j]), borders[k], borders[k + 1]) for k, (code, i, j) in enumerate(runs)]
        return first, sure if first == main else max(p for c, p, _, _, _ in done if c == first), done

    @staticmethod
    def _joined(parts: list[tuple[str | None, int, int]], main: str) -> list[tuple[str, int, int]]:
        """Neighbouring parts (language or None, first sentence, behind the last) of one language made one."""
        last = next((code for code, _, _ in parts if code), main)
        out: list[tuple[str, int, int]] = []
        for code, i, j in parts:
            last = code or last
            if out and out[-1][0] == last:
                out[-1] = (last, out[-1][1], j)
            else:
                out.append((last, i, j))
        return out


def identify(df: DataFrame, made: dict[str, list[str]], text: str = "text") -> DataFrame:
    """``df`` with ``found_lang``, ``confidence`` and ``segments`` (array of lang, confidence, words, start_at, end_at); replaced if they exist."""
    shared = df.sparkSession.sparkContext.broadcast(made)
    names = ["lang", "confidence", "words", "start_at", "end_at"]

    @F.pandas_udf("found_lang string, confidence double, segments array<struct<lang:string,confidence:double,words:int,start_at:int,end_at:int>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Judge(shared.value)
        for texts in batches:
            rows = [own.segments(t if isinstance(t, str) else None) for t in texts]
            listed = [[dict(zip(names, s)) for s in r[2]] for r in rows]
            yield pd.DataFrame({"found_lang": [r[0] for r in rows], "confidence": [r[1] for r in rows], "segments": listed})

    # Called non-deterministic, so that a filter on the result doesn't run it twice.
    out = ["found_lang", "confidence", "segments"]
    return df.withColumn("__j", judge.asNondeterministic()(F.col(text))).withColumns({n: F.col("__j")[n] for n in out}).drop("__j")


def label_faults(df: DataFrame, made: dict[str, list[str]], text: str = "text", label: str = "lang") -> DataFrame:
    """``identify`` plus ``label_code``, ``languages`` (those known) and ``fault`` (missing, wrong, mixed or null; null for an unknown language)."""
    found = identify(df, made, text).withColumn("label_code", known_label(label))
    spoken = F.array_remove(F.array_distinct(F.transform("segments", lambda s: s["lang"])), UNKNOWN)
    fault = (
        F.when(F.size("languages") == 0, F.lit(None))
        .when(F.size("languages") > 1, "mixed")
        .when(F.col("label_code").isNull(), "missing")
        .when(F.col("label_code") != F.col("found_lang"), "wrong")
    )
    return found.withColumn("languages", spoken).withColumn("fault", fault)
