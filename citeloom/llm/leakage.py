"""Problem 8: passages of held-out items inside corpus texts, by a BM25 index of the items with block-max pruning.

The items are indexed; every corpus text is a query, passage by passage. A posting's weight is BM25 (query term frequency 1)
divided by the item's own threshold: the least score that any half of the item can have after its costliest tenth of words
(and one more) is lost. So every passage that holds half of an item scores at least 1, and nothing that can be a case is pruned. Postings are grouped in
blocks of consecutive items with the block's maximum weight, as in block-max WAND. All passages of a batch of texts are looked up together:
first a passage's sum of its terms' maxima, then its sum of block maxima, then, in the blocks whose bound reaches the threshold, the exact
score. (As a threshold, not a k-th best, decides, bounds are summed term by term; there is no pivot order.) All items of score 1 or more are
verified: an alignment must have a stretch with at least half of the item's words, in order, of which at most one in ten differs.

Scale: the corpus is scanned once, whatever the number of items, in a narrow map without any shuffle of texts. The index is built by Spark: document
frequencies and lengths over all items, then one index for each range of item lengths (so that a long item doesn't lengthen the passages of
short ones) and ``BLOCK_WORDS`` words of items, written to the shared folder. A task takes ``BATCH_ROWS`` texts at a time and reads one index after the
other (all stay in memory where they are together under ``HELD_BYTES``). Passages overlap by half, so a text of any length is scanned
whole in linear time. The driver sees counts only.

Defined results: null, empty and wordless texts and items give no rows; items under ``LEAST_WORDS`` words are matched only whole and
exactly; repeated rows give a pair once; a null id is dropped; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.text import plain_words
from citeloom.session import materialise, open_shared

K1, B = 1.2, 0.75
#: One differing word in so many.
WORDS_PER_EDIT = 10
#: Shorter items have no half that could be told from chance.
LEAST_WORDS = 8
#: Items in a posting block.
POSTING_BLOCK = 8
#: Words of items in one index, texts gathered for a pass over all indexes, texts looked up together, and bytes of indexes that a task keeps in memory.
BLOCK_WORDS, BATCH_ROWS, TOGETHER, HELD_BYTES = 500_000, 20_000, 2_000, 128 << 20
#: Ratio of the item lengths that share an index, and sums held at a time.
RANGE, CELLS = 4, 4_000_000
SEED = 3
#: Sums this close below 1 count as 1.
NEAR = 1e-9


def half_of(words: int) -> int:
    """Words of an item that a passage must hold."""
    return max(1, math.ceil(words / 2)) if words >= LEAST_WORDS else words


def least_half(words: list[str], weight: dict[str, float]) -> float:
    """Least score of a window of half the words without its costliest words."""
    half = half_of(len(words))
    lost = half // WORDS_PER_EDIT + 1 if len(words) >= LEAST_WORDS else 0
    inside: Counter = Counter()
    own: list[float] = []
    total, best = 0.0, float("inf")
    for at, w in enumerate(words):
        if at >= half:
            gone = words[at - half]
            inside[gone] -= 1
            if not inside[gone]:
                del own[bisect_left(own, weight[gone])]
                total -= weight[gone]
        inside[w] += 1
        if inside[w] == 1:
            insort(own, weight[w])
            total += weight[w]
        if at >= half - 1:
            best = min(best, total - sum(own[len(own) - lost :]) if len(own) > lost else own[0])
    # The running total drifts by rounding.
    return max(best - NEAR, NEAR)


class ItemIndex:
    """BM25 postings of items, scaled so that 1 is each item's threshold."""

    def __init__(self, items: list[tuple[int, list[str]]], df: dict[str, int] | None = None, count: int | None = None, average: float | None = None) -> None:
        """``df``, ``count`` and ``average`` length are those of all items, where these are only some of them."""
        items = sorted(items, key=lambda x: (" ".join(x[1][:3]), x[0]))
        df = df or Counter(t for _, w in items for t in set(w))
        count = count or len(items)
        average = average or sum(len(w) for _, w in items) / max(1, len(items))
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.half = [half_of(len(w)) for w in self.words]
        self.span = max(self.half, default=1)
        self.seeds: dict[int, dict[tuple, list[int]]] = {}
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, w in enumerate(self.words):
            norm = K1 * (1 - B + B * len(w) / average)
            weight = {t: math.log(1 + (count - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm) for t, tf in Counter(w).items()}
            least = least_half(w, weight)
            for t, x in weight.items():
                postings[t].append((k, x / least))
        self.term = {t: i for i, t in enumerate(postings)}
        sizes = [len(p) for p in postings.values()]
        self.start = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.item = np.array([k for p in postings.values() for k, _ in p], dtype=np.int64)
        self.weight = np.array([x for p in postings.values() for _, x in p])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.blocks = max(1, -(-len(items) // POSTING_BLOCK))
        code, first = np.unique(owner * self.blocks + self.item // POSTING_BLOCK, return_index=True)
        self.block_term, self.block = code // self.blocks, code % self.blocks
        self.block_max = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.block_start = np.searchsorted(self.block_term, np.arange(len(sizes) + 1))
        self.term_max = np.maximum.reduceat(self.weight, self.start[:-1]) if len(sizes) else np.empty(0)

    @staticmethod
    def _gather(terms: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of all entries of the given terms, the place in ``terms`` that each is for)."""
        sizes = start[terms + 1] - start[terms]
        owner = np.repeat(np.arange(len(terms)), sizes)
        return np.arange(len(owner)) + np.repeat(start[terms] - np.r_[0, np.cumsum(sizes)[:-1]], sizes), owner

    def passages(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text of each passage, and per distinct term of a hopeful passage its passage and code), of all texts."""
        term, span = self.term, self.span
        sizes = np.array([len(w) for w in texts], dtype=np.int64)
        counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - span) // span)), 0)
        base = np.r_[0, np.cumsum(counts)]
        codes = np.array([term.get(w, -1) for words in texts for w in words], dtype=np.int64)
        known = np.nonzero(codes >= 0)[0]
        doc = np.repeat(np.arange(len(texts)), sizes)[known]
        step = (known - np.r_[0, np.cumsum(sizes)[:-1]][doc]) // span
        # A word is in the passage that starts in its own step and in the one before.
        own, before = step < counts[doc], step > 0
        place = np.concatenate([(base[doc] + step)[own], (base[doc] + step - 1)[before]])
        code = np.concatenate([codes[known][own], codes[known][before]])
        # Repeated words only raise this first bound.
        hopeful = (np.bincount(place, self.term_max[code], minlength=base[-1]) >= 1 - NEAR)[place]
        width = max(1, len(term))
        pair = np.unique(place[hopeful] * width + code[hopeful])
        return np.repeat(np.arange(len(texts)), counts), pair // width, pair % width

    def candidates(self, texts: list[list[str]]) -> list[tuple[int, int]]:
        """(text, item) of all items that score at least 1 for a passage of a text."""
        doc, place, code = self.passages(texts)
        hopeful = np.bincount(place, self.term_max[code], minlength=len(doc)) >= 1 - NEAR
        keep = hopeful[place]
        place, code = place[keep], code[keep]
        # Numbers of the passages that are left.
        left, place = np.unique(place, return_inverse=True)
        found: set[tuple[int, int]] = set()
        step = max(1, CELLS // max(self.blocks, len(self.ids)))
        borders = np.searchsorted(place, np.arange(0, len(left) + step, step))
        for k, (a, b) in enumerate(zip(borders[:-1], borders[1:])):
            own, terms = place[a:b] - k * step, code[a:b]
            size = min(step, len(left) - k * step)
            at, who = self._gather(terms, self.block_start)
            bound = np.bincount(own[who] * self.blocks + self.block[at], self.block_max[at], minlength=size * self.blocks)
            alive = (bound >= 1 - NEAR).reshape(size, self.blocks)
            some = alive.any(axis=1)[own]
            at, who = self._gather(terms[some], self.start)
            who = own[some][who]
            good = alive[who, self.item[at] // POSTING_BLOCK]
            at, who = at[good], who[good]
            width = len(self.ids)
            score = np.bincount(who * width + self.item[at], self.weight[at], minlength=size * width)
            for p in np.nonzero(score >= 1 - NEAR)[0].tolist():
                found.add((int(doc[left[k * step + p // width]]), p % width))
        return sorted(found)

    def _seeds(self, k: int) -> dict[tuple, list[int]]:
        if k not in self.seeds:
            at: dict[tuple, list[int]] = defaultdict(list)
            for p in range(len(self.words[k]) - SEED + 1):
                at[tuple(self.words[k][p : p + SEED])].append(p)
            self.seeds[k] = dict(at)
        return self.seeds[k]

    def holds(self, words: list[str], k: int) -> tuple[int, int] | None:
        """(matched words, differing words) of the best stretch of item ``k`` in a text, or None."""
        item, half = self.words[k], self.half[k]
        seeds = self._seeds(k)
        if len(item) < LEAST_WORDS:
            hit = any(words[a : a + len(item)] == item for a in range(len(words) - len(item) + 1))
            return (len(item), 0) if hit else None
        diagonals: Counter = Counter()
        for p in range(len(words) - SEED + 1):
            for q in seeds.get(tuple(words[p : p + SEED]), ()):
                diagonals[(p - q) // len(item)] += 1
        best = None
        tried = set()
        for d, _ in diagonals.most_common():
            near = diagonals[d] + max(diagonals[d - 1], diagonals[d + 1])
            # Of the stretch's seeds each differing word breaks three at most.
            if near < 0.7 * half - 2 or d in tried:
                continue
            tried.add(d)
            low, high = max(0, (d - 1) * len(item)), (d + 3) * len(item)
            found = self._stretch(item, words[low:high], half)
            if found and (best is None or found > best):
                best = found
        return best

    @staticmethod
    def _stretch(item: list[str], part: list[str], half: int) -> tuple[int, int] | None:
        """Longest aligned stretch of at least ``half`` item words with few enough differing ones."""
        blocks = [b for b in SequenceMatcher(None, item, part, autojunk=False).get_matching_blocks() if b.size]
        best = None
        for i in range(len(blocks)):
            same = errors = 0
            for j in range(i, len(blocks)):
                if j > i:
                    p, b = blocks[j - 1], blocks[j]
                    errors += max(b.a - p.a - p.size, b.b - p.b - p.size)
                same += blocks[j].size
                covered = blocks[j].a + blocks[j].size - blocks[i].a
                if covered >= half and errors * WORDS_PER_EDIT <= same + errors and (best is None or same > best[0]):
                    best = (same, errors)
        return best


def _indexes(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """One row for each index of items (column ``built``, pickled), written to the shared folder."""

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            w = [plain_words(t) for t in batch["t"]]
            n = [len(x) for x in w]
            yield pd.DataFrame({"i": batch["i"], "w": [" ".join(x) for x in w], "n": n, "r": [int(math.log(half_of(x), RANGE)) if x else 0 for x in n]})

    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct()
    rows = materialise(rows.mapInPandas(plain, "i long, w string, n int, r int").filter("n > 0").distinct(), "items")
    # A row for each range of lengths: their number is the logarithm of the longest item.
    ranges = {x.r: (x.k, x.n) for x in rows.groupBy("r").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()}
    count, total = (sum(x[j] for x in ranges.values()) for j in (0, 1))
    parts = F.lit(1)
    for r, (_, n) in ranges.items():
        parts = F.when(F.col("r") == r, F.lit(-(-n // BLOCK_WORDS))).otherwise(parts)
    terms = F.array_distinct(F.split("w", " "))
    df = rows.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    each = rows.withColumn("part", F.pmod(F.xxhash64("i", "w"), parts)).select("i", "w", "r", "part", F.explode(terms).alias("term")).join(df, "term")
    known = each.groupBy("i", "w", "r", "part").agg(F.collect_list("term").alias("terms"), F.collect_list("df").alias("dfs"))

    def build(own: pd.DataFrame) -> pd.DataFrame:
        frequency = {t: int(d) for ts, ds in zip(own["terms"], own["dfs"]) for t, d in zip(ts, ds)}
        index = ItemIndex([(int(i), w.split(" ")) for i, w in zip(own["i"], own["w"])], frequency, count, total / count)
        return pd.DataFrame({"built": [pickle.dumps(vars(index), protocol=5)]})

    return materialise(known.groupBy("r", "part").applyInPandas(build, "built binary"), "index")


def _loaded(path: str) -> Iterator[ItemIndex]:
    with open_shared(path) as f:
        file = pq.ParquetFile(f)
        for batch in file.iter_batches(batch_size=1):
            for built in batch.column("built"):
                index = ItemIndex.__new__(ItemIndex)
                vars(index).update(pickle.loads(built.as_buffer()))
                yield index


def leaked_passages(corpus: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, matched, differing``: every text that holds at least half of an item as one passage."""
    built = _indexes(items, item_id, item_text)
    files = built.inputFiles()
    small = (built.agg(F.sum(F.length("built"))).first()[0] or 0) <= HELD_BYTES

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [index for path in files for index in _loaded(path)] if small else None

        def look_up(docs: list, texts: list[list[str]]) -> pd.DataFrame:
            out = []
            for index in held if held is not None else (x for path in files for x in _loaded(path)):
                for a in range(0, len(texts), TOGETHER):
                    for at, k in index.candidates(texts[a : a + TOGETHER]):
                        found = index.holds(texts[a + at], k)
                        if found:
                            out.append((docs[a + at], index.ids[k], *found))
            return pd.DataFrame(out, columns=["doc_id", "item_id", "matched", "differing"])

        docs: list = []
        texts: list[list[str]] = []
        for batch in batches:
            docs += batch["id"].tolist()
            texts += [plain_words(t) for t in batch["t"]]
            # With indexes read anew each time, more texts are gathered before.
            if held is not None or len(docs) >= BATCH_ROWS:
                yield look_up(docs, texts)
                docs, texts = [], []
        if docs:
            yield look_up(docs, texts)

    rows = corpus.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).filter("id IS NOT NULL AND t IS NOT NULL")
    found = rows.mapInPandas(scan, "doc_id long, item_id long, matched int, differing int")
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.min("differing").alias("differing"))
