"""Problem 7: token ids of every text by a byte-level BPE vocabulary, by speculate and verify.

Each Arrow batch is split into words by the vocabulary's pattern and its distinct words are encoded once:

1. speculate: greedy longest match proposes tokens;
2. verify: a proposal is the true encoding exactly when every adjacent pair of its tokens is compatible, i.e. merging the
   pair's joined bytes gives the pair back. All pairs of the batch are coded as one integer array; the distinct codes are looked up in the
   table of judged pairs by binary search, and only unseen pairs are judged;
3. only words with a failing pair undergo exact merging.

Scale: a narrow map without shuffle. The rank file (about 1 MB, checked against ``MAX_RANK_BYTES``) is read on the driver
and broadcast. Word caches are emptied at a fixed size; that changes no result.

Defined results: null and empty texts give an empty list; white-space texts are encoded like any other; texts of any length are
encoded whole (exact merging uses a heap, so a word of n bytes costs n log n); repeated rows stay; other columns are kept by
``encode`` as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the split pattern of the public byte_bpe_50k vocabulary, white space written as the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Largest rank file that may be broadcast.
MAX_RANK_BYTES = 64 << 20
CACHE_WORDS = 500_000
#: Judged pairs a worker keeps.
CACHE_PAIRS = 2_000_000


class Encoder:
    """Byte-level BPE over a rank table (``bytes -> id``, smaller id merges first)."""

    def __init__(self, rank_lines: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_lines.splitlines() if line)}
        self.longest = max(map(len, self.ranks))
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.base = max(self.bytes_of) + 1
        self.split = regex.compile(PATTERN)
        self.pair_codes = np.empty(0, dtype=np.int64)
        self.pair_good = np.empty(0, dtype=bool)
        self.cache: dict[str, np.ndarray] = {}
        # Longest token that starts with each two-byte prefix: bounds the greedy search.
        self.reach: dict[bytes, int] = {}
        for token in self.ranks:
            if len(token) > 1:
                self.reach[token[:2]] = max(self.reach.get(token[:2], 0), len(token))

    def greedy(self, word: bytes) -> list[int]:
        """Longest-match tokens from the left."""
        ranks, out, at, end = self.ranks, [], 0, len(word)
        while at < end:
            for size in range(min(self.reach.get(word[at : at + 2], 1), end - at), 0, -1):
                found = ranks.get(word[at : at + size])
                if found is not None:
                    out.append(found)
                    at += size
                    break
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the adjacent pair of lowest rank, leftmost first."""
        ranks, size = self.ranks, len(word)
        start, end = list(range(size)), list(range(1, size + 1))
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = []
        for i in range(size - 1):
            r = ranks.get(word[i : i + 2])
            if r is not None:
                heap.append((r, i, 1, 1))
        heapq.heapify(heap)
        alive = [True] * size
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else size
            # A stale entry no longer describes the two pieces that stand here now.
            if j >= size or end[i] - start[i] != left or end[j] - start[j] != right:
                continue
            end[i], alive[j], after[i] = end[j], False, after[j]
            if after[j] < size:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < size:
                    r = ranks.get(word[start[a] : end[b]])
                    if r is not None:
                        heapq.heappush(heap, (r, a, end[a] - start[a], end[b] - start[b]))
        return [ranks[word[start[i] : end[i]]] for i in range(size) if alive[i]]

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """Which pair codes (left * base + right) survive exact merging of their joined bytes."""
        unique, back = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.pair_codes, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = at < len(self.pair_codes)
        known[inside] = self.pair_codes[at[inside]] == unique[inside]
        fresh = unique[~known]
        if len(fresh):
            judged = np.empty(len(fresh), dtype=bool)
            for k, code in enumerate(fresh.tolist()):
                left, right = divmod(code, self.base)
                judged[k] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            place = np.searchsorted(self.pair_codes, fresh)
            self.pair_codes, self.pair_good = np.insert(self.pair_codes, place, fresh), np.insert(self.pair_good, place, judged)
            at = np.searchsorted(self.pair_codes, unique)
        return self.pair_good[at][back]

    def learn(self, words: list[str]) -> None:
        """Encode new distinct words into the cache."""
        raw = [w.encode("utf-8") for w in words]
        guesses = [self.greedy(w) for w in raw]
        sizes = np.fromiter(map(len, guesses), dtype=np.int64, count=len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), dtype=np.int64, count=int(sizes.sum()))
        wrong = np.zeros(len(words), dtype=bool)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), sizes)
            inner = owner[:-1] == owner[1:]
            good = self.compatible(flat[:-1][inner] * self.base + flat[1:][inner])
            wrong[owner[:-1][inner][~good]] = True
        for word, encoded, guess, bad in zip(words, raw, guesses, wrong.tolist()):
            self.cache[word] = np.array(self.merge(encoded) if bad else guess, dtype=np.int32)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; empty for null."""
        split = [self.split.findall(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if len(self.pair_codes) > CACHE_PAIRS:
            self.pair_codes, self.pair_good = self.pair_codes[:0], self.pair_good[:0]
        fresh = {w for ws in split for w in ws} - self.cache.keys()
        if fresh:
            self.learn(sorted(fresh))
        cache, none = self.cache, np.empty(0, dtype=np.int32)
        return [np.concatenate([cache[w] for w in ws]) if ws else none for ws in split]


def encoder_column(spark: SparkSession, text: str | Column, ranks_path: str = DEFAULT_RANKS) -> Column:
    """The ids of a text column as ``array<int>``."""
    with open(ranks_path, "rb") as file:
        raw = file.read(MAX_RANK_BYTES + 1)
    if len(raw) > MAX_RANK_BYTES:
        raise ValueError(f"{ranks_path} is larger than {MAX_RANK_BYTES} bytes")
    shared = spark.sparkContext.broadcast(raw)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for texts in batches:
            parts = [encoder.encode_all([t if isinstance(t, str) else None for t in texts.iloc[k : k + 500]]) for k in range(0, len(texts), 500)]
            yield pd.Series([x for part in parts for x in part], dtype=object)

    return ids(F.col(text) if isinstance(text, str) else text)


def encode(df: DataFrame, text: str, out: str = "ids", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """``df`` with the token ids of ``text`` in column ``out`` (replaced if it exists)."""
    return df.withColumn(out, encoder_column(df.sparkSession, text, ranks_path))
