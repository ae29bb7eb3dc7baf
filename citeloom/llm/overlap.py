"""Problem 1: same or nearly the same records across splits, by n-gram hashes and containment.

Both sides are reduced to word sequences and collapsed to distinct sequences ("classes"), so copies, however many, cost one
class. Two records overlap when their word edit distance is at most ``max(n, m) // 8``. The result are links between classes and the
members of classes; only ``cross_split_overlap`` expands them to pairs of ids.

Candidates: a training class of m words gives hashes of e + 1 disjoint word n-grams from its start on, e = m // 7 being the most edits any partner
may have, so at least one of them stands unchanged in a partner. For the first such n-gram (the i-th) the edits before it are i at most,
and those behind it are what is left. So an evaluation class of n words gives, for every training length that is allowed, only the n-grams at the
places where the i-th could stand; its hashes carry i and the training length up to ``STEP``. From ``LONG`` training words on there would be too many such places: those hashes
carry a range of lengths instead, and the place is compared in the join. Evaluation hashes are partitioned and training is scanned with
e + 1 hashes a record. A frequent n-gram meets only records of like length at like places, and the join keeps only pairs
whose 64-bit word signatures differ in 2 bits an edit at most (one edit takes out one word and puts in one), so pairs of a hot n-gram are compared in
passing and never stored. No cap. Containment of the evaluation record per training record (share of its distinct words) prunes, and the
word edit distance decides.

Scale: rows are hash-partitioned on 64-bit hashes; joins are equi-joins which Catalyst broadcasts only under its size threshold and AQE splits
when skewed; no cross join.

Defined results: null, empty and wordless texts never match; repeated rows count once; each pair of ids once; an empty table on
either side gives no rows; other columns are ignored; a null id is dropped (it cannot be reported).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.text import words
from citeloom.session import materialise

#: One changed word in so many.
WORDS_PER_EDIT = 8
#: Training texts of more words give hashes without place.
LONG = 56
#: Lengths in one range of shorter texts, and ratio of the lengths in one range of long texts.
STEP, RANGE = 4, 1.25
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_edit_distance(a: list[str], b: list[str], limit: int) -> int:
    """Word-level Levenshtein distance, or ``limit + 1`` when it is larger (bit-parallel, so of any length)."""
    start, end_a, end_b = 0, len(a), len(b)
    while start < end_a and start < end_b and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[start:end_a], b[start:end_b]
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    last = 1 << (len(a) - 1)
    up, down, score, left = full, 0, len(a), len(b)
    for y in b:
        same = places.get(y, 0)
        flat = same | down
        across = (((same & up) + up) ^ up) | same
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        left -= 1
        # Each word left can take off one.
        if score - left > limit:
            return limit + 1
        plus = (plus << 1 | 1) & full
        minus = (minus << 1) & full
        up = minus | (full & ~(flat | plus))
        down = plus & flat
    return min(score, limit + 1)


def edits_allowed(n: int, m: int) -> int:
    """Edits allowed between texts of n and m words."""
    return max(n, m) // WORDS_PER_EDIT


def partner_lengths(n: int) -> range:
    """Lengths that a partner of a text of n words may have, where any edit is allowed."""
    low = n
    while low > 1 and n - (low - 1) <= edits_allowed(n, low - 1):
        low -= 1
    high = n
    while high + 1 - n <= edits_allowed(n, high + 1):
        high += 1
    return range(max(low, WORDS_PER_EDIT - 1), high + 1)


def segments(m: int) -> tuple[int, int]:
    """(number, length) of the disjoint n-grams of a training text of m words."""
    most = m // (WORDS_PER_EDIT - 1)
    return most + 1, m // (most + 1)


def places(n: int, m: int) -> Iterator[tuple[int, int, int]]:
    """(i, start in an evaluation text of n words, length) where the i-th n-gram of a training text of m words may stand first unchanged."""
    edits, (_, size) = edits_allowed(n, m), segments(m)
    for i in range(edits + 1):
        for shift in range(max(-i, n - m - (edits - i)), min(i, n - m + (edits - i)) + 1):
            start = i * size + shift
            if 0 <= start <= n - size:
                yield i, start, size


def length_range(m: int) -> int:
    """The range of lengths that a long training text is in."""
    return int(math.log(m) / math.log(RANGE))


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all word ``size``-grams of the rows of a matrix of word hashes."""
    out = np.zeros((len(codes), codes.shape[1] - size + 1), dtype=np.uint64)
    for k in range(size):
        out = out * _BASE + codes[:, k : codes.shape[1] - size + 1 + k]
    return out ^ out >> np.uint64(29)


def _key(gram: np.ndarray, *marks: int) -> np.ndarray:
    for x in marks:
        gram = (gram ^ np.uint64(x + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        gram = gram ^ gram >> np.uint64(31)
    return gram


def _keys_of(codes: np.ndarray, train: bool, plan: dict[int, list] | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """(hashes, start or -1) of texts of one length, given as a matrix of word hashes; ``plan`` keeps what is wanted of each length."""
    n = codes.shape[1]
    made: dict[int, np.ndarray] = {}

    def grams(size: int) -> np.ndarray:
        if size not in made:
            made[size] = _grams(codes, size)
        return made[size]

    if train:
        count, size = segments(n)
        for i in range(count):
            yield (_key(grams(size)[:, i * size], 1, n // STEP, i), -1) if n <= LONG else (_key(grams(size)[:, i * size], 2, length_range(n)), i * size)
        return
    plan = {} if plan is None else plan
    if n not in plan:
        plan[n] = _wanted(n)
    for kind, mark, i, start, size in plan[n]:
        yield (_key(grams(size)[:, start], 1, mark, i), -1) if kind == 1 else (_key(grams(size)[:, start], 2, mark), start)


def _wanted(n: int) -> list[tuple[int, int, int, int, int]]:
    """(kind, range of training lengths, i, start, size) of the n-grams of an evaluation text of n words."""
    out, ranges = set(), set()
    for m in partner_lengths(n):
        if m > LONG:
            ranges.add((length_range(m), segments(m)[1]))
        else:
            out |= {(1, m // STEP, *at) for at in places(n, m)}
    return sorted(out) + [(2, mark, 0, start, size) for mark, size in sorted(ranges) for start in range(n - size + 1)]


def _hashed(classes: DataFrame, train: bool) -> DataFrame:
    """``c, n, s, g, p``: the hashes of classes (c, w), with length, word signature and place (-1 where the hash has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        plan: dict[int, list] = {}
        for batch in batches:
            rows = [(w.split(" "), c) for c, w in zip(batch.column("c").to_pylist(), batch.column("w").to_pylist())]
            rows = sorted((x for x in rows if len(x[0]) >= WORDS_PER_EDIT - 1), key=lambda x: len(x[0]))
            if len(known) > 500_000:
                known.clear()
            for n, same in groupby(rows, key=lambda x: len(x[0])):
                texts, ids = zip(*same)
                for w in {w for t in texts for w in t}.difference(known):
                    known[w] = xxhash.xxh64_intdigest(w)
                codes = np.array([[known[w] for w in t] for t in texts], dtype=np.uint64)
                sign = np.bitwise_or.reduce(np.uint64(1) << (codes & np.uint64(63)), axis=1).view(np.int64)
                found = list(_keys_of(codes, train, plan))
                if not found:
                    continue
                ends = pa.array(np.arange(0, len(ids) * len(found) + 1, len(found)), pa.int32())
                hashes = np.ascontiguousarray(np.stack([g for g, _ in found], axis=1)).view(np.int64).ravel()
                at = np.tile(np.array([p for _, p in found], dtype=np.int32), len(ids))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (hashes, at)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([n] * len(ids), pa.int32()), pa.array(sign), *lists], ["c", "n", "s", "gs", "ps"])

    rows = classes.select("c", "w").mapInArrow(run, "c binary, n int, s long, gs array<long>, ps array<int>")
    return rows.select("c", "n", "s", F.explode(F.arrays_zip(F.col("gs").alias("g"), F.col("ps").alias("p"))).alias("x")).select("c", "n", "s", "x.g", "x.p")


def _classes(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members: id, c), (classes: c, w) of the texts with words."""

    def normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            plain = [" ".join(words(t)) for t in batch["t"]]
            yield pd.DataFrame({"id": batch["id"], "c": [xxhash.xxh128_digest(w) for w in plain], "w": plain})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("t")).filter("id IS NOT NULL AND t IS NOT NULL")
    rows = materialise(rows.mapInPandas(normalise, f"id {kind}, c binary, w string").filter("w != ''"), "words")
    return rows.select("id", "c").distinct(), rows.select("c", "w").dropDuplicates(["c"])


def near_classes(train: DataFrame, held: DataFrame) -> DataFrame:
    """Links (tc, ec, edits, containment) between different classes within the allowed distance; inputs: c, w."""
    t = _hashed(train, True).select("g", F.col("c").alias("tc"), F.col("n").alias("tn"), F.col("s").alias("ts"), F.col("p").alias("tp"))
    e = _hashed(held, False).select("g", F.col("c").alias("ec"), F.col("n").alias("en"), F.col("s").alias("es"), F.col("p").alias("ep"))
    limit = F.floor(F.greatest("tn", "en") / WORDS_PER_EDIT).cast("int")
    fits = (t["g"] == e["g"]) & (F.abs(F.col("tn") - F.col("en")) <= limit) & (F.abs(F.col("tp") - F.col("ep")) <= limit) & (F.col("tc") != F.col("ec"))
    alike = F.bit_count(F.col("ts").bitwiseXOR(F.col("es"))) <= 2 * limit
    pairs = t.join(e, fits & alike).select("tc", "ec").distinct()
    both = pairs.join(train.select(F.col("c").alias("tc"), F.col("w").alias("tw")), "tc").join(held.select(F.col("c").alias("ec"), F.col("w").alias("ew")), "ec")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tc, ec, tw, ew in zip(batch["tc"], batch["ec"], batch["tw"], batch["ew"]):
                a, b = tw.split(" "), ew.split(" ")
                most, own = edits_allowed(len(a), len(b)), set(b)
                kept = len(own.intersection(a))
                if kept >= len(own) - most:
                    edits = word_edit_distance(a, b, most)
                    if edits <= most:
                        out.append((tc, ec, edits, kept / len(own)))
            yield pd.DataFrame(out, columns=["tc", "ec", "edits", "containment"])

    return both.select("tc", "ec", "tw", "ew").mapInPandas(judge, "tc binary, ec binary, edits int, containment double")


def class_links(
    train: DataFrame, held: DataFrame, train_id: str = "qid", held_id: str = "qid", train_text: str = "text", held_text: str = "text"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links: tc, ec, edits, containment; training members: id, c; evaluation members: id, c): all overlaps, whatever the number of copies."""
    t_members, t = _classes(train, train_id, train_text)
    e_members, e = _classes(held, held_id, held_text)
    same = t.select(F.col("c").alias("tc")).join(e.select(F.col("c").alias("ec")), F.col("tc") == F.col("ec"))
    return same.select("tc", "ec", F.lit(0).alias("edits"), F.lit(1.0).alias("containment")).unionByName(near_classes(t, e)), t_members, e_members


def cross_split_overlap(
    train: DataFrame, held: DataFrame, train_id: str = "qid", held_id: str = "qid", train_text: str = "text", held_text: str = "text"
) -> DataFrame:
    """Pairs ``train_id, eval_id, edits, containment``, each pair of ids once with its smallest distance."""
    links, t_members, e_members = class_links(train, held, train_id, held_id, train_text, held_text)
    pairs = links.join(t_members.select(F.col("id").alias("train_id"), F.col("c").alias("tc")), "tc").join(
        e_members.select(F.col("id").alias("eval_id"), F.col("c").alias("ec")), "ec"
    )
    return pairs.groupBy("train_id", "eval_id").agg(F.min("edits").alias("edits"), F.max("containment").alias("containment"))


def overlap_report(train: DataFrame, held: DataFrame) -> DataFrame:
    """Per split and source: distinct evaluation records, those with an overlap, and overlaps with training records.

    Counted from class sizes, without a pair of ids. A record is an id with one of its texts.
    """
    links, t_members, e_members = class_links(train, held)
    sizes = t_members.groupBy(F.col("c").alias("tc")).agg(F.count(F.lit(1)).alias("k"))
    hits = links.join(sizes, "tc").groupBy("ec").agg(F.sum("k").alias("k"))
    per = e_members.join(hits, F.col("c") == F.col("ec")).groupBy(F.col("id").alias("eval_id")).agg(F.sum("k").alias("k"))
    rows = held.select(F.col("qid").alias("eval_id"), "split", "source").distinct()
    return (
        rows.join(per, "eval_id", "left")
        .groupBy("split", "source")
        .agg(
            F.countDistinct("eval_id").alias("records"),
            F.countDistinct(F.when(F.col("k") > 0, F.col("eval_id"))).alias("overlapping"),
            F.coalesce(F.sum("k"), F.lit(0)).alias("pairs"),
        )
    )
