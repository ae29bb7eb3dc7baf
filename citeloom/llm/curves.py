"""Problem 4: most similar vectors for every vector, by shifted Hilbert curves.

Vectors are normalised; equal directions are collapsed to one class (id: the smallest), of which the k + 1 smallest ids
can stand for it in lists. Each class is placed on several Hilbert curves: per curve a seeded orthonormal projection to
``DIMS`` dimensions, a random shift, ``BITS`` bits a dimension. Spark range-partitions and sorts the rows by (curve, key);
each task slides over its sorted rows and compares every row by exact cosine with all rows of its own and both neighbouring windows.
The k best of all curves are merged and reranked.

Accuracy: approximate. README.md gives the recall measured against brute force. A window does not reach over the
border of two tasks; the other curves, with other shifts, have other borders, so lists can differ a little with the number of tasks. With ``hold`` the
result has that recall over a sample of classes: the curves then give ``BREADTH`` candidates each, and where that isn't enough, rounds of merging follow in which
the neighbours of a class (and the classes it is a neighbour of) are compared with each other, so that neighbours of neighbours come in; from the second
round on also other curves. Comparisons a vector don't grow with the number of vectors. Only if ``ROUNDS`` rounds don't do, or a round adds
less than ``GAIN``, all pairs are compared in blocks (exact, quadratic).

Scale: rows shuffled are curves x classes, and 2 x ``BREADTH`` x classes in a round; work is linear in the rows. Only short lists leave
a task. Nothing is broadcast but the projections (a few kB, in the closure) and ``SAMPLE`` vectors.

Defined results: null, empty and zero vectors, vectors with a null, NaN or infinite value and vectors of another length than ``dim``
have no neighbours; ties go to the smaller id; a repeated id counts once; a null id is dropped; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.session import materialise

DIMS, BITS = 8, 7
#: Rows a task should hold at least.
TASK_ROWS = 20_000
#: Classes of a block of the exact comparison, and classes whose recall is measured.
BLOCK_ROWS, SAMPLE = 50_000, 300
#: Neighbours that a class keeps between rounds, those a curve gives, and rounds at most.
BREADTH, FROM_CURVE, ROUNDS = 24, 5, 5
#: Recall that a round must add for another to follow.
GAIN = 0.02
#: Rows whose neighbours are compared together: a pair found again among them is given once.
TOGETHER = 60_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells (rows x dims, each below 2**bits), by Gray-code axis transposition."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projections(dim: int, curves: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per curve a matrix of orthonormal columns and a shift in [0, 1) per dimension."""
    rng = np.random.default_rng(seed)
    dims = min(DIMS, dim)
    return [(np.linalg.qr(rng.standard_normal((dim, dims)))[0], rng.random(dims)) for _ in range(curves)]


def curve_keys(unit: np.ndarray, matrix: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Keys of unit vectors on one curve; coordinates of a projected unit vector lie about within 3 / sqrt(dim)."""
    spread = 3.0 / np.sqrt(unit.shape[1])
    place = (np.clip(unit @ matrix / spread, -1, 1) + 1) / 4 + shift / 2
    return hilbert_keys(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def unit_rows(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of usable vectors, their unit rows)."""
    at = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
    values = vectors.to_numpy()
    # A null in a list comes as NaN or None; either isn't finite as a float.
    rows = np.array([np.asarray(values[i], dtype=np.float64) for i in at]).reshape(len(at), dim)
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(rows, axis=1)
        good = np.isfinite(norm) & (norm > 0)
    return np.array(at, dtype=np.int64)[good], rows[good] / norm[good][:, None]


def best_in_windows(
    ids: np.ndarray, unit: np.ndarray, k: int, window: int, least: float, start: int = 0, last: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(id, neighbour, similarity) of the k best of each row from ``start`` on among its own and the neighbouring windows of sorted rows, and the row to go on with.

    Unless they are the ``last``, rows without a whole window behind theirs are left for later.
    """
    left, right, sims = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0)]
    end = len(ids) if last else start + max(0, (len(ids) - start) // window - 1) * window
    for a in range(start, end, window):
        low, high = max(0, a - window), min(len(ids), a + 2 * window)
        s = unit[a : min(a + window, len(ids))] @ unit[low:high].T
        here = np.arange(len(s))
        s[here, here + a - low] = -2
        if least > -1:
            rows, cols = np.nonzero(s >= least)
        else:
            part = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
            rows, cols = np.repeat(here, part.shape[1]), part.ravel()
        value = s[rows, cols]
        keep = value > -2
        rows, cols, value = rows[keep], cols[keep], value[keep]
        order = np.lexsort((ids[low + cols], -value, rows))
        rows, cols, value = rows[order], cols[order], value[order]
        top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        left.append(ids[a + rows[top]])
        right.append(ids[low + cols[top]])
        sims.append(value[top])
    return np.concatenate(left), np.concatenate(right), np.concatenate(sims), end


def best_of(ids: np.ndarray, unit: np.ndarray, others: np.ndarray, their: np.ndarray, k: int, least: float) -> pd.DataFrame:
    """``c, d, s``: the k best of each row among all other rows, by exact cosine, a slice of rows at a time."""
    if not len(ids) or not len(others):
        return pd.DataFrame({"c": ids[:0], "d": others[:0], "s": np.empty(0)})
    parts = []
    starts = np.arange(0, len(others), max(1, len(others) // 256))
    for a in range(0, len(ids), 256):
        s = unit[a : a + 256] @ their.T
        s[ids[a : a + 256, None] == others[None, :]] = -2
        # The k-th best of the maxima of column ranges is reached by k columns at least.
        high = np.maximum.reduceat(s, starts, axis=1)
        bound = np.partition(high, -k, axis=1)[:, -k] if high.shape[1] >= k else np.full(len(s), -1.5, dtype=s.dtype)
        rows, cols = np.nonzero(s >= np.maximum(bound, max(least, -1.5)).astype(s.dtype)[:, None])
        part = pd.DataFrame({"c": ids[a + rows], "d": others[cols], "s": s[rows, cols].astype(np.float64)})
        part = part.sort_values(["c", "s", "d"], ascending=[True, False, True])
        parts.append(part[part.groupby("c").cumcount() < k])
    return pd.concat(parts, ignore_index=True)


def _matrix(u: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(u), dtype=np.float32).reshape(-1, dim)


def all_pairs(classes: DataFrame, count: int, k: int, least: float, dim: int) -> DataFrame:
    """``c, d, s``: the k best of every class within each pair of blocks."""
    blocks = max(-(-count // BLOCK_ROWS), min(8, count // 4000 + 1))
    block = F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int")
    copies = classes.select("c", "u", block.alias("b")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = copies.select("c", "u", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        i, j = cell["i"].iloc[0], cell["j"].iloc[0]
        sides = [(part["c"].to_numpy(), _matrix(part["u"], dim)) for part in (cell[cell["b"] == i], cell[cell["b"] == j])]
        found = [best_of(*sides[0], *sides[1], k, least)]
        if i != j:
            found.append(best_of(*sides[1], *sides[0], k, least))
        return pd.concat(found, ignore_index=True)

    return cells.groupBy("i", "j").applyInPandas(compare, "c long, d long, s double")


def sample_recall(classes: DataFrame, pairs: DataFrame, k: int, least: float, dim: int) -> float:
    """Share of the true k best that ``pairs`` (c, d, s) holds, over ``SAMPLE`` classes in hash order."""
    chosen = classes.select("c", "u").orderBy(F.md5(F.col("c").cast("string"))).limit(SAMPLE).toPandas()
    ids, unit = chosen["c"].to_numpy(), _matrix(chosen["u"], dim)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield best_of(ids, unit, batch["c"].to_numpy(), _matrix(batch["u"], dim), k, least)

    found = classes.select("c", "u").mapInPandas(scan, "c long, d long, s double")
    best = Window.partitionBy("c").orderBy(F.col("s").desc(), "d")
    true = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select("c", "s").toPandas()
    got = pairs.filter(F.col("c").isin([int(i) for i in ids])).select("c", "s").toPandas()
    floors = true.groupby("c")["s"].min()
    # By similarity, so that ties count whichever was kept.
    held = (got["s"] >= got["c"].map(floors) - 1e-6).sum()
    return min(1.0, float(held) / len(true)) if len(true) else 1.0


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each class in ``c, d, s``, each neighbour once."""
    best = Window.partitionBy("c").orderBy(F.col("s").desc(), "d")
    pairs = found.groupBy("c", "d").agg(F.max("s").alias("s"))
    return pairs.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select("c", "d", "s")


def compared(owner: np.ndarray, ids: np.ndarray, unit: np.ndarray, floor: np.ndarray, k: int) -> pd.DataFrame:
    """``c, d, s``: of rows sorted by owner, the pairs within an owner's rows that exceed the floor of ``c``, at most k of each ``c``."""
    names, code = np.unique(ids, return_inverse=True)
    borders = np.r_[np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0], len(owner)]
    left, right, sims = [], [], []
    for a, b in zip(borders[:-1], borders[1:]):
        s = unit[a:b] @ unit[a:b].T
        np.fill_diagonal(s, -2)
        rows, cols = np.nonzero(s > floor[a:b, None])
        left.append(code[a + rows])
        right.append(code[a + cols])
        sims.append(s[rows, cols])
    left, right, sims = np.concatenate(left), np.concatenate(right), np.concatenate(sims)
    first = np.unique(left * len(names) + right, return_index=True)[1]
    left, right, sims = left[first], right[first], sims[first]
    order = np.lexsort((right, -sims, left))
    left, right, sims = left[order], right[order], sims[order]
    top = np.arange(len(left)) - np.searchsorted(left, left) < k
    return pd.DataFrame({"c": names[left[top]], "d": names[right[top]], "s": sims[top].astype(np.float64)})


def second_neighbours(keyed: DataFrame, pairs: DataFrame, dim: int) -> DataFrame:
    """``c, d, s``: for every class, its neighbours and at most ``BREADTH`` classes it is a neighbour of are compared with each other.

    Classes are taken in the order of one curve (``keyed``: c, u, key), so that a task meets the same rows often and gives a pair once.
    """
    back = Window.partitionBy("d").orderBy(F.col("s").desc(), "c")
    reverse = pairs.withColumn("n", F.row_number().over(back)).filter(F.col("n") <= BREADTH).select(F.col("d").alias("v"), F.col("c").alias("x"))
    members = pairs.select(F.col("c").alias("v"), F.col("d").alias("x")).unionByName(reverse).distinct()
    # Only what beats the last of a full list is new.
    floors = pairs.groupBy(F.col("c").alias("x")).agg(F.when(F.count(F.lit(1)) >= BREADTH, F.min("s")).otherwise(-2.0).alias("f"))
    known = keyed.select(F.col("c").alias("x"), "u").join(floors, "x", "left")
    rows = members.join(known, "x").join(keyed.select(F.col("c").alias("v"), "key"), "v").select("key", "v", "x", "u", F.coalesce("f", F.lit(-2.0)).alias("f"))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        return compared(rows["v"].to_numpy(), rows["x"].to_numpy(), _matrix(rows["u"], dim), rows["f"].to_numpy(), BREADTH)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= TOGETHER:
                rows = pd.concat(held, ignore_index=True)
                # The last class may go on in the next batch.
                v = rows["v"].to_numpy()
                end = len(v) - int(np.argmax(v[::-1] != v[-1])) if (v != v[-1]).any() else 0
                if end:
                    yield work(rows.iloc[:end])
                held = [rows.iloc[end:]]
        rows = pd.concat(held, ignore_index=True) if held else None
        if rows is not None and len(rows):
            yield work(rows)

    return rows.repartitionByRange("key", "v").sortWithinPartitions("key", "v").mapInPandas(scan, "c long, d long, s double")


def neighbours(
    df: DataFrame, id_col: str, vec: str, k: int = 5, least: float = -1.0, dim: int = 64, curves: int = 8, window: int = 128, seed: int = 7, hold: float = 0.0
) -> DataFrame:
    """``id, other, similarity, rank``: the k most similar other vectors of each vector (of similarity ``least`` or more).

    ``hold``: recall that the result must have; 0 takes what the curves give.
    """
    spark = df.sparkSession

    def to_unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, unit = unit_rows(batch["v"], dim)
            coded = unit.astype(np.float32)
            sign = np.round(unit * 1e5).astype(np.int32)
            yield pd.DataFrame({"id": batch["id"].to_numpy()[at], "h": [x.tobytes() for x in sign], "u": [x.tobytes() for x in coded]})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    units = rows.mapInPandas(to_unit, "id long, h binary, u binary").withColumn("h", F.unhex(F.md5("h")))
    units = materialise(units, "units").dropDuplicates(["id"])
    place = Window.partitionBy("h").orderBy("id")
    firsts = units.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= k + 1)
    classes = materialise(
        firsts.groupBy("h").agg(F.min("id").alias("c"), F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("u", "id").alias("u")), "classes"
    )

    def on_curves(planes: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """``curve, key, c, u``: every class on every curve."""

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                unit = _matrix(batch["u"], dim).astype(np.float64)
                for curve, (matrix, shift) in enumerate(planes):
                    yield pd.DataFrame({"curve": curve, "key": curve_keys(unit, matrix, shift), "c": batch["c"], "u": batch["u"]})

        return classes.select("c", "u").mapInPandas(place, "curve int, key long, c long, u binary")

    def slide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        start = 0
        for batch in chain(batches, [None]):
            rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            parts = [part for _, part in rows.groupby("curve", sort=False)]
            for i, part in enumerate(parts):
                last = batch is None or i < len(parts) - 1
                a, b, s, start = best_in_windows(part["c"].to_numpy(), _matrix(part["u"], dim), each, window, least, start, last)
                yield pd.DataFrame({"c": a, "d": b, "s": s.astype(np.float64)})
                # The window before the next row comes again with the next batch.
                held, start = (None, 0) if last else (part.iloc[max(0, start - window) :], min(start, window))

    count = classes.count()
    each = FROM_CURVE if hold else k
    if hold and count <= 3 * curves * window:
        pairs = merged(all_pairs(classes, count, k, least, dim), k)
    else:
        tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), count * curves // TASK_ROWS))

        def from_curves(seed: int) -> DataFrame:
            placed = on_curves(projections(dim, curves, seed))
            return placed.repartitionByRange(tasks, "curve", "key", "c").sortWithinPartitions("curve", "key", "c").mapInPandas(slide, "c long, d long, s double")

        pairs = merged(from_curves(seed), BREADTH if hold else k)
        if hold:
            pairs = materialise(pairs, "pairs")
            keyed = materialise(on_curves(projections(dim, 1, seed)).drop("curve"), "keyed")
            before = 0.0
            for turn in range(ROUNDS + 1):
                recall = sample_recall(classes, merged(pairs, k), k, least, dim)
                held = recall >= hold
                if held or turn == ROUNDS or recall - before < GAIN:
                    break
                before = recall
                more = second_neighbours(keyed, pairs, dim)
                # From the second round on other curves bring in what no chain of neighbours reaches.
                more = more.unionByName(from_curves(seed + turn)) if turn else more
                pairs = materialise(merged(pairs.unionByName(more), BREADTH), "pairs")
            pairs = merged(pairs if held else all_pairs(classes, count, k, least, dim), k)
    # Of a neighbouring class and of the own class at most k + 1 ids can be needed.
    others = pairs.join(classes.select(F.col("c").alias("d"), "ids"), "d").select("c", F.explode("ids").alias("other"), "s")
    own = classes.filter(F.size("ids") > 1).select("c", F.explode("ids").alias("other"), F.lit(1.0).alias("s"))
    listed = others.unionByName(own)
    ranked = Window.partitionBy("c").orderBy(F.col("s").desc(), "other")
    listed = listed.withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= 2 * k + 2).select("c", "other", "s")
    members = units.select("id", "h").join(classes.select("h", "c"), "h").select("id", "c")
    mine = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "other")
    return (
        members.join(listed, "c")
        .filter("id != other")
        .select("id", "other", F.col("s").alias("similarity"))
        .withColumn("rank", F.row_number().over(mine))
        .filter(F.col("rank") <= k)
    )


def similar_pairs(found: DataFrame, least: float) -> DataFrame:
    """Unordered pairs (vec_id_a < vec_id_b) of a neighbour result with at least the given similarity."""
    return (
        found.filter(F.col("similarity") >= least)
        .select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b"))
        .distinct()
    )
