"""Training-set construction: splits, negatives, groups, interleaving. Seeded order is by md5 of seed and id, not by a generator's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.operators.ordering import global_position


def seeded(seed: int, *columns: str) -> Column:
    """Order key of a row under a seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def split_queries(queries: DataFrame, ratios: tuple[float, float], seed: int = 42, key: str = "qid") -> DataFrame:
    """``key, part``: dev and test shares of the distinct keys by hash order, the rest train.

    The hash of a key is uniform, so a share is the keys below a bound of the first 52 bits: no global sort, stable when rows are added.
    """
    dev, test = ratios
    if not 0 <= dev + test < 1:
        raise ValueError("ratios must leave a train part")
    place = F.conv(F.substring(seeded(seed, key), 1, 13), 16, 10).cast("double") / float(16**13)
    return queries.select(key).distinct().withColumn("part", F.when(place < dev, "dev").when(place < dev + test, "test").otherwise("train"))


def drawn(queries: DataFrame, pool: DataFrame, n: Column, seed: int = 42) -> DataFrame:
    """``qid, docid, draw`` (from 0): n documents of the whole pool for each query, all different (all there are, if those are fewer).

    The pool (distinct ``docid``) stands in seeded random order; a query draws from the place its own hash names onwards, round the end. Places are
    global positions by ranges, and draws find them by an equi-join, so a query costs n rows at any size of the pool.
    """
    placed = global_position(pool.select("docid").withColumn("__order", seeded(seed, "docid")), ["__order", "docid"], "at").select("docid", "at")
    count = pool.count()
    if not count:
        return queries.select("qid").join(pool.select("docid"), F.lit(False)).withColumn("draw", F.lit(0))
    start = F.pmod(F.conv(F.substring(seeded(seed, "qid"), 1, 8), 16, 10).cast("bigint"), F.lit(count))
    some = F.least(n.cast("int"), F.lit(count))
    asked = queries.filter(some > 0).select("qid", start.alias("start"), F.explode(F.sequence(F.lit(0), some - 1)).alias("draw"))
    return asked.withColumn("at", F.pmod(F.col("start") + F.col("draw"), F.lit(count))).join(placed, "at").select("qid", "docid", "draw")


def random_negatives(queries: DataFrame, corpus: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``qid, docid, pos``: n pseudo-random documents of the whole corpus other than the gold for each query; all there are, if those are fewer."""
    asked = queries.select("qid", "gold").distinct()
    found = drawn(asked, corpus, F.lit(n + 1), seed).join(asked, "qid").filter(~F.col("docid").eqNullSafe(F.col("gold")))
    order = Window.partitionBy("qid").orderBy("draw")
    return found.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n).select("qid", "docid", "pos")


def tiered_negatives(rows: DataFrame, n: int) -> DataFrame:
    """``qid, docid, tier, pos`` of ``qid, docid, tier, place``: lower tiers first; a document counts in its first tier."""
    best = rows.groupBy("qid", "docid").agg(F.min(F.struct("tier", "place")).alias("at"))
    order = Window.partitionBy("qid").orderBy("at.tier", "at.place", "docid")
    return best.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n).select("qid", "docid", F.col("at.tier").alias("tier"), "pos")


def quota_negatives(rows: DataFrame, quotas: dict[int, int], n: int) -> DataFrame:
    """``qid, docid, tier, pos`` of ``qid, docid, tier, place``: tiers in order, of each at most its quota of documents that no earlier tier gave, n in all.

    A query's candidates are folded in one row; callers bound them.
    """
    candidates = F.sort_array(F.collect_list(F.struct("tier", "place", "docid")))
    chosen_type = rows.select(F.array(F.struct("tier", "docid"))).schema[0].dataType.simpleString()
    quota = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])

    def take(chosen: Column, x: Column) -> Column:
        known = F.exists(chosen, lambda c: c["docid"] == x["docid"])
        full = (F.size(chosen) >= n) | (F.size(F.filter(chosen, lambda c: c["tier"] == x["tier"])) >= F.element_at(quota, x["tier"]))
        return F.when(known | full, chosen).otherwise(F.concat(chosen, F.array(F.struct(x["tier"].alias("tier"), x["docid"].alias("docid")))))

    chosen = rows.groupBy("qid").agg(candidates.alias("all")).select("qid", F.aggregate("all", F.array().cast(chosen_type), take).alias("chosen"))
    return chosen.select("qid", F.posexplode("chosen").alias("at", "c")).select("qid", "c.docid", "c.tier", (F.col("at") + 1).alias("pos"))


def hard_and_soft(run: DataFrame, offset: int, hard: int, soft_from: int, soft: int) -> DataFrame:
    """``qid, docid, kind`` from candidates ranked without gold: hard ``[o, o+h)`` (or ``[0, h)`` where too few), soft ``[s, s+n)`` minus hard.

    Queries with fewer than ``hard + 2`` candidates are skipped.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    rows = run.withColumn("__n", size).filter(F.col("__n") >= hard + 2)
    start = F.when(F.col("__n") >= offset + hard, offset).otherwise(0)
    is_hard = (F.col("rank") > start) & (F.col("rank") <= start + hard)
    is_soft = (F.col("rank") > soft_from) & (F.col("rank") <= soft_from + soft)
    return rows.withColumn("kind", F.when(is_hard, "hard").when(is_soft, "soft")).filter("kind IS NOT NULL").select("qid", "docid", "kind")


def interleave(a: DataFrame, b: DataFrame, id_col: str, window: int = 128, seed: int = 42) -> DataFrame:
    """Two sources mixed in proportion, shuffled in windows: ``source, id, place`` by position arithmetic.

    Positions come from ``ordering.global_position``, so no single task sorts all rows.
    """
    parts = []
    for name, df in (("a", a), ("b", b)):
        rows = df.select(F.col(id_col).alias("id"))
        total = rows.agg(F.count(F.lit(1)).alias("n"))
        placed = global_position(rows, ["id"]).crossJoin(F.broadcast(total))
        parts.append(placed.select(F.lit(name).alias("source"), "id", ((F.col("position") + 0.5) / F.col("n")).alias("share")))
    mixed = global_position(parts[0].unionByName(parts[1]), ["share", "source", "id"])
    block = F.floor(F.col("position") / window)
    inside = Window.partitionBy("block").orderBy(seeded(seed, "source", "id"), "source", "id")
    return mixed.withColumn("block", block).withColumn("place", F.col("block") * window + F.row_number().over(inside) - 1).select("source", "id", "place")


def margin_loss(pairs: DataFrame, margin: float = 1.0, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Mean of ``max(0, margin - (pos - neg))`` over the positive-negative pairs of each group: ``keys, pairs, loss``."""
    p = pairs.filter("label = 1").select(*keys, F.col("score").alias("p"))
    n = pairs.filter("label = 0").select(*keys, F.col("score").alias("n"))
    both = p.join(n, list(keys))
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.greatest(F.lit(0.0), F.lit(margin) - (F.col("p") - F.col("n")))), 6).alias("loss"))


def split_exact(rows: DataFrame, key: str, shares: dict[str, float], rest: str, seed: int = 42, least: int = 0) -> DataFrame:
    """``key, part``: parts of int(n * share) rows (``least`` at least) in seeded order, the others in ``rest``; an empty part is an error.

    ``rows`` have distinct keys. Places come from hash ranges and their sizes, not from one global window.
    """
    placed = global_position(rows.select(key).withColumn("__order", seeded(seed, key)), ["__order", key])
    count = rows.count()
    sizes = {name: max(least, int(count * share)) for name, share in shares.items()}
    sizes[rest] = count - sum(sizes.values())
    if min(sizes.values()) < 1:
        raise ValueError(f"a part would be empty: {sizes}")
    part, end = None, 0
    for name in shares:
        end += sizes[name]
        part = F.when(F.col("position") < end, name) if part is None else part.when(F.col("position") < end, name)
    return placed.select(key, part.otherwise(rest).alias("part"))


def merged_negatives(negatives: Column, neg: Column, hard: Column) -> Column:
    """The list ``negatives`` where there is one, else ``neg`` and then ``hard``; each document once."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(neg, none), F.coalesce(hard, none))
    return F.array_distinct(F.array_compact(F.coalesce(negatives, both)))


def logistic_loss(score: Column, label: Column) -> Column:
    """Binary cross entropy of a logit, without overflow."""
    return F.greatest(score, F.lit(0.0)) - score * label + F.log1p(F.exp(-F.abs(score)))


def back_translated(rows: DataFrame, cache: DataFrame, there: str, back: str) -> DataFrame:
    """``qid, src, pivot, variant`` of ``rows(qid, src)`` by way of a pivot, from ``cache(direction, src, dst)``; what equals the source drops out."""
    first = cache.filter(F.col("direction") == there).select("src", F.col("dst").alias("pivot"))
    second = cache.filter(F.col("direction") == back).select(F.col("src").alias("pivot"), F.col("dst").alias("variant"))
    found = rows.join(first, "src").filter("pivot != src").join(second, "pivot")
    return found.filter("lower(trim(variant)) != lower(trim(src))").select("qid", "src", "pivot", "variant").distinct()


def random_settings(spark: SparkSession, trials: int, ranges: dict[str, tuple[int, int]], seed: int = 42) -> DataFrame:
    """``trial`` and a seeded whole number in each range; a setting drawn twice keeps its first trial."""
    rows = spark.range(trials).withColumnRenamed("id", "trial")
    for name, (low, high) in ranges.items():
        rows = rows.withColumn(name, low + F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), F.col("trial").cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(high - low + 1)))
    return rows.groupBy(*ranges).agg(F.min("trial").alias("trial")).select("trial", *ranges)
