"""Retrieval and ranking: BM25 over a postings table, dense and hybrid search, feedback, fusion, reranking.

Runs are ``qid, docid, score, rank``. Ties go to the smaller document, in reranking to the better first-stage rank. Ranks are cut
right above their window, so that Spark drops rows before the shuffle (WindowGroupLimit).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from citeloom.session import materialise, open_shared

K1, B = 1.2, 0.75
#: Postings a task holds in memory at a time (some 40 bytes each), and the margin of sums that round to six digits.
BLOCK_POSTINGS, MARGIN = 8_000_000, 2e-6
#: Rows of answers a task holds until all blocks are seen.
HELD = 4_000_000
#: Document vectors of one product, and query vectors multiplied with them at a time.
DENSE_ROWS, QUERY_SLICE = 20_000, 512


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("qid",), order: list[Column] | None = None) -> DataFrame:
    """The k best rows of each group with their ``rank``."""
    window = Window.partitionBy(*by).orderBy(*(order or [F.desc("score"), F.asc("docid")]))
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def postings(docs: DataFrame, tokens: dict[str, Column], own: tuple[str, ...] = ()) -> DataFrame:
    """``field, term, docid, tf, dl`` of documents with column ``docid``, and their columns ``own``; one pass for all fields."""
    fields = F.array(*[F.struct(F.lit(name).alias("field"), t.alias("tokens")) for name, t in tokens.items()])
    rows = docs.select("docid", *own, F.explode(fields).alias("f")).select("docid", *own, "f.field", "f.tokens", F.size("f.tokens").alias("dl"))
    terms = rows.select("docid", *own, "field", "dl", F.explode("tokens").alias("term"))
    return terms.groupBy("field", "term", "docid", "dl", *own).agg(F.count(F.lit(1)).alias("tf"))


def write_index(docs: DataFrame, tokens: dict[str, Column]) -> DataFrame:
    """``postings`` written once, all rows of a document in one file, sorted by term."""
    return materialise(postings(docs.repartition("docid"), tokens).sortWithinPartitions("term", "docid"), "postings")


def weighted_postings(index: DataFrame, boosts: dict[str, float] | None = None) -> DataFrame:
    """``term, docid, w``: BM25 weights, summed over fields with their boosts (exact document length). ``index`` is read three times."""
    lengths = index.select("field", "docid", "dl").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = index.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    rows = index.join(df, ["field", "term"]).join(F.broadcast(lengths), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    boost = F.lit(1.0)
    for name, value in (boosts or {}).items():
        boost = F.when(F.col("field") == name, F.lit(float(value))).otherwise(boost)
    return rows.select("term", "docid", (boost * idf * tf).alias("w")).groupBy("term", "docid").agg(F.sum("w").alias("w"))


def query_terms(queries: DataFrame, tokens: Column, boost: float = 1.0) -> DataFrame:
    """``qid, term, qw``: each occurrence of a term counts."""
    terms = queries.select("qid", F.explode(tokens).alias("term"))
    return terms.groupBy("qid", "term").agg((F.count(F.lit(1)) * F.lit(float(boost))).alias("qw"))


class PostingBlock:
    """Postings of a set of documents in memory, summed for a query at a time into one array of all documents.

    Nothing is skipped term by term: bounds of single terms leave half of the postings and tens of thousands of documents, and testing them costs more than it saves.
    """

    def __init__(self, terms: np.ndarray, docs: np.ndarray, weights: np.ndarray, names: pa.Array) -> None:
        """``terms`` and ``docs`` are codes, ``names`` the documents in ascending order of their ids. Weights of a repeated pair add up."""
        n = max(1, len(names))
        key = terms.astype(np.int64) * n + docs
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.empty(0, dtype=np.int64)
        self.weights = np.add.reduceat(weights[order], first) if len(key) else np.empty(0)
        del order
        key = key[first]
        terms, self.docs, self.names = key // n, key % n, names
        sizes = np.bincount(terms) if len(terms) else np.zeros(1, dtype=np.int64)
        self.start = np.r_[0, np.cumsum(sizes)]
        self.most = np.zeros(len(sizes))
        if len(terms):
            self.most[sizes > 0] = np.maximum.reduceat(self.weights, self.start[:-1][sizes > 0])
        self.sums = np.zeros(len(names))

    def scores(self, terms: np.ndarray, boosts: np.ndarray) -> np.ndarray:
        """The sum of every document, in an array that the next call overwrites."""
        self.sums.fill(0.0)
        keep = terms < len(self.most)
        for t, q in zip(terms[keep].tolist(), boosts[keep].tolist()):
            a, b = self.start[t], self.start[t + 1]
            np.add.at(self.sums, self.docs[a:b], self.weights[a:b] if q == 1 else q * self.weights[a:b])
        return self.sums

    def score_of(self, terms: np.ndarray, boosts: np.ndarray, doc: int) -> float:
        """The sum of one document."""
        total = 0.0
        for t, q in zip(terms.tolist(), boosts.tolist()):
            a, b = (self.start[t], self.start[t + 1]) if t < len(self.most) else (0, 0)
            i = a + np.searchsorted(self.docs[a:b], doc)
            total += q * self.weights[i] if i < b and self.docs[i] == doc else 0.0
        return total

    def best(self, terms: np.ndarray, boosts: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(document codes, rounded scores) of the k best with at least the rounded score ``floor``; ties to the smaller document. Boosts are positive."""
        keep = terms < len(self.most)
        if self.most[terms[keep]] @ boosts[keep] + MARGIN < floor:
            return np.empty(0, dtype=np.int64), np.empty(0)
        sums = self.scores(terms, boosts)
        least = max(floor, _kth_at_least(sums, k)) - MARGIN
        found = np.nonzero(sums >= least if least > 0 else sums)[0]
        scores = np.round(sums[found], 6)
        if len(found) > k:
            keep = scores >= np.partition(scores, -k)[-k]
            found, scores = found[keep], scores[keep]
        order = np.lexsort((found, -scores))[:k]
        return found[order], scores[order]


def _kth_at_least(sums: np.ndarray, k: int) -> float:
    """A number that the k-th largest sum reaches: that of the maxima of groups, as each stands for one document at least; 0 where there are fewer."""
    if len(sums) < k:
        return 0.0
    groups = max(4 * k, len(sums) // 64)
    if len(sums) >= 2 * groups:
        rows = len(sums) // groups
        sums = sums[: rows * groups].reshape(rows, groups).max(axis=0)
    return float(np.partition(sums, -k)[-k])


def _blocks(files: list[str], most: int) -> list[tuple[list[str], int, int]]:
    """Files joined to blocks of at most ``most`` rows: (files, share, shares); a larger file is taken in shares of its documents."""
    made: list[tuple[list[str], int, int]] = []
    held, size = [], 0
    for path in files:
        with open_shared(path) as f:
            rows = pq.read_metadata(f).num_rows
        if rows > most:
            shares = -(-rows // most)
            made += [([path], i, shares) for i in range(shares)]
            continue
        if held and size + rows > most:
            made.append((held, 0, 1))
            held, size = [], 0
        held, size = [*held, path], size + rows
    return [*made, (held, 0, 1)] if held else made


class Terms:
    """What tasks know of the terms that are asked for, by their code: the place in ``words``. Weights come from the rows, or from inverse frequencies by field."""

    def __init__(self, rows: pa.Table, lengths: dict[str, tuple[int, float]] | None, boosts: dict[str, float]) -> None:
        self.words = pc.unique(rows["term"]).sort() if len(rows) else pa.array([], pa.string())
        self.fields = None if lengths is None else sorted(lengths)
        if lengths is None:
            return
        self.boosts = np.array([boosts.get(f, 1.0) for f in self.fields])
        self.average = np.array([lengths[f][1] for f in self.fields])
        self.idf = np.zeros((len(self.fields), len(self.words)))
        code = pc.index_in(rows["term"], self.words).to_numpy()
        field = pc.index_in(rows["field"], pa.array(self.fields)).to_numpy()
        n, df = np.array([lengths[f][0] for f in self.fields], dtype=np.float64)[field], rows["df"].to_numpy()
        self.idf[field, code] = np.log(1 + (n - df + 0.5) / (df + 0.5))

    @property
    def columns(self) -> list[str]:
        return ["term", "docid", "w"] if self.fields is None else ["field", "term", "docid", "tf", "dl"]

    def weights(self, rows: pa.Table, codes: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """BM25 weights of the kept rows."""
        value = lambda c: rows[c].to_numpy()[keep]
        if self.fields is None:
            return value("w").astype(np.float64)
        field = pc.index_in(rows["field"], pa.array(self.fields)).to_numpy()[keep]
        tf = value("tf").astype(np.float64)
        return self.boosts[field] * self.idf[field, codes] * (tf / (tf + K1 * (1 - B + B * value("dl") / self.average[field])))


def _coded(column: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array]:
    """Codes of each chunk, into one array that joins their dictionaries (values may repeat)."""
    codes, names, base = [], [], 0
    for chunk in column.chunks:
        part = chunk if pa.types.is_dictionary(chunk.type) else chunk.dictionary_encode()
        codes.append(part.indices.to_numpy(zero_copy_only=False) + base)
        names.append(part.dictionary)
        base += len(part.dictionary)
    return codes, pa.concat_arrays(names)


def _load_rows(block: tuple[list[str], int, int], terms: Terms, group: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array | None]:
    """(term codes, document codes, weights, documents in ascending order, groups) of the postings of a block that have an asked term."""
    files, share, shares = block
    kept = []
    for path in files:
        with open_shared(path) as f:
            source = pq.ParquetFile(f, read_dictionary=["term", "docid"])
            for g in range(source.num_row_groups):
                rows = source.read_row_group(g, columns=[*terms.columns, *[group] * bool(group)])
                if not len(rows):
                    continue
                codes, words = _coded(rows["term"])
                codes = pc.fill_null(pc.index_in(words, terms.words), -1).to_numpy()[np.concatenate(codes)]
                docs, names = _coded(rows["docid"])
                docs = np.concatenate(docs)
                keep = codes >= 0
                if shares > 1:
                    mine = np.array([crc32(str(x).encode()) % shares == share for x in names.to_pylist()], dtype=bool)
                    keep &= mine[docs]
                keep = np.nonzero(keep)[0]
                groups = rows[group].combine_chunks().take(pa.array(keep)) if group else None
                kept.append((codes[keep].astype(np.int32), docs[keep].astype(np.int32), terms.weights(rows, codes[keep], keep), names, groups))
    names = pa.concat_arrays([x[3] for x in kept]).unique().sort() if kept else pa.array([])
    docs = [pc.index_in(x[3], names).to_numpy()[x[1]] for x in kept]
    joined = [np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in ([x[0] for x in kept], docs, [x[2] for x in kept])]
    if shares > 1:
        mine, joined[1] = np.unique(joined[1], return_inverse=True)
        names = names.take(pa.array(mine))
    return *joined, names, pa.concat_arrays([x[4] for x in kept]) if group and kept else None


def load_block(block: tuple[list[str], int, int], terms: Terms) -> PostingBlock | None:
    """The postings of a block that have an asked term. Of every document all rows lie in one file."""
    codes, docs, weights, names, _ = _load_rows(block, terms)
    return PostingBlock(codes, docs, weights, names) if len(codes) else None


def asked_queries(path: str, terms: Terms, most: int, group: str | None = None, boost: str = "qw") -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]], pa.Array | None]]:
    """(qids, code and boost of their terms, groups) of one file of whole queries sorted by qid, at most ``most`` queries at a time."""
    with open_shared(path) as f:
        source = pq.ParquetFile(f)
        rest = None
        for g in range(source.num_row_groups):
            rows = source.read_row_group(g, columns=["qid", "term", boost, *[group] * bool(group)])
            rest = rows if rest is None else pa.concat_tables([rest, rows])
            last = g == source.num_row_groups - 1
            rest = rest.combine_chunks()
            if not len(rest):
                continue
            qid = rest["qid"].combine_chunks()
            first = np.r_[0, np.nonzero(~pc.equal(qid[1:], qid[:-1]).to_numpy(zero_copy_only=False))[0] + 1, len(qid)]
            # The last query of a row group may go on in the next.
            whole = len(first) - 1 if last else len(first) - 2
            codes = pc.fill_null(pc.index_in(rest["term"], terms.words), -1).to_numpy()
            boosts = rest[boost].to_numpy()
            for a in range(0, whole, most):
                ends = first[a : min(a + most, whole) + 1]
                each = [(codes[x:y], boosts[x:y]) for x, y in zip(ends[:-1], ends[1:])]
                yield qid.take(pa.array(ends[:-1])), [(c[ok], b[ok]) for c, b in each for ok in [(c >= 0) & (b > 0)]], rest[group].combine_chunks().take(pa.array(ends[:-1])) if group else None
            rest = rest.slice(first[whole]) if whole < len(first) - 1 else None


def _top_of_file(path: str, blocks: list, terms: Terms, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The k best of each query of a file over all blocks, ranked."""
    only = load_block(blocks[0], terms) if len(blocks) == 1 else None
    for qids, queries, _ in asked_queries(path, terms, max(1000, HELD // k)):
        floors = np.zeros(len(queries))
        kept: list[np.ndarray | None] = [None] * len(queries)
        owners, found, scores = [], [], []
        for block in blocks:
            b = only if len(blocks) == 1 else load_block(block, terms)
            if b is None:
                continue
            codes = []
            for i, (t, q) in enumerate(queries):
                docs, points = b.best(t, q, k, floors[i])
                if len(docs):
                    owners.append(np.full(len(docs), i))
                    codes.append(docs)
                    scores.append(points)
                    if len(blocks) > 1:
                        kept[i] = points if kept[i] is None else np.r_[kept[i], points]
                        if len(kept[i]) >= k:
                            kept[i] = np.partition(kept[i], -k)[-k:]
                            floors[i] = kept[i][0]
            if codes:
                found.append(b.names.take(pa.array(np.concatenate(codes))))
        if not owners:
            continue
        owner, score, names = np.concatenate(owners), np.concatenate(scores), pa.concat_arrays(found)
        if len(blocks) > 1:
            keep = np.nonzero(score >= floors[owner])[0]
            rows = pa.table({"owner": owner[keep], "score": score[keep], "docid": names.take(pa.array(keep))})
            rows = rows.take(pc.sort_indices(rows, [("owner", "ascending"), ("score", "descending"), ("docid", "ascending")]))
            owner, score, names = rows["owner"].to_numpy(), rows["score"].to_numpy(), rows["docid"].combine_chunks()
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = np.nonzero(place < k)[0]
        table = pa.table([qids.take(pa.array(owner[keep])), names.take(pa.array(keep)), pa.array(score[keep]), pa.array((place[keep] + 1).astype(np.int32))], schema=schema)
        yield from table.to_batches(max_chunksize=100_000)


def write_queries(terms: DataFrame) -> DataFrame:
    """Query terms written once, whole queries sorted by qid to each of two files a core."""
    rows = terms.select("qid", "term", F.col("qw").cast("double").alias("qw")).filter("qid IS NOT NULL AND term IS NOT NULL")
    return materialise(rows.repartition(2 * terms.sparkSession.sparkContext.defaultParallelism, "qid").sortWithinPartitions("qid"), "terms")


def _read_block(path: str, columns: list[str]) -> pa.Table:
    """Columns of one file of the shared folder."""
    with open_shared(path) as f:
        return pq.read_table(f, columns=columns)


def _table_of(df: DataFrame) -> Callable[[], pa.Table]:
    """Reads a materialised table in a task."""
    files, schema = df.inputFiles(), to_arrow_schema(df.schema)
    return lambda: pa.concat_tables([schema.empty_table(), *[_read_block(path, schema.names).cast(schema) for path in files]])


def by_file(asked: DataFrame, index: DataFrame, boosts: dict[str, float] | None, schema: str, work: Callable[[str, list, Terms, pa.Schema], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Runs ``work`` in one task for each file of queries: (its path, blocks of the index, asked terms, schema).

    ``index`` is a materialised table with all rows of a document in one file: ``term, docid, w``, or fields as ``postings`` gives them. Where both are
    partitioned by ``part``, a task gets only the blocks of its part.
    """
    spark = index.sparkSession
    words, lengths = asked.select("term").distinct(), None
    if "w" not in index.columns:
        words = index.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).join(words, "term", "left_semi")
        sizes = index.select("field", "docid", "dl").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
        lengths = {r["field"]: (r["n"], r["avgdl"]) for r in sizes.collect()}
    read, paths, files, most = _table_of(materialise(words, "words")), asked.inputFiles(), index.inputFiles(), BLOCK_POSTINGS
    made = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = blocks = None
        for batch in batches:
            for i in batch.column(0).to_pylist():
                if terms is None:
                    terms, blocks = Terms(read(), lengths, boosts or {}), [] if "/part=" in paths[i] else _blocks(files, most)
                part = re.search(r"/part=-?\d+/", paths[i])
                own = blocks if part is None else _blocks([f for f in files if part[0] in f], most)
                if own and len(terms.words):
                    yield from work(paths[i], own, terms, made)

    return spark.range(0, len(paths), 1, max(1, len(paths))).mapInArrow(scan, schema)


def bm25(terms: DataFrame, index: DataFrame, k: int, boosts: dict[str, float] | None = None) -> DataFrame:
    """Top k documents of each query with their rank, exact; scores rounded to six digits before ranking. Boosts must be positive.

    ``index`` holds weights (``term, docid, w``) or is a table that ``write_index`` wrote; then ``boosts`` are those of its fields. Query terms are written once,
    two files a core. Spark doesn't know how large the answer is and may broadcast it: write it before a join. A task takes one file and goes through the whole index, ``BLOCK_POSTINGS`` at a time; the k-th best score of the blocks before is the floor in the next,
    and nothing is shuffled behind.
    """
    if "w" in index.columns:
        index = materialise(index.select("docid", "term", "w").repartition("docid").sortWithinPartitions("term", "docid"), "weights")
    asked = write_queries(terms)
    schema = f"qid {asked.schema['qid'].dataType.simpleString()}, docid {index.schema['docid'].dataType.simpleString()}, score double, rank int"
    return by_file(asked, index, boosts, schema, lambda path, blocks, known, made: _top_of_file(path, blocks, known, k, made))


def _ranked_in_groups(path: str, blocks: list, terms: Terms, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """All documents of each query's group that share a term with it, ranked."""

    def parts(block: tuple) -> dict[str, tuple[np.ndarray, PostingBlock]]:
        codes, docs, weights, names, groups = _load_rows(block, terms, "grp")
        if not len(codes):
            return {}
        coded = groups.dictionary_encode()
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        ends = np.r_[0, np.cumsum(np.bincount(coded.indices.to_numpy()))]
        made = {}
        for i, name in enumerate(coded.dictionary.to_pylist()):
            at = order[ends[i] : ends[i + 1]]
            (words, word), (own, doc) = (np.unique(x[at], return_inverse=True) for x in (codes, docs))
            made[name] = words, PostingBlock(word, doc, weights[at], names.take(pa.array(own)))
        return made

    only = parts(blocks[0]) if len(blocks) == 1 else None
    for qids, queries, groups in asked_queries(path, terms, 256, "grp"):
        owners, found, scores = [], [], []
        for block in blocks:
            loaded = parts(block) if only is None else only
            for i, ((t, q), name) in enumerate(zip(queries, groups.to_pylist())):
                words, b = loaded.get(name, (None, None))
                if b is None:
                    continue
                at = np.minimum(np.searchsorted(words, t), len(words) - 1)
                same = words[at] == t
                sums = b.scores(at[same], q[same])
                docs = np.nonzero(sums)[0]
                points = np.round(sums[docs], 6)
                order = np.argsort(-points, kind="stable")
                owners.append(np.full(len(docs), i))
                found.append(b.names.take(pa.array(docs[order])))
                scores.append(points[order])
        if not owners:
            continue
        owner, names = np.concatenate(owners), pa.concat_arrays(found)
        if len(blocks) > 1:
            rows = pa.table({"owner": owner, "score": np.concatenate(scores), "docid": names})
            rows = rows.take(pc.sort_indices(rows, [("owner", "ascending"), ("score", "descending"), ("docid", "ascending")]))
            owner, names = rows["owner"].to_numpy(), rows["docid"].combine_chunks()
        place = np.arange(len(owner)) - np.searchsorted(owner, owner) + 1
        yield from pa.table([qids.take(pa.array(owner)), names, pa.array(place.astype(np.int32))], schema=schema).to_batches(max_chunksize=100_000)


def bm25_in_groups(terms: DataFrame, docs: DataFrame, tokens: dict[str, Column], boosts: dict[str, float] | None = None) -> DataFrame:
    """``qid, docid, rank`` of all documents that share a term with the query and have its group: ``terms(qid, term, qw, grp)``, ``docs`` with ``docid, grp``.

    Frequencies count all documents, also those without a group. Both sides are written by a hash of the group, queries to four files each; a task reads one of these and the documents
    of its hash, so neither pairs nor answers are shuffled.
    """
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    part = F.coalesce(F.pmod(F.xxhash64("grp"), F.lit(4 * cores)), F.lit(-1)).cast("int")
    part = F.when(F.col("grp").isNull(), -1).otherwise(part)
    rows = postings(docs.withColumn("part", part).repartition("part", F.pmod(F.xxhash64("docid"), F.lit(4))), tokens, ("grp", "part"))
    index = materialise(rows.sortWithinPartitions("part", "term", "docid"), "postings", "part")
    asked = terms.filter("qid IS NOT NULL AND term IS NOT NULL AND grp IS NOT NULL").select("qid", "term", F.col("qw").cast("double").alias("qw"), "grp", part.alias("part"))
    share = F.pmod(F.xxhash64("qid"), F.lit(4)).alias("share")
    asked = materialise(asked.withColumn("share", share).repartition("part", "share").sortWithinPartitions("part", "share", "qid"), "terms", "part", "share")
    schema = f"qid {asked.schema['qid'].dataType.simpleString()}, docid {index.schema['docid'].dataType.simpleString()}, rank int"
    return by_file(asked, index, boosts, schema, _ranked_in_groups)


def _gold_ranked(path: str, blocks: list, terms: Terms, grid: list[tuple[float, float]], depth: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """By grid point the queries of a file whose gold document is among the first ``depth``; no row where no query finds any document."""
    only = load_block(blocks[0], terms) if len(blocks) == 1 else None
    points = np.array(grid)
    hits, some = np.zeros(len(grid), dtype=np.int64), False
    # With several blocks the gold document's sums come from a pass of their own.
    most = 20_000
    for (_, xs, golds), (_, ys, _) in zip(asked_queries(path, terms, most, "gold", "qx"), asked_queries(path, terms, most, "gold", "qy")):
        own = np.zeros((len(xs), 2))
        before = np.zeros((len(xs), len(grid)), dtype=np.int64)
        for look in (True, False):
            for block in blocks:
                b = load_block(block, terms) if only is None else only
                if b is None:
                    continue
                at = pc.fill_null(pc.index_in(golds, b.names), -1).to_numpy()
                less = np.searchsorted(b.names.to_numpy(zero_copy_only=False), golds.fill_null("").to_numpy(zero_copy_only=False)) if not look else at
                for i, (x, y) in enumerate(zip(xs, ys)):
                    if look:
                        some = some or any((b.most[t[t < len(b.most)]] > 0).any() for t, _ in (x, y))
                        if at[i] >= 0:
                            own[i] = b.score_of(*x, at[i]), b.score_of(*y, at[i])
                    elif own[i].any() and before[i].min() < depth:
                        before[i] += _before(b, x, y, own[i], at[i], less[i], points)
        hits += ((before < depth) & own.any(axis=1)[:, None]).sum(axis=0)
    if some:
        yield from pa.table([pa.array(points[:, 0]), pa.array(points[:, 1]), pa.array(hits)], schema=schema).to_batches()


def _before(b: PostingBlock, x: tuple, y: tuple, own: np.ndarray, at: int, less: int, points: np.ndarray) -> np.ndarray:
    """How many documents of a block come before the gold document, by grid point."""
    s, t = b.scores(*x).copy(), b.scores(*y)
    docs = np.nonzero((s >= own[0] - MARGIN) | (t > own[1]))[0]
    docs = docs[(docs != at) & ((s[docs] > 0) | (t[docs] > 0))]
    sums = np.round(points[:, :1] * s[docs] + points[:, 1:] * t[docs], 6)
    mine = np.round(points @ own, 6)[:, None]
    return ((sums > mine) | ((sums == mine) & (docs < less))).sum(axis=1)


def bm25_grid(terms: DataFrame, index: DataFrame, grid: list[tuple[float, float]], depth: int) -> DataFrame:
    """``a, b, hits``: queries whose gold document is among the ``depth`` best by ``a x + b y``, the sums of two clauses: ``terms(qid, term, qx, qy, gold)``.

    Only documents that come before the gold document are counted, so no pair leaves its task.
    """
    cores = terms.sparkSession.sparkContext.defaultParallelism
    rows = terms.filter("qid IS NOT NULL AND term IS NOT NULL").repartition(2 * cores, "qid").sortWithinPartitions("qid")
    found = by_file(materialise(rows, "terms"), index, None, "a double, b double, hits bigint", lambda path, blocks, known, made: _gold_ranked(path, blocks, known, grid, depth, made))
    return found.groupBy("a", "b").agg(F.sum("hits").alias("hits"))


def merged_terms(*parts: DataFrame) -> DataFrame:
    """Weighted union of query clauses; a query lacking one clause keeps the others."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("qid", "term").agg(F.sum("qw").alias("qw"))


def unit(v: str | Column) -> Column:
    """L2-normalised vector as array of double; a zero vector stays zero."""
    x = F.transform(F.col(v) if isinstance(v, str) else v, lambda e: e.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))
    return F.transform(x, lambda e: F.when(norm > 0, e / norm).otherwise(0.0))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays, in double."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, e: s + e)


def _vectors_of(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the usable vectors, their rows as double): not null, without null values, of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0)) if width is None else width
    fits = sizes == width
    if width > 0 and column.flatten().null_count:
        owner = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
        fits[owner[pc.is_null(column.flatten()).to_numpy(zero_copy_only=False)]] = False
    at = np.nonzero(fits)[0] if width > 0 else np.empty(0, dtype=np.int64)
    return at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), max(width, 1))


def _best_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest finite values of each row; ties to the smaller column."""
    if scores.shape[1] > k:
        rows, cols = np.nonzero(scores >= np.partition(scores, -k, axis=1)[:, -k, None])
    else:
        rows, cols = np.nonzero(np.ones_like(scores, dtype=bool))
    value = scores[rows, cols]
    keep = np.isfinite(value)
    rows, cols, value = rows[keep], cols[keep], value[keep]
    order = np.lexsort((cols, -value, rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def dense_top_k(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Exact inner-product search: ``queries(qid, v)`` against ``docs(docid, v)``; a document isn't its own answer.

    Query vectors are written once, in files of bounded size. Each task takes ``DENSE_ROWS`` documents at a time, multiplies them with the query files, a
    slice of queries after the other, and gives only the k best of each query, so no pair of the product is materialised and no vector
    passes through the driver. Null vectors, vectors with null values and vectors of another length than most take no part.
    """
    kinds = queries.schema["qid"].dataType.simpleString(), docs.schema["docid"].dataType.simpleString()
    schema = f"qid {kinds[0]}, docid {kinds[1]}, score double"
    asked = materialise(queries.select("qid", "v").filter("qid IS NOT NULL AND v IS NOT NULL").repartition("qid"), "vectors")
    files = asked.inputFiles()
    made = to_arrow_schema(asked.sparkSession.createDataFrame([], schema).schema)

    def score(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).sort_by("docid")
        at, d = _vectors_of(rows["v"])
        names = rows["docid"].combine_chunks().take(pa.array(at))
        coded = names.dictionary_encode()
        own = coded.indices.to_numpy(zero_copy_only=False)
        for path in files:
            block = _read_block(path, ["qid", "v"])
            q_at, q = _vectors_of(block["v"], d.shape[1])
            qids = block["qid"].combine_chunks().take(pa.array(q_at))
            same = pc.fill_null(pc.index_in(qids.cast(names.type), coded.dictionary), -1).to_numpy(zero_copy_only=False)
            for a in range(0, len(q), QUERY_SLICE):
                s = np.round(q[a : a + QUERY_SLICE] @ d.T, 6)
                s[same[a : a + QUERY_SLICE, None] == own[None, :]] = -np.inf
                r, c = _best_rows(s, k)
                yield from pa.table([qids.take(pa.array(a + r)), names.take(pa.array(c)), pa.array(s[r, c])], schema=made).to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= DENSE_ROWS:
                yield from score(held)
                held = []
        if sum(map(len, held)):
            yield from score(held)

    return top_k(docs.select("docid", "v").filter("docid IS NOT NULL AND v IS NOT NULL").mapInArrow(scan, schema), k)


def max_sim(q: str | Column, d: str | Column) -> Column:
    """Late interaction: mean over query tokens of the best document token; 0 when either side is empty."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (q, d))
    best = F.transform(x, lambda a: F.array_max(F.transform(y, lambda b: dot(a, b))))
    mean = F.aggregate(best, F.lit(0.0), lambda s, e: s + e) / F.size(x)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), mean).otherwise(0.0)


def tokens_of_vector(v: str | Column, size: int = 8) -> Column:
    """A vector cut into pieces of ``size`` values: a stand-in for token vectors where no encoder is at hand."""
    x = F.transform(F.col(v) if isinstance(v, str) else v, lambda e: e.cast("double"))
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / size).cast("int") - 1), lambda i: F.slice(x, i * size + 1, size))


def hybrid(candidates: DataFrame, weights: tuple[float, float, float], k: int) -> DataFrame:
    """Linear rescoring of ``qid, docid, dense, sparse, late``; candidates outside the dense pool never enter."""
    if not any(weights):
        raise ValueError("at least one weight must be other than 0")
    wd, ws, wl = (F.lit(float(w)) for w in weights)
    none = F.lit(0.0)
    score = wd * F.col("dense") + ws * F.coalesce("sparse", none) + wl * F.coalesce("late", none)
    return top_k(candidates.withColumn("score", F.round(score, 6)), k)


def normalize_ranks(run: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Each document once, with its smallest valid rank; order by rank (missing last), score, document; renumbered from 1."""
    rank = F.when(F.col("rank") > 0, F.col("rank"))
    score = F.when(~F.isnan("score"), F.col("score"))
    best = run.groupBy(*by, "docid").agg(F.min(rank).alias("given"), F.max(score).alias("score"))
    order = Window.partitionBy(*by).orderBy(F.col("given").asc_nulls_last(), F.col("score").desc_nulls_last(), "docid")
    return best.withColumn("rank", F.row_number().over(order)).select(*by, "docid", "score", "rank")


def reciprocal_rank_fusion(runs: DataFrame, constant: int = 60) -> DataFrame:
    """Evidence of all runs for each candidate: support, summed reciprocal rank, best and mean rank, fused ``rank``."""
    rows = runs.groupBy("qid", "docid").agg(
        F.count(F.lit(1)).alias("support"), F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("rrf"), F.min("rank").alias("best"), F.round(F.avg("rank"), 6).alias("mean_rank")
    )
    order = Window.partitionBy("qid").orderBy(F.desc("support"), F.desc("rrf"), "best", "mean_rank", "docid")
    return rows.withColumn("rank", F.row_number().over(order))


def rerank(
    run: DataFrame, queries: DataFrame, docs: DataFrame, scorer: Callable[[DataFrame], DataFrame], depth: int, keep: int | None, missing: str = "first_stage"
) -> DataFrame:
    """Rescore the first ``depth`` candidates of each query.

    ``scorer`` adds ``new_score`` to ``qid, docid, first_rank, query_text, doc_text`` and whatever other columns ``queries`` and ``docs`` bring, such as token
    lists made once a text. Candidates without text drop out. Where a query has no text or no candidate has one, ``missing`` decides:
    ``first_stage`` keeps the first-stage order, ``omit`` leaves the query out.
    """
    pool = run.filter(F.col("rank") <= depth).select("qid", "docid", F.col("rank").alias("first_rank"))
    asked = queries.withColumnRenamed("text", "query_text").filter("query_text IS NOT NULL")
    pairs = pool.join(asked, "qid").join(docs.filter("doc_text IS NOT NULL"), "docid")
    scored = scorer(pairs)
    order = Window.partitionBy("qid").orderBy(F.desc("new_score"), "first_rank")
    out = scored.withColumn("rank", F.row_number().over(order)).select("qid", "docid", "first_rank", "new_score", "rank")
    if missing == "first_stage":
        left = run.join(pairs.select("qid").distinct(), "qid", "left_anti")
        out = out.unionByName(left.select("qid", "docid", F.col("rank").alias("first_rank"), F.lit(None).cast("double").alias("new_score"), "rank"))
    return out if keep is None else out.filter(F.col("rank") <= keep)


def overlap_score(pairs: DataFrame) -> DataFrame:
    """A deterministic stand-in for a neural scorer: share of the query's distinct terms (``query_terms``) in the document (``doc_terms``)."""
    size = F.size("query_terms")
    share = F.when(size > 0, F.size(F.array_intersect("query_terms", "doc_terms")) / size).otherwise(0.0)
    return pairs.withColumn("new_score", F.round(share, 6))


def log_softmax(yes: str | Column, no: str | Column) -> Column:
    """Log probability of the first of two logits, without overflow."""
    a, b = (F.col(v) if isinstance(v, str) else v for v in (yes, no))
    top = F.greatest(a, b)
    return a - top - F.log(F.exp(a - top) + F.exp(b - top))


def ltr_features(candidates: DataFrame, signals: tuple[str, ...] = ("dense", "sparse", "late")) -> DataFrame:
    """Raw and per-query min-max signals, and three functions of the dense rank (0-based r)."""
    every = Window.partitionBy("qid")
    rows = candidates
    for s in signals:
        low, span = F.min(s).over(every), F.max(s).over(every) - F.min(s).over(every)
        rows = rows.withColumn(f"{s}_scaled", F.when(span > 1e-12, (F.col(s) - low) / span).otherwise(0.0))
    r = F.row_number().over(every.orderBy(F.desc(signals[0]), "docid")) - 1
    n = F.count(F.lit(1)).over(every)
    rows = rows.withColumn("__r", r).withColumn("__n", n)
    fraction = F.when(F.col("__n") > 1, 1 - F.col("__r") / (F.col("__n") - 1)).otherwise(1.0)
    return rows.withColumns({"rank_fraction": fraction, "rank_inverse": 1 / (F.col("__r") + 1), "rank_log": 1 / F.log2(F.col("__r") + 2)}).drop("__r", "__n")


def with_tokens(run: DataFrame, doc_tokens: DataFrame) -> DataFrame:
    """``run`` with ``tokens`` of its documents, partitioned by query: their terms are counted without another shuffle. Lists go there as one string, a third of their size."""
    packed = F.when(F.size("tokens") > 0, F.array_join("tokens", "\x01")).alias("tokens")
    return run.join(doc_tokens.select("docid", packed), "docid").repartition("qid").withColumn("tokens", F.split("tokens", "\x01"))


def feedback_terms(run: DataFrame, doc_tokens: DataFrame, k: int, n: int) -> DataFrame:
    """``qid, term, freq, pos``: the n most frequent terms of the first k documents of each query; ties in text order."""
    pool = with_tokens(run.filter(F.col("rank") <= k).select("qid", "docid"), doc_tokens)
    freq = pool.select("qid", F.explode("tokens").alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("freq"))
    order = Window.partitionBy("qid").orderBy(F.desc("freq"), "term")
    return freq.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n)


def ordered_union(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """The first ranking, then unseen documents of the second, in order; cut at k."""
    rows = first.select("qid", "docid", "rank", F.lit(0).alias("part")).unionByName(second.select("qid", "docid", "rank", F.lit(1).alias("part")))
    best = rows.groupBy("qid", "docid").agg(F.min(F.struct("part", "rank")).alias("at"))
    order = Window.partitionBy("qid").orderBy("at.part", "at.rank")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "docid", "rank")
