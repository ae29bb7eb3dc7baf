"""Problem 3: the N highest-scoring items of every group, by statistics-guided skipping.

The scored rows are clustered once: range-partitioned and sorted by (group, score descending, item), written as Parquet
with small row groups into the shared folder. A second pass gives each task some of these files; from the footers it takes the row
groups in descending maximum score and skips a row group when its maximum is strictly below the N-th score already seen for
every group it holds (known from the statistics when the row group holds one group, which is so wherever a group is larger
than a row group; one that holds several groups is read). Per-task winners, at most N for a group and row group, are merged by
one small aggregation.

Scale: the only wide shuffle moves the four needed columns; its range keys include score and item, so a group with a third of
all rows spreads over many files. No group is ever collected. Nothing is broadcast.

Defined results: null and NaN scores don't count; an item counts once per group with its highest score; ties go to the
smaller item as a whole number (items that aren't numbers come last, in text order); null group keys form a group; null items
don't count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from citeloom.session import open_shared, scratch_path


#: Bytes of input (as Catalyst estimates them) for one clustered file.
FILE_BYTES = 512 << 20
#: Catalyst's estimate of what it knows nothing of is of this order.
UNKNOWN_BYTES = 1 << 60


def item_order(item: str) -> list[Column]:
    """Ascending order of items as whole numbers, then as text."""
    number = F.expr(f"try_cast(`{item}` AS DECIMAL(38,0))")
    return [number.asc_nulls_last(), F.col(item).asc()]


def cluster_by_group(df: DataFrame, keys: list[str], item: str, score: str, row_group_rows: int = 16384, files: int | None = None) -> str:
    """Write the countable rows clustered by group with row-group statistics; returns the path."""
    spark = df.sparkSession
    path = scratch_path(spark, "clustered")
    rows = df.select(*keys, item, F.col(score).cast("double").alias(score)).filter(
        F.col(score).isNotNull() & ~F.isnan(score) & F.col(item).isNotNull()
    )
    order = [*(F.col(k).asc() for k in keys), F.col(score).desc(), *item_order(item)]
    # By size, where that asks for more files than the session has shuffle partitions; an estimate can be far too high, so 16 times as many at most.
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = files or (tasks if size >= UNKNOWN_BYTES else min(16 * tasks, max(tasks, -(-size // FILE_BYTES))))
    (
        rows.repartitionByRange(files, *order)
        .sortWithinPartitions(*order)
        .write.option("parquet.block.row.count.limit", row_group_rows)
        .parquet(path)
    )
    return path


def _row_groups(paths: list[str], keys: list[str], score: str) -> list[tuple[float, tuple | None, object, int]]:
    """(maximum score, the group if there is only one, open file, row-group number), best first."""
    found = []
    for path in paths:
        file = pq.ParquetFile(open_shared(path))
        at = {name: i for i, name in enumerate(file.schema_arrow.names)}
        for k in range(file.metadata.num_row_groups):
            meta = file.metadata.row_group(k)
            if not meta.num_rows:
                continue
            top = meta.column(at[score]).statistics
            best = top.max if top is not None and top.has_min_max else float("inf")
            stats = [meta.column(at[c]).statistics for c in keys]
            one = all(s is not None and s.has_min_max and s.null_count == 0 and s.min == s.max for s in stats)
            found.append((best, tuple(s.min for s in stats) if one else None, file, k))
    return sorted(found, key=lambda x: -x[0])


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers of the distinct values of a column, null being one of them."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _winners(rows: pa.Table, keys: list[str], item: str, n: int) -> pa.Table:
    """The first ``n`` different items of each group of rows sorted by group and rank."""
    if not len(rows):
        return rows
    new = np.zeros(len(rows), dtype=bool)
    new[0] = True
    for k in keys:
        codes = _codes(rows[k])
        new[1:] |= codes[1:] != codes[:-1]
    group = np.cumsum(new) - 1
    items = _codes(rows[item]).astype(np.int64)
    first = np.sort(np.unique(group * (items.max() + 1) + items, return_index=True)[1])
    place = np.arange(len(first)) - np.searchsorted(group[first], group[first])
    return rows.take(pa.array(first[place < n]))


def winners_of_files(paths: list[str], keys: list[str], item: str, score: str, n: int, seen: dict[str, int] | None = None) -> Iterator[pa.Table]:
    """Per-row-group winners of clustered files; ``seen`` counts row groups ``read`` and ``skipped``."""
    floor: dict[tuple, float] = {}
    seen = {} if seen is None else seen
    for best, group, file, k in _row_groups(paths, keys, score):
        if group is not None and best < floor.get(group, float("-inf")):
            seen["skipped"] = seen.get("skipped", 0) + 1
            continue
        seen["read"] = seen.get("read", 0) + 1
        rows = _winners(file.read_row_group(k, columns=[*keys, item, score]), keys, item, n)
        if group is not None and len(rows) == n:
            floor[group] = max(floor.get(group, float("-inf")), rows[score][n - 1].as_py())
        yield rows


def top_n_of_clusters(spark: SparkSession, path: str, keys: list[str], item: str, score: str, n: int) -> DataFrame:
    """Top N of every group of a clustered table; adds ``rank`` (1-based)."""
    schema = spark.read.parquet(path).select(*keys, item, score).schema
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    kinds = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = [p for batch in batches for p in batch.column("path").to_pylist()]
        for rows in winners_of_files(paths, keys, item, score, n):
            yield from rows.cast(kinds).to_batches()

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    winners = files.repartition(tasks, "path").mapInArrow(scan, schema).groupBy(*keys, item).agg(F.max(score).alias(score))
    window = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *item_order(item))
    return winners.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def top_n_per_group(
    df: DataFrame, keys: list[str], item: str, score: str, n: int, row_group_rows: int = 16384, files: int | None = None
) -> DataFrame:
    """Top N of every group of ``df``: columns ``keys``, ``item``, ``score``, ``rank``."""
    if n < 1:
        raise ValueError("n must be positive")
    names = [*keys, item, score]
    if len(set(names)) != len(names):
        raise ValueError("keys, item and score must be different columns")
    path = cluster_by_group(df, keys, item, score, row_group_rows, files)
    return top_n_of_clusters(df.sparkSession, path, keys, item, score, n)


def prediction_lists(top: DataFrame, keys: list[str], item: str) -> DataFrame:
    """List literals such as ``[12, 7]``, best first, of a top-N result (the list is bounded by N)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item])
    return top.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("preds"))


