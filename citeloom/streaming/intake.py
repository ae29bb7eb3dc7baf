"""Incremental intake of run deliveries: repeated rows are dropped as they stream in, the current state is read from the sink.

Late rows are kept within ``lateness`` of the newest run time; state for older run times is released, so memory is bounded by the
deliveries of that span. The sink is append-only Parquet with a checkpoint beside it, so a restarted stream continues exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.session import scratch_path


def deduplicated_stream(spark: SparkSession, source: str, time: str = "run_at", lateness: str = "60 days") -> DataFrame:
    """A streaming DataFrame of the Parquet files under ``source``, each distinct row once."""
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(source)
    keyed = rows.withColumn("__key", F.md5(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))).withColumn(time, F.col(time).cast("timestamp"))
    return keyed.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def take_in(spark: SparkSession, source: str, sink: str | None = None) -> DataFrame:
    """Run the intake over what is there now and read the sink."""
    sink = sink or scratch_path(spark, "intake")
    stream = deduplicated_stream(spark, source)
    query = stream.writeStream.format("parquet").option("path", f"{sink}/rows").option("checkpointLocation", f"{sink}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    given = dict(spark.read.parquet(source).dtypes)
    return spark.read.schema(stream.schema).parquet(f"{sink}/rows").select(*[F.col(c).cast(given[c]).alias(c) for c in stream.columns])


def hourly_deliveries(rows: DataFrame) -> DataFrame:
    """Deliveries and mean delay in seconds per hour of run time and system; works on batches and on streams."""
    delay = F.unix_timestamp("loaded_at") - F.unix_timestamp("run_at")
    return rows.groupBy(F.window("run_at", "1 hour").alias("w"), "run_id").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(delay), 3).alias("delay")).select(
        F.col("w.start").alias("hour"), "run_id", "rows", "delay"
    )
