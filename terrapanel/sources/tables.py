"""Scans, incremental ingest, partition-wise sinks and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_partitions(spark: SparkSession, root: str, city, months: list[int], cells: DataFrame | None = None) -> DataFrame:
    """Selected months of one city of a panel stored by city and month: partition pruning, then a semi join on cells."""
    df = spark.read.parquet(root).where((F.col("city") == city) & F.col("month").isin(months))
    return df.join(cells, cells.columns, "left_semi") if cells is not None else df


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and enforced types; a row that breaks them fails the job."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def import_mapped(df: DataFrame, mapping: dict[str, str], constants: dict[str, str], day: str | None = None) -> DataFrame:
    """Rename by mapping (canonical: source), add constants and the parts of a date column."""
    out = df.select(*[F.col(f"`{source}`").alias(name) for name, source in mapping.items()], *[F.lit(v).alias(k) for k, v in constants.items()])
    if day:
        out = out.withColumn("year", F.year(day)).withColumn("month", F.month(day))
    return out


def completeness(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing, extra or found more than once, with their status."""
    n = found.groupBy(*keys).agg(F.count("*").alias("n"))
    j = expected.distinct().withColumn("_e", F.lit(True)).join(n, keys, "full")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    return j.select(*keys, status.alias("status")).where("status is not null")


def write_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace only the partitions that occur in df; all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_release(df: DataFrame, path: str) -> DataFrame:
    """Write once (an existing release is an error) and return its manifest row: count and content fingerprint."""
    df.write.mode("errorifexists").parquet(path)
    return fingerprint(df.sparkSession.read.parquet(path))


def row_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: number of rows and an order-free content hash."""
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])).alias("content"))


def ingest_new_files(spark: SparkSession, root: str, schema: str, out: str, checkpoint: str, keys: list[str]) -> None:
    """Process only files not seen before: file stream, one available-now run; the checkpoint is the skip list."""

    def put(batch: DataFrame, number: int) -> None:
        audit = batch.groupBy(*keys).agg(F.count("*").alias("n_rows")).withColumn("batch", F.lit(number))
        batch.write.mode("append").parquet(f"{out}/rows")
        audit.write.mode("append").parquet(f"{out}/audit")

    stream = spark.readStream.schema(schema).parquet(root)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
