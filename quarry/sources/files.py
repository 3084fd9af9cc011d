"""File sources and sinks of the batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns a classification file must have.
CLASSIFICATION_COLUMNS = ("Title", "MongoDB_ID", "Broad_Theme", "L1_Score", "L1_Confidence", "IITD_Department", "Domain", "Sub_Domain", "L3_Score", "L3_Confidence", "Topic")


def read_classification_csv(spark: SparkSession, path: str, required: tuple[str, ...] = CLASSIFICATION_COLUMNS) -> DataFrame:
    """All columns as trimmed text plus ``row_id`` in reading order; empty lines are skipped.

    An empty file or a missing column is an error.
    """
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if df.isEmpty():
        raise ValueError("no rows")
    return df.withColumn("row_id", F.monotonically_increasing_id())


def assert_one_parent(rows: DataFrame, child: str = "Sub_Domain", parent: str = "Domain") -> None:
    """Every child under one parent, else an error that names some."""
    bad = rows.where(F.col(child).isNotNull()).groupBy(child).agg(F.countDistinct(parent).alias("n")).where("n > 1").limit(5).collect()
    if bad:
        raise ValueError(f"{child} under several {parent}: {', '.join(r[0] for r in bad)}")


def write_table(df: DataFrame, path: str, cluster_by: tuple[str, ...] = (), dry_run: bool = False) -> DataFrame:
    """Full rebuild of a table; sorted within partitions by ``cluster_by`` for pruning. A dry run computes and writes nothing."""
    out = df.sortWithinPartitions(*cluster_by) if cluster_by else df
    if not dry_run:
        out.write.mode("overwrite").parquet(path)
    return out


def write_keyed(df: DataFrame, path: str, key: str, dry_run: bool = False) -> DataFrame:
    """Table with one row per key, so that a rerun replaces what it wrote."""
    return write_table(df.where(F.col(key).isNotNull()).dropDuplicates([key]), path, (key,), dry_run)
