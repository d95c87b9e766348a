"""Readers for the driver's parquet tables (one file per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet scan; naming the columns keeps the ReadSchema narrow."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """File stream over one table file.

    A file stream watches a folder or a glob; ``name[s]``-style brackets make
    a glob that matches exactly this one file, with its folder as base path.
    On a cluster the stream would watch a landing folder instead.
    """
    base = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("basePath", base).parquet(f"{base}/{name[:-1]}[{name[-1]}].parquet")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does the path exist in the file system that it names?"""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
