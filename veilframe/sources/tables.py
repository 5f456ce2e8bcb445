"""Parquet tables of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a folder of Parquet tables (a file or a directory each)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 20, **options: str) -> DataFrame:
    """A table of a relational database; read in ``partitions`` ranges of ``key`` if its bounds are given. The
    database's driver has to be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def write(rows: DataFrame, folder: str, name: str, partition_by: str | None = None) -> None:
    """Writes a table over what was there; pseudonyms go by ``domainid`` and instances by ``entity_type_id``, so that
    lookups within a domain or type read its partition only."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{folder}/{name}.parquet")
