"""Content-addressed and all-or-nothing writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import digest_name


def content_addressed(rows: DataFrame, content: str, extension: str = "") -> DataFrame:
    """One row per distinct content, named by its digest.

    Grouping on the 20-character name combines copies before the shuffle, so a
    hot content costs one row per input task.
    """
    named = rows.select(digest_name(F.col(content), extension).alias("name"), content)
    return named.groupBy("name").agg(
        F.any_value(content).alias(content), F.count("*").alias("copies"))


def write_content_addressed(
    rows: DataFrame, content: str, path: str, existing: DataFrame | None = None,
    extension: str = "",
) -> None:
    """Append contents that are not stored yet."""
    fresh = content_addressed(rows, content, extension).drop("copies")
    if existing is not None:
        fresh = fresh.join(existing.select("name"), "name", "left_anti")
    fresh.write.mode("append").parquet(path)


def overwrite_partitions(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Replace exactly the partitions present in ``rows``; the committer renames at the end."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partition_by).parquet(path)


def publish_tables(tables: dict[str, DataFrame], root: str) -> str:
    """Write new versions of several tables, then make them visible together.

    Readers follow the newest row of ``_published``; it is appended only after
    every table is complete, so a failed run leaves the old versions in place.
    """
    version = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}/{version}")
    spark.range(1).select(
        F.lit(version).alias("version"), F.array(*[F.lit(n) for n in tables]).alias("names"),
        F.current_timestamp().alias("published_at"),
    ).write.mode("append").parquet(f"{root}/_published")
    return version


def read_published(spark: SparkSession, root: str, *names: str) -> dict[str, DataFrame]:
    """The tables of the newest published version.

    The version is looked up once, so tables read together belong together even
    if another version appears meanwhile.
    """
    newest = spark.read.parquet(f"{root}/_published").agg(
        F.max_by(F.struct("version", "names"), F.struct("published_at", "version")).alias("v")).first()["v"]
    missing = sorted(set(names) - set(newest["names"]))
    if missing:
        raise KeyError(f"not in the newest version: {', '.join(missing)}")
    return {n: spark.read.parquet(f"{root}/{n}/{newest['version']}") for n in names or newest["names"]}
