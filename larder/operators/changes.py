"""Change application. Parquet has no MERGE, so each job returns the new version of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.quantity import servings_count


def replace_links(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Replace the folder set of every changed recipe; repeating it changes nothing.

    ``wanted`` has one row per recipe with its complete ``folder_ids``.
    """
    untouched = links.join(wanted.select("recipe_id"), "recipe_id", "left_anti")
    fresh = wanted.select(F.explode(F.array_distinct("folder_ids")).alias("folder_id"), "recipe_id")
    return untouched.select("folder_id", "recipe_id").unionByName(fresh).dropDuplicates()


def apply_patches(base: DataFrame, patches: DataFrame) -> DataFrame:
    """Partial update: only fields present in a patch change.

    ``patches`` carries ``has_<field>`` flags. The servings number follows the
    servings text unless the patch sets it explicitly.
    """
    p = patches.select(F.col("recipe_id").alias("id"), *[
        F.col(c).alias(f"_{c}") for c in patches.columns if c != "recipe_id"])
    joined = base.join(p, "id", "left")

    def patched(field: str):
        return F.when(F.col(f"_has_{field}"), F.col(f"_{field}")).otherwise(F.col(field))

    count = (
        F.when(F.col("_has_servings_count"), F.col("_servings_count"))
        .when(F.col("_has_servings"), servings_count(F.col("_servings")))
        .otherwise(F.col("servings_count")))
    fields = [c for c in base.columns if f"has_{c}" in patches.columns and c != "servings_count"]
    return joined.select(*[
        count.cast("int").alias(c) if c == "servings_count"
        else patched(c).alias(c) if c in fields else F.col(c)
        for c in base.columns])


def create_manual(rows: DataFrame) -> DataFrame:
    """New hand-entered recipes: provenance is forced, not taken from the input."""
    return rows.withColumns({
        "source_platform": F.lit("manual"),
        "servings_count": F.coalesce("servings_count", servings_count(F.col("servings"))),
        "cooked_count": F.lit(0),
        "favorite": F.coalesce("favorite", F.lit(False)),
    })


def upsert(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Insert or replace whole rows by key; other rows stay."""
    c = changes.select(F.col(key), F.struct(*changes.columns).alias("_new"))
    b = base.select(F.col(key), F.struct(*base.columns).alias("_old"))
    merged = b.join(c, key, "full_outer")
    return merged.select(*[
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{n}")).otherwise(F.col(f"_old.{n}")).alias(n)
        for n in base.columns])


def cascade_delete(links: DataFrame, deleted: DataFrame, key: str = "recipe_id") -> DataFrame:
    return links.join(deleted.select(key).distinct(), key, "left_anti").select(*links.columns)


def null_deleted(rows: DataFrame, deleted: DataFrame, key: str = "recipe_id") -> DataFrame:
    """Rows survive the deletion of what they refer to; the reference becomes NULL."""
    gone = deleted.select(key, F.lit(True).alias("_gone")).distinct()
    return rows.join(gone, key, "left").withColumn(
        key, F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(key))).select(*rows.columns)


def set_flag(rows: DataFrame, changes: DataFrame, flag: str, key: str = "id") -> DataFrame:
    new = changes.select(key, F.col(flag).alias("_new"))
    return rows.join(new, key, "left").withColumn(
        flag, F.coalesce("_new", flag)).select(*rows.columns)


def delete_by_id(rows: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(deleted.select(key).distinct(), key, "left_anti").select(*rows.columns)


def folder_count_delta(folders: DataFrame, changes: DataFrame) -> DataFrame:
    """Adjust folder counts by before/after id sets of changed recipes, never below zero.

    Rises and falls are summed per folder before the join.
    """
    added = F.transform(F.array_except("after", "before"), lambda f: F.struct(
        f.alias("id"), F.lit(1).alias("d")))
    removed = F.transform(F.array_except("before", "after"), lambda f: F.struct(
        f.alias("id"), F.lit(-1).alias("d")))
    delta = changes.select(F.explode(F.concat(added, removed)).alias("c")).groupBy(
        F.col("c.id").alias("id")).agg(F.sum("c.d").alias("_delta"))
    total = F.col("recipe_count") + F.coalesce("_delta", F.lit(0))
    return folders.join(delta, "id", "left").withColumn(
        "recipe_count", F.greatest(F.lit(0).cast("long"), total)).drop("_delta")


def name_conflicts(new: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """New names with whether they are taken, by an existing row or an earlier new one."""
    fold = F.lower(F.trim(F.col(name)))
    taken = existing.select(fold.alias("_k")).distinct().withColumn("_taken", F.lit(True))
    first = new.groupBy(fold.alias("_k")).agg(F.min("id").alias("_first"))
    keyed = new.withColumn("_k", fold).join(first, "_k", "left").join(taken, "_k", "left")
    return keyed.withColumn("conflict", F.coalesce("_taken", F.lit(False)) | (
        F.col("id") != F.col("_first"))).select(*new.columns, "conflict")


def overlay(base: DataFrame, part: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field-wise overlay: provided fields replace (also with NULL), absent ones keep.

    ``tiers`` is a trace and is appended to.
    """
    p = part.select(key, F.col("tiers").alias("_tiers"), *[
        F.col(c).alias(f"_{c}") for f in fields for c in (f, f"has_{f}")])
    joined = base.join(p, key, "left")
    empty = F.array().cast("array<string>")
    return joined.select(key, *[
        F.when(F.col(f"_has_{f}"), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        F.concat("tiers", F.coalesce("_tiers", empty)).alias("tiers"))
