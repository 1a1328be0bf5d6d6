"""Catalog queries: search, filters, orders, keyset pages, nested reads."""

from __future__ import annotations

from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import clean_line
from larder.schemas import JOB_STATUSES
from larder.operators.keyed import lookup, spread_lookup

# Sort orders are total: every one ends in the id.
ORDERS = {
    "recent": (("created_at", "desc"), ("id", "desc")),
    "title": (("title", "asc"), ("id", "asc")),
    "cooked": (("cooked_count", "desc"), ("last_cooked_at", "desc"), ("id", "desc")),
}
UNFILED = "none"


def sort_columns(sort: str) -> list[Column]:
    """NULLs come first ascending and last descending."""
    if sort not in ORDERS:
        raise ValueError(f"sort must be one of: {', '.join(ORDERS)}")
    return [F.asc_nulls_first(c) if d == "asc" else F.desc_nulls_last(c) for c, d in ORDERS[sort]]


def parse_limit(raw: str | int | None, default: int = 50, maximum: int = 200) -> int:
    """Page size from a request value: default when absent, clamped, never below 1."""
    text = "" if raw is None else str(raw).strip()
    if not text:
        return default
    digits = text.lstrip("+-")
    number = "".join(takewhile(str.isdigit, digits))
    if not number or text.startswith("-") or int(number) < 1:
        raise ValueError("limit must be a positive integer")
    return min(int(number), maximum)


def normalise_query(raw: str | None) -> str:
    return " ".join((raw or "").split())


def favourite_flag(raw: str | None) -> bool | None:
    """Absent means no filter; ``false`` and ``0`` mean not favourite."""
    return None if raw is None else raw not in ("false", "0")


def search(recipes: DataFrame, text: str | None) -> DataFrame:
    """Case-insensitive literal substring over title, description, tags and item names.

    Notes, units and field names are not searched. ``contains`` takes ``%`` and
    ``_`` literally, which a LIKE pattern would not.
    """
    needle = normalise_query(text).lower()
    if not needle:
        return recipes
    q = F.lit(needle)
    hit = lambda c: F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    return recipes.where(
        hit(F.col("title")) | hit(F.col("description"))
        | F.exists("tags", hit) | F.exists("ingredients", lambda i: hit(i["item"])))


def with_tag(recipes: DataFrame, tag: str | None) -> DataFrame:
    """Whole-tag match, case-insensitive."""
    if not tag or not tag.strip():
        return recipes
    return recipes.where(F.exists("tags", lambda t: F.lower(t) == tag.strip().lower()))


def favourites(recipes: DataFrame, raw: str | None) -> DataFrame:
    flag = favourite_flag(raw)
    return recipes if flag is None else recipes.where(F.col("favorite") == F.lit(flag))


def in_folder(recipes: DataFrame, links: DataFrame, folder: str | None) -> DataFrame:
    """Recipes filed in one folder, or in none for the reserved value ``none``."""
    if not folder:
        return recipes
    if folder == UNFILED:
        return recipes.join(links, recipes["id"] == links["recipe_id"], "left_anti")
    chosen = links.where(F.col("folder_id") == folder)
    return recipes.join(chosen, recipes["id"] == chosen["recipe_id"], "left_semi")


def after_cursor(recipes: DataFrame, sort: str, cursor) -> DataFrame:
    """Rows that come after the cursor row in the given order.

    The cursor row is one row by key, read once for its sort values, so the
    page itself is a plain predicate on the scan.
    """
    keys = [c for c, _ in ORDERS[sort]]
    at = recipes.where(F.col("id") == F.lit(cursor)).select(*keys).limit(1).first()
    if at is None:
        raise ValueError("unknown cursor")

    def beyond(column: str, direction: str, value) -> Column:
        c = F.col(column)
        if direction == "asc":  # NULLs first
            return c.isNotNull() if value is None else c > F.lit(value)
        if value is None:  # NULLs last: nothing comes after a NULL
            return F.lit(False)
        return (c < F.lit(value)) | c.isNull()

    steps, same = [], F.lit(True)
    for (column, direction) in ORDERS[sort]:
        steps.append(same & beyond(column, direction, at[column]))
        same = same & F.col(column).eqNullSafe(F.lit(at[column]))
    return recipes.where(reduce(lambda a, b: a | b, steps))


def page(recipes: DataFrame, sort: str = "recent", limit: int | str | None = None,
         cursor=None) -> DataFrame:
    """One page in a total order; ``next_cursor`` is its last id when more rows follow."""
    size = parse_limit(limit)
    rows = recipes if cursor is None else after_cursor(recipes, sort, cursor)
    # One row more than the page tells whether another page exists.
    fetched = rows.orderBy(*sort_columns(sort)).limit(size + 1)
    from pyspark.sql import Window

    numbered = fetched.withColumns({
        "_n": F.row_number().over(Window.orderBy(*sort_columns(sort))),
        "_all": F.count("*").over(Window.partitionBy(F.lit(1))),
    })
    last = F.max(F.when(F.col("_n") == size, F.col("id"))).over(Window.partitionBy(F.lit(1)))
    return numbered.withColumn(
        "next_cursor", F.when(F.col("_all") > size, last)).where(
        F.col("_n") <= size).drop("_n", "_all")


def top(recipes: DataFrame, sort: str, n: int) -> DataFrame:
    return recipes.orderBy(*sort_columns(sort)).limit(n)


def with_folder_ids(recipes: DataFrame, links: DataFrame) -> DataFrame:
    """Attach ``folder_ids``; links are reduced to one row per recipe before the join."""
    per_recipe = links.groupBy(F.col("recipe_id").alias("id")).agg(
        F.array_sort(F.collect_set("folder_id")).alias("folder_ids"))
    return recipes.join(per_recipe, "id", "left").withColumn(
        "folder_ids", F.coalesce("folder_ids", F.array().cast("array<string>")))


def folder_counts(folders: DataFrame, links: DataFrame) -> DataFrame:
    """Folders with the number of recipes in each, empty folders included."""
    counts = links.groupBy(F.col("folder_id").alias("id")).agg(F.count("*").alias("recipe_count"))
    return folders.join(counts, "id", "left").withColumn(
        "recipe_count", F.coalesce("recipe_count", F.lit(0).cast("long")))


def folder_order(folders: DataFrame, by_bytes: bool = True) -> DataFrame:
    """By name: byte order as stored, or ignoring case and accents as shown."""
    name = F.col("name") if by_bytes else F.collate("name", "UNICODE_CI_AI")
    return folders.orderBy(name.asc())


def jobs_with_recipes(jobs: DataFrame, recipes: DataFrame, links: DataFrame) -> DataFrame:
    """Jobs with the recipe they produced and that recipe's folders."""
    read = with_folder_ids(recipes, links).select(
        F.col("id").alias("recipe_id"), F.col("title").alias("recipe_title"), "folder_ids")
    return lookup(jobs, read, ["recipe_id"])


def job_read(jobs: DataFrame, recipes: DataFrame) -> DataFrame:
    """Single-job view: the recipe rides along only once the job is done."""
    read = recipes.select(F.col("id").alias("_rid"), F.col("title").alias("recipe_title"))
    asked = jobs.withColumn("_rid", F.when(F.col("status") == "done", F.col("recipe_id")))
    return lookup(asked, read, ["_rid"]).drop("_rid")


def jobs_by_status(jobs: DataFrame, status: str | None) -> DataFrame:
    if not status:
        return jobs
    if status not in JOB_STATUSES:
        raise ValueError(f"status must be one of: {', '.join(JOB_STATUSES)}")
    return jobs.where(F.col("status") == status)


def recent_jobs(jobs: DataFrame, limit: int | str | None = None) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(parse_limit(limit, 20, 100))


def attach_open_job(submitted: DataFrame, jobs: DataFrame) -> DataFrame:
    """Submissions with the newest open job of their URL; NULL means create one."""
    opened = jobs.where(F.col("status").isin("pending", "running")).groupBy("url").agg(
        F.max_by("id", F.struct("created_at", "id")).alias("open_job_id"))
    return spread_lookup(submitted, opened, "url")


def unknown_ids(requested: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Requested ids that do not exist, with the message that reports them."""
    missing = requested.join(known.select(column).distinct(), column, "left_anti")
    return missing.withColumn("reason", F.concat(
        F.lit("Unknown folder id(s): "), F.col(column), F.lit(".")))


def keep_known(rows: DataFrame, ids: str, known: DataFrame, known_id: str = "id") -> DataFrame:
    """Drop ids from an array column when their folder no longer exists, order kept."""
    rest = [c for c in rows.columns if c not in ("id", ids)]
    exploded = rows.select("id", F.struct(F.lit(1), *rest).alias("_rest"), F.posexplode_outer(ids).alias("_pos", "_id"))
    live = known.select(F.col(known_id).alias("_id"), F.lit(True).alias("_live")).distinct()
    kept = F.when(F.col("_live"), F.struct("_pos", "_id"))
    whole = spread_lookup(exploded, live, "_id", spread=["id", "_pos"]).groupBy("id").agg(
        F.any_value("_rest").alias("_rest"), F.array_sort(F.collect_list(kept)).alias("_kept"))
    column = {"id": F.col("id"), ids: F.col("_kept")["_id"].alias(ids)}
    return whole.select(*[column.get(c, F.col(f"_rest.{c}")) for c in rows.columns])


def content_counts(recipes: DataFrame) -> DataFrame:
    return recipes.select(
        "id", F.size("ingredients").alias("ingredient_count"), F.size("steps").alias("step_count"))


def clean_names(rows: DataFrame, name: str = "name", limit: int = 40) -> DataFrame:
    """Trimmed, collapsed and capped folder names; NULL when nothing is left."""
    cut = F.substring(clean_line(F.col(name)), 1, limit)
    return rows.withColumn(name, F.nullif(cut, F.lit("")))
