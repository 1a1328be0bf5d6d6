"""Structured recipes from page markup: node discovery, field mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import html as H
from larder.functions import jsonld as J
from larder.functions.ingredients import parse_ingredient_line
from larder.functions.text import let, trim
from larder.operators.keyed import pin
from larder.session import ship_package

# Fields that hold tags.
TAG_KEYS = ("recipeCategory", "recipeCuisine", "keywords")
# Fields that hold the ingredient lines.
LINE_KEYS = ("recipeIngredient", "ingredients")


def _walk(df: DataFrame, start: Column, children, levels: int, prefix: str) -> tuple[DataFrame, list[str]]:
    """Frontier expansion inside the row: one column per level, no shuffle."""
    df = df.withColumn(f"{prefix}0", start)
    names = [f"{prefix}0"]
    for depth in range(1, levels + 1):
        df = df.withColumn(f"{prefix}{depth}", children(names[-1]))
        names.append(f"{prefix}{depth}")
    return df, names


def _with_values(pages: DataFrame, html: str, out: str, texts: str) -> DataFrame:
    """Every walked JSON-LD value of a page with its path, which begins with the place of its block in ``texts``."""
    blocks = F.filter(
        F.transform(texts, lambda b, i: F.struct(
            F.array(i).alias("path"), F.try_parse_json(b).alias("node"))),
        lambda e: e["node"].isNotNull())
    keep = [F.col(c) for c in [*pages.columns, texts]]
    read = pages.withColumn(texts, H.json_ld_blocks(F.col(html)))
    walked, levels = _walk(read, blocks, J.nested_children, J.MAX_DEPTH, "_level")
    return walked.select(*keep, F.concat(*levels).alias(out))


def with_nodes(pages: DataFrame, html: str = "html", out: str = "nodes") -> DataFrame:
    """Every JSON-LD object of a page with its path; paths sort in document order.

    A malformed block is skipped without losing the others.
    """
    return _with_values(pages, html, out, "_blocks").drop("_blocks").withColumn(out, F.expr(f"filter({out}, e -> {J.is_object('e.node')})"))


def first_of_type(nodes: str, name: str) -> Column:
    """First node of a type in document order with its path, or NULL."""

    def first(found: Column) -> Column:
        return let(F.array_min(F.transform(found, lambda e: e["path"])), lambda p: F.get(
            F.filter(found, lambda e: e["path"] == p), F.lit(0)))

    return let(F.expr(f"filter({nodes}, e -> {J.has_type('e.node', name)})"), first)


def _with_recipe_entry(pages: DataFrame, html: str) -> DataFrame:
    """Pages with the JSON-LD blocks they hold and the path and node of their first recipe."""
    # What is read off the node goes through Arrow functions.
    ship_package(pages.sparkSession)
    # What has a type is an object.
    found = _with_values(pages, html, "nodes", "_blocks")
    return found.withColumn("_entry", first_of_type("nodes", "Recipe")).drop("nodes")


def with_recipe_node(pages: DataFrame, html: str = "html") -> DataFrame:
    found = _with_recipe_entry(pages, html)
    return pin(found.withColumn("node", F.col("_entry.node")).drop("_entry", "_blocks"))


def instruction_steps(df: DataFrame, source: str, out: str = "steps",
                      legacy_collapse: bool = False) -> DataFrame:
    """Flatten strings, lists, steps and sections into one ordered list of steps."""
    keep = [c for c in df.columns]
    start = F.expr(
        f"filter(array(struct(CAST(array() AS array<int>) AS path, {source} AS node)), e -> e.node IS NOT NULL)")
    walked, levels = _walk(df, start, J.step_children, J.STEP_DEPTH, "_step")
    ship_package(df.sparkSession)
    walked = walked.withColumn("_said", J.step_leaves(f"concat({', '.join(levels)})"))
    walked = walked.withColumn("_inside", J.unwrapped(F.col("_said.said"), J.TEXT_KEYS))
    texts = F.zip_with("_said", "_inside", lambda e, inside: J.step_texts(e, inside, legacy_collapse))
    ordered = F.array_sort(F.filter(texts, lambda t: F.size(t["steps"]) > 0))
    return walked.select(*keep, F.flatten(ordered["steps"]).alias(out))


def extract_recipes(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One structured recipe per page that has a usable one.

    Pages without a Recipe node are dropped before the field mapping, the
    expensive part. A node needs a title and ingredients or steps.
    """
    found = pin(_with_recipe_entry(pages.select(page_id, html), html).select(
        page_id, html, "_entry.path", "_entry.node", F.get("_blocks", F.get("_entry.path", F.lit(0))).alias("_block"),
    )).where(F.col("node").isNotNull())
    n = "node"
    raw = {
        "title": ("name", "headline"), "description": ("description",),
        "servings": ("recipeYield", "yield"), "author": ("author",),
        "total": ("totalTime",), "prep": ("prepTime",), "cook": ("cookTime",),
    }
    # All fields pass through one unwrapping and one cleaning expression, held as an array.
    fields = [*((names, J.TEXT_KEYS) for names in raw.values()), *(((k,), J.TEXT_KEYS) for k in TAG_KEYS)]
    held, listed = J.node_texts(F.col("_block"), F.col("path"), [*fields, (("image",), J.IMAGE_KEYS)], LINE_KEYS)
    numeric = ", ".join(J.is_number(J.field(n, k)) for k in ("totalTime", "prepTime", "cookTime"))
    raw_fields = found.select(
        page_id, html, "node", held.alias("_held"), listed.alias("_listed"), F.expr(f"array({numeric})").alias("_num"))
    cleaned = raw_fields.withColumns({
        "_fields": F.transform(F.slice("_held", 1, len(fields)), J.clean_texts),
        "_images": F.get("_held", F.lit(len(fields))),
        "_lines": ingredient_lines(J.first_of(n, LINE_KEYS), F.col("_listed"))}).drop("_held", "_listed")
    mapped = cleaned.withColumns({
        "_texts": F.transform("_fields", lambda parts: F.nullif(
            F.array_join(parts, ", "), F.lit(""))),
        "_tags": F.flatten(F.slice("_fields", len(raw) + 1, len(TAG_KEYS))),
        "_image": F.get(F.filter(F.transform("_images", trim), lambda u: u != ""), F.lit(0)),
    }).drop("_fields", "_images")
    names = list(raw)
    text = lambda k: F.get("_texts", F.lit(names.index(k)))
    # The durations are read once each, as values of one column that is used several times.
    timed = mapped.withColumn("_minutes", F.transform(
        F.arrays_zip(F.slice("_texts", names.index("total") + 1, 3).alias("t"), F.col("_num").alias("n")),
        lambda d: J.duration_minutes(F.when(d["n"], F.concat(F.lit("PT"), d["t"], F.lit("M"))).otherwise(d["t"])))).drop("_num")
    stepped = pin(instruction_steps(timed, J.field(n, "recipeInstructions")).drop("node"))
    total, prep, cook = (F.get("_minutes", F.lit(i)) for i in range(3))
    both = F.when(prep.isNotNull() | cook.isNotNull(),
                  F.coalesce(prep, F.lit(0)) + F.coalesce(cook, F.lit(0)))
    out = stepped.select(
        page_id, text("title").alias("title"), text("description").alias("description"),
        text("servings").alias("servings"), text("author").alias("author"),
        F.coalesce(total, both).alias("total_minutes"),
        F.filter(F.transform("_lines", parse_ingredient_line), lambda i: i.isNotNull()).alias("ingredients"),
        "steps", recipe_tags(F.col("_tags")).alias("tags"),
        F.coalesce("_image", H.meta_content(F.col(html), "og:image")).alias("image_url"),
        F.lit(0.95).alias("confidence"))
    return pin(out).where(F.col("title").isNotNull() & (
        (F.size("ingredients") > 0) | (F.size("steps") > 0)))


def ingredient_lines(value: str, listed: Column) -> Column:
    """Raw ingredient lines: elements of an array, whose texts are ``listed``, or the lines of one string."""
    joined = F.when(F.expr(J.is_array(value)), F.transform(listed, lambda t: F.array_join(t, ", ")))
    single = F.expr(f"get(transform(array({value}), v -> CASE WHEN {J.is_scalar('v')} THEN split({J.scalar_text('v')}, '\\n+') END), 0)")
    return F.filter(F.coalesce(joined, single, F.array().cast("array<string>")), lambda l: trim(l) != "")


def tag_leaves(node: str) -> Column:
    """Raw texts of everything a node is tagged with."""
    fields = ", ".join(J.field(node, k) for k in TAG_KEYS)
    return F.flatten(J.unwrapped(F.expr(f"array({fields})"), J.TEXT_KEYS))


def recipe_tags(texts: Column) -> Column:
    """Comma-split, lower-cased, distinct tags of 2 to 29 characters, at most eight."""
    split = F.flatten(F.transform(texts, lambda t: F.split(t, ",")))
    tags = F.filter(F.transform(split, lambda t: F.lower(trim(t))),
                    lambda t: (F.char_length(t) > 1) & (F.char_length(t) < 30))
    return F.slice(F.array_distinct(tags), 1, 8)
