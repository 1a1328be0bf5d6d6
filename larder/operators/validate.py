"""Schema enforcement on untrusted JSON: write bodies and model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import WS, cap, js_round, let, trim, trim_sql
from larder.operators.keyed import pin
from larder.schemas import WRITABLE_RECIPE_FIELDS

# Ranges of whole-number fields.
INT_RANGES = {"totalMinutes": (0, 10080), "servingsCount": (1, 999)}
NULLABLE_TEXT = ("description", "notes", "heroImagePath", "servings")
SNAKE = {
    "title": "title", "description": "description", "servings": "servings",
    "servingsCount": "servings_count", "totalMinutes": "total_minutes", "notes": "notes",
    "tags": "tags", "steps": "steps", "favorite": "favorite", "heroImagePath": "hero_image_path",
}


def _kind(field: str) -> str:
    """SQL text: JSON kind of a field; NULL when the key is absent."""
    v = f"try_variant_get(_v, '$.{field}', 'variant')"
    return (f"CASE WHEN NOT array_contains(_keys, '{field}') THEN NULL "
            f"WHEN is_variant_null({v}) THEN 'VOID' ELSE "
            f"regexp_extract(schema_of_variant({v}), '^[A-Z]+', 0) END")


def validate_writes(rows: DataFrame, body: str = "body", require_title: bool = False) -> DataFrame:
    """Write bodies with every writable field typed, ``has_*`` flags and the first reason to reject.

    Fields are checked in a fixed order; ``reason`` is NULL for a valid body.
    """
    parsed = rows.withColumn("_v", F.try_parse_json(body)).withColumn(
        "_keys", F.map_keys(F.expr("try_variant_get(_v, '$', 'map<string,variant>')")))
    kinds = parsed.withColumns({f"_k_{f}": F.expr(_kind(f)) for f in WRITABLE_RECIPE_FIELDS})
    kind = lambda f: F.col(f"_k_{f}")
    get = lambda f, t: F.expr(f"try_variant_get(_v, '$.{f}', '{t}')")
    text = lambda f: F.nullif(trim(get(f, "string")), F.lit(""))
    unknown = F.array_except("_keys", F.array(*[F.lit(f) for f in WRITABLE_RECIPE_FIELDS]))
    is_text_list = lambda f: F.expr(
        f"coalesce(forall(try_variant_get(_v, '$.{f}', 'array<variant>'), "
        "x -> schema_of_variant(x) = 'STRING'), false)")

    bad: list[tuple[Column, Column]] = [
        (F.col("_keys").isNull(), F.lit("Body must be a JSON object.")),
        (F.size(unknown) > 0, F.concat(F.lit("Unknown field: "), F.array_join(unknown, ", "))),
    ]
    if require_title:
        bad.append((kind("title").isNull(), F.lit("`title` is required.")))
    bad.append((kind("title").isNotNull() & ((kind("title") != "STRING") | text("title").isNull()),
                F.lit("`title` must be a non-empty string.")))
    for f in NULLABLE_TEXT:
        bad.append((~kind(f).isin("STRING", "VOID"), F.lit(f"`{f}` must be a string or null.")))
    for f, (low, high) in INT_RANGES.items():
        n = get(f, "double")
        whole = kind(f).isin("BIGINT", "DECIMAL", "DOUBLE") & (n == F.floor(n))
        bad.append((kind(f).isNotNull() & (kind(f) != "VOID") & ~F.coalesce(whole, F.lit(False)),
                    F.lit(f"`{f}` must be an integer or null.")))
        bad.append((~n.between(low, high), F.lit(f"`{f}` must be between {low} and {high}.")))
    bad.append((kind("favorite") != "BOOLEAN", F.lit("`favorite` must be a boolean.")))
    for f in ("steps", "tags"):
        bad.append((kind(f).isNotNull() & ~is_text_list(f), F.lit(f"`{f}` must be an array of strings.")))
    bad.append((kind("ingredients").isNotNull() & (kind("ingredients") != "ARRAY"),
                F.lit("`ingredients` must be an array of objects.")))
    bad.append((kind("ingredients").isNotNull(), ingredient_error("_v")))
    reason = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), why) for c, why in bad])

    lists = lambda f: F.filter(F.transform(get(f, "array<string>"), trim), lambda x: x != "")
    values = {
        "title": text("title"), **{SNAKE[f]: text(f) for f in NULLABLE_TEXT},
        **{SNAKE[f]: get(f, "double").try_cast("int") for f in INT_RANGES},
        "favorite": get("favorite", "boolean"), "steps": lists("steps"), "tags": lists("tags"),
        "ingredients": clean_ingredients("_v"),
    }
    flags = {f"has_{SNAKE.get(f, f)}": kind(f).isNotNull() for f in WRITABLE_RECIPE_FIELDS}
    keep = [F.col(c) for c in rows.columns if c != body]
    return pin(kinds.select(
        *keep, reason.alias("reason"),
        *[F.when(F.col("_keys").isNotNull(), v).alias(k) for k, v in values.items()],
        *[v.alias(k) for k, v in flags.items()]))


def ingredient_error(v: str) -> Column:
    """Message for the first malformed ingredient, NULL when all are well formed."""
    return F.expr(f"""get(filter(transform(try_variant_get({v}, '$.ingredients', 'array<variant>'), (x, i) -> CASE
        WHEN try_variant_get(x, '$', 'map<string,variant>') IS NULL THEN concat('`ingredients[', i, ']` must be an object.')
        WHEN coalesce(schema_of_variant(try_variant_get(x, '$.item', 'variant')) <> 'STRING'
          OR {trim_sql("try_variant_get(x, '$.item', 'string')")} = '', true)
          THEN concat('`ingredients[', i, '].item` must be a non-empty string.')
        ELSE concat('`ingredients[', i, '].', get(filter(array('quantity', 'unit', 'note'), k ->
          coalesce(schema_of_variant(element_at(try_variant_get(x, '$', 'map<string,variant>'), k))
            NOT IN ('STRING', 'VOID'), false)), 0), '` must be a string.') END), m -> m IS NOT NULL), 0)""".replace(
        "element_at(", "try_element_at("))


def clean_ingredients(v: str) -> Column:
    """Well-formed ingredients with trimmed fields; blank ones are absent."""
    field = lambda k: f"""nullif({trim_sql(f"try_variant_get(x, '$.{k}', 'string')")}, '') AS {k}"""
    return F.expr(
        f"transform(try_variant_get({v}, '$.ingredients', 'array<variant>'), x -> struct("
        + ", ".join(field(k) for k in ("quantity", "unit", "item", "note")) + "))")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where(F.col("reason").isNull()), checked.where(F.col("reason").isNotNull())


# Ceilings of model output.
MAX_CHARS = {
    "title": 200, "description": 2000, "servings": 100, "notes": 4000, "step": 1000, "tag": 40,
    "item": 200, "note": 300, "quantity": 40, "unit": 40,
}
MAX_INGREDIENTS, MAX_STEPS, MAX_TAGS = 100, 60, 5
UNTITLED = "Untitled recipe"


def coerce_parsed(rows: DataFrame, value: str = "value") -> DataFrame:
    """Model output as a typed recipe: wrong types tolerated, every field capped.

    ``is_recipe`` holds only when the model said so and there is something to cook.
    """
    def text_of(v: str) -> str:
        return (f"CASE WHEN schema_of_variant({v}) = 'STRING' THEN try_variant_get({v}, '$', 'string') END")

    def number_of(v: str) -> str:
        return (f"CASE WHEN rlike(schema_of_variant({v}), '^(BIGINT|DECIMAL|DOUBLE)') THEN "
                f"try_variant_get({v}, '$', 'double') END")

    at = lambda k: f"try_variant_get(_v, '$.{k}', 'variant')"
    raw = rows.withColumn("_v", F.try_parse_json(value)).select(
        *[c for c in rows.columns if c != value],
        *[F.expr(text_of(at(k))).alias(f"_{k}") for k in ("title", "description", "servings", "notes")],
        F.expr(number_of(at("totalMinutes"))).alias("_minutes"),
        F.expr(number_of(at("confidence"))).alias("_confidence"),
        F.expr(f"CASE WHEN schema_of_variant({at('isRecipe')}) = 'BOOLEAN' THEN "
               "try_variant_get(_v, '$.isRecipe', 'boolean') END").alias("_said"),
        *[F.expr(f"transform(try_variant_get(_v, '$.{k}', 'array<variant>'), x -> {text_of('x')})").alias(f"_{k}")
          for k in ("steps", "tags")],
        F.expr("transform(try_variant_get(_v, '$.ingredients', 'array<variant>'), x -> struct(" + ", ".join(
            f"{text_of(f'''try_variant_get(x, '$.{k}', 'variant')''')} AS {k}"
            for k in ("quantity", "unit", "item", "note")) + "))").alias("_ingredients"))

    def capped(c: Column, limit: int) -> Column:
        return let(F.nullif(trim(c), F.lit("")), lambda s: cap(s, limit))

    none_struct = "array<struct<quantity:string,unit:string,item:string,note:string>>"
    ingredients = F.slice(F.filter(F.transform("_ingredients", lambda i: F.struct(*[
        capped(i[k], MAX_CHARS[k]).alias(k) for k in ("quantity", "unit", "item", "note")])),
        lambda i: i["item"].isNotNull()), 1, MAX_INGREDIENTS)
    steps = F.slice(F.filter(F.transform("_steps", lambda s: cap(trim(F.regexp_replace(
        s, rf"^{WS}*\d+[.)]{WS}*", "")), MAX_CHARS["step"])), lambda s: F.char_length(s) > 0), 1, MAX_STEPS)
    tags = F.slice(F.array_distinct(F.filter(F.transform(
        "_tags", lambda t: F.regexp_replace(F.lower(trim(t)), "^#", "")),
        lambda t: (F.char_length(t) > 1) & (F.char_length(t) < MAX_CHARS["tag"]))), 1, MAX_TAGS)
    typed = raw.select(
        *[c for c in rows.columns if c != value], "_said",
        F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_confidence"))), F.lit(0.5)).alias("confidence"),
        F.coalesce(capped(F.col("_title"), MAX_CHARS["title"]), F.lit(UNTITLED)).alias("title"),
        capped(F.col("_description"), MAX_CHARS["description"]).alias("description"),
        capped(F.col("_servings"), MAX_CHARS["servings"]).alias("servings"),
        F.nullif(F.greatest(F.lit(0), js_round(F.col("_minutes")).try_cast("int")), F.lit(0)).alias("total_minutes"),
        F.coalesce(ingredients, F.array().cast(none_struct)).alias("ingredients"),
        F.coalesce(steps, F.array().cast("array<string>")).alias("steps"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        capped(F.col("_notes"), MAX_CHARS["notes"]).alias("notes"))
    has_content = (F.size("ingredients") > 0) | (F.size("steps") > 0)
    return typed.withColumn(
        "is_recipe", F.coalesce(F.col("_said"), F.lit(False)) & has_content).drop("_said")
