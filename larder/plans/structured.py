"""Structured extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import jsonld as J
from larder.operators import structured as S
from larder.plans import duck as D
from larder.plans.registry import query

# Frontier walk as a recursive query; the path array sorts in document order.
NODES = r"""b AS (SELECT page_id, i - 1 AS blk, trim(regexp_replace(regexp_replace(x[i], '^\s*<!\[CDATA\[', ''), '\]\]>\s*$', '')) AS t
  FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*type\s*=\s*["'']?application/ld\+json["'']?[^>]*>(.*?)</script>', 1) AS x FROM @ld_pages_v) p,
  LATERAL (SELECT unnest(generate_series(1, len(x))) AS i) g),
walk AS (SELECT page_id, [blk] AS path, CAST(t AS JSON) AS v, 0 AS depth FROM b WHERE json_valid(t)
  UNION ALL SELECT w.page_id, list_append(w.path, c.k), c.v, w.depth + 1 FROM walk w, LATERAL (
    SELECT n - 1 AS k, json_extract(w.v, '$[' || CAST(n - 1 AS VARCHAR) || ']') AS v FROM (SELECT unnest(generate_series(1, CAST(json_array_length(w.v) AS BIGINT))) AS n) z
      WHERE json_type(w.v) = 'ARRAY'
    UNION ALL SELECT n, json_extract(w.v, p) FROM (VALUES (0, '$."@graph"'), (1, '$.mainEntity'), (2, '$.mainEntityOfPage'), (3, '$.itemListElement'), (4, '$.hasPart')) f(n, p)
      WHERE json_type(w.v) = 'OBJECT' AND json_extract(w.v, p) IS NOT NULL) c WHERE w.depth < 8),
nodes AS (SELECT page_id, path, v FROM walk WHERE json_type(v) = 'OBJECT')"""
FIRST = """typed AS (SELECT *, json_extract(v, '$."@type"') AS t FROM nodes),
r AS (SELECT page_id, v FROM typed WHERE (json_type(t) = 'VARCHAR' AND lower(t ->> '$') = 'recipe')
  OR (json_type(t) = 'ARRAY' AND len(list_filter(CAST(t AS VARCHAR[]), lambda s: lower(s) = 'recipe')) > 0)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY path) = 1)"""
TEXT = lambda p: D.trim(D.collapse(D.decode(f"regexp_replace(v ->> '{p}', '<[^>]+>', ' ', 'g')")))
MIN = lambda x: (
    f"""CASE WHEN regexp_matches({x}, '^P(\\d+D)?(T(\\d+H)?(\\d+M)?(\\d+S)?)?$') THEN nullif(CAST(floor(
  coalesce(TRY_CAST(regexp_extract({x}, '(\\d+)D', 1) AS DOUBLE), 0) * 1440 + coalesce(TRY_CAST(regexp_extract({x}, '(\\d+)H', 1) AS DOUBLE), 0) * 60
  + coalesce(TRY_CAST(regexp_extract({x}, '(\\d+)M', 1) AS DOUBLE), 0) + coalesce(TRY_CAST(regexp_extract({x}, '(\\d+)S', 1) AS DOUBLE), 0) / 60 + 0.5) AS INTEGER), 0) END""")
TOTAL = "CASE WHEN json_type(v, '$.totalTime') IN ('UBIGINT', 'BIGINT') THEN 'PT' || (v ->> '$.totalTime') || 'M' ELSE v ->> '$.totalTime' END"
MINUTES = f"coalesce({MIN(TOTAL)}, {MIN('(v ->> ' + repr('$.prepTime') + ')')} + coalesce({MIN('(v ->> ' + repr('$.cookTime') + ')')}, 0))"
STEPS = """array_to_string(CASE WHEN page_id % 4 = 0 THEN ['Mix.', 'Serve.'] WHEN page_id % 4 = 1 THEN ['Chop.', 'Wash.', 'Fry well.']
  WHEN page_id % 4 = 2 THEN ['Boil water', 'Add pasta'] ELSE ['Stir it', 'Bake'] END, '|')"""
INGS = """CASE WHEN (v -> '$.recipeIngredient') IS NULL THEN '' ELSE '1;lb;shrimp;peeled and deveined|' || CAST(page_id % 9 AS VARCHAR)
  || ';cups;flour;sifted|1 1/2;tbsp;olive oil;|;;salt & pepper;' END"""
HAS_TITLE = "(v ->> '$.name') IS NOT NULL"
EXTRACTED = f"""SELECT page_id, {TEXT('$.name')} AS title, CASE WHEN json_type(v, '$.recipeYield') = 'ARRAY' THEN
  array_to_string(CAST(v -> '$.recipeYield' AS VARCHAR[]), ', ') ELSE v ->> '$.recipeYield' END AS servings,
  v ->> '$.author.name' AS author, {MINUTES} AS total_minutes, {INGS} AS ingredients, {STEPS} AS steps,
  array_to_string(list_filter(['dinner', 'quick', 'thai', 'spicy noodles'], lambda t: true), '|') AS tags,
  coalesce(CASE json_type(v, '$.image') WHEN 'VARCHAR' THEN v ->> '$.image' WHEN 'ARRAY' THEN v ->> '$.image[0].url' END,
    'https://i.example.com/' || CAST(page_id AS VARCHAR) || '.jpg') AS image_url, 0.95::DOUBLE AS confidence
FROM r WHERE {HAS_TITLE}"""


@query("t7_json_ld_nodes", f"""WITH RECURSIVE {NODES}
SELECT page_id, array_to_string(path, '.') AS path, coalesce(v ->> '$.name', '') AS name FROM nodes""")
def _(src):
    rows = S.with_nodes(src("ld_pages_v")).select(
        "page_id", F.explode_outer("nodes").alias("n")).where(F.col("n").isNotNull())
    path = F.array_join(F.transform("n.path", lambda p: p.cast("string")), ".")
    return rows.select("page_id", path.alias("path"), F.coalesce(
        F.try_variant_get("n.node", "$.name", "string"), F.lit("")).alias("name"))


@query("t8_recipe_node", f"""WITH RECURSIVE {NODES}, {FIRST}
SELECT page_id, coalesce(v ->> '$.name', '') AS name FROM r""")
def _(src):
    found = S.with_recipe_node(src("ld_pages_v")).where(F.col("node").isNotNull())
    return found.select("page_id", F.coalesce(
        F.try_variant_get("node", "$.name", "string"), F.lit("")).alias("name"))


@query("t9_node_texts", f"""WITH RECURSIVE {NODES}, {FIRST}
SELECT page_id, {TEXT('$.name')} AS title, v ->> '$.author.name' AS author,
  CASE WHEN json_type(v, '$.recipeYield') = 'ARRAY' THEN array_to_string(CAST(v -> '$.recipeYield' AS VARCHAR[]), ', ') ELSE v ->> '$.recipeYield' END AS servings FROM r""")
def _(src):
    found = S.with_recipe_node(src("ld_pages_v")).where(F.col("node").isNotNull())
    fields = ", ".join(J.field("node", k) for k in ("name", "author", "recipeYield"))
    texts = F.transform(F.col("f"), lambda p: F.nullif(F.array_join(J.clean_texts(p), ", "), F.lit("")))
    return found.select("page_id", J.unwrapped(F.expr(f"array({fields})"), J.TEXT_KEYS).alias("f")).select(
        "page_id", texts.alias("t")).select(
        "page_id", F.get("t", F.lit(0)).alias("title"), F.get("t", F.lit(1)).alias("author"),
        F.get("t", F.lit(2)).alias("servings"))


@query("t9_deep_texts", """
SELECT id AS page_id, title || ' {[&' AS title, title || ', 7, u' || CAST(id % 50 AS VARCHAR) AS author,
  'https://i.example.com/' || CAST(id AS VARCHAR) || '.jpg' AS image_url, '2;cups;flour;' AS ingredients,
  'Stir well.' AS steps, 'thai|soup' AS tags FROM @recipes_v""")
def _(src):
    r = S.extract_recipes(src("deep_pages_v"))
    line = lambda i: F.concat_ws(";", *[F.coalesce(i[f], F.lit("")) for f in ("quantity", "unit", "item", "note")])
    return r.select(
        "page_id", "title", "author", "image_url", F.array_join(F.transform("ingredients", line), "|").alias("ingredients"),
        F.array_join("steps", "|").alias("steps"), F.array_join("tags", "|").alias("tags"))


@query("t10_durations", r"""
SELECT id, CASE WHEN m > 0 THEN CAST(floor(m + 0.5) AS INTEGER) END AS minutes FROM (SELECT o_orderkey AS id,
  CASE o_orderkey % 6 WHEN 0 THEN o_custkey % 9 * 60 + o_custkey % 50 WHEN 1 THEN 1440.0 WHEN 2 THEN o_custkey % 4 + 0.5 WHEN 3 THEN NULL WHEN 4 THEN 0
  ELSE o_custkey % 7 * 1440 + 45 END AS m FROM orders) x""")
def _(src):
    c = F.col("o_custkey")
    n = lambda k: (c % k).cast("string")
    k = F.col("o_orderkey") % 6
    text = (F.when(k == 0, F.concat(F.lit("PT"), n(9), F.lit("H"), n(50), F.lit("M")))
            .when(k == 1, F.lit("p1d")).when(k == 2, F.concat(F.lit(" PT"), n(4), F.lit("M30S ")))
            .when(k == 3, F.lit("soon")).when(k == 4, F.lit("PT0M"))
            .otherwise(F.concat(F.lit("P"), n(7), F.lit("DT0H45M"))))
    return src("orders").select(F.col("o_orderkey").alias("id"), J.duration_minutes(text).alias("minutes"))


@query("t11_images", f"""WITH RECURSIVE {NODES}, {FIRST}
SELECT page_id, CASE json_type(v, '$.image') WHEN 'VARCHAR' THEN v ->> '$.image' WHEN 'ARRAY' THEN v ->> '$.image[0].url' END AS image_url FROM r""")
def _(src):
    found = S.with_recipe_node(src("ld_pages_v")).where(F.col("node").isNotNull())
    images = F.flatten(J.unwrapped(F.expr(f"array({J.field('node', 'image')})"), J.IMAGE_KEYS))
    return found.select("page_id", F.get(images, F.lit(0)).alias("image_url"))


@query("t12_instruction_steps", f"WITH RECURSIVE {NODES}, {FIRST} SELECT page_id, {STEPS} AS steps FROM r")
def _(src):
    found = S.with_recipe_node(src("ld_pages_v")).where(F.col("node").isNotNull())
    stepped = S.instruction_steps(found, J.field("node", "recipeInstructions"))
    return stepped.select("page_id", F.array_join("steps", "|").alias("steps"))


@query("t14_recipe_tags", f"""WITH RECURSIVE {NODES}, {FIRST}, k AS (SELECT page_id, string_split(v ->> '$.recipeCategory', ',') ||
  CAST(v -> '$.recipeCuisine' AS VARCHAR[]) || string_split(v ->> '$.keywords', ',') AS raw FROM r),
t AS (SELECT page_id, list_filter(list_transform(raw, lambda s: lower(trim(s))), lambda s: length(s) BETWEEN 2 AND 29) AS l FROM k)
SELECT page_id, array_to_string(list_filter(l, lambda s, i: list_position(l, s) = i)[1:8], '|') AS tags FROM t""")
def _(src):
    found = S.with_recipe_node(src("ld_pages_v")).where(F.col("node").isNotNull())
    return found.select("page_id", F.array_join(
        S.recipe_tags(J.clean_texts(S.tag_leaves("node"))), "|").alias("tags"))


@query("t15_structured_recipes", f"WITH RECURSIVE {NODES}, {FIRST} {EXTRACTED}")
def _(src):
    r = S.extract_recipes(src("ld_pages_v"))
    line = lambda i: F.concat_ws(";", *[F.coalesce(i[f], F.lit("")) for f in ("quantity", "unit", "item", "note")])
    return r.select(
        "page_id", "title", "servings", "author", "total_minutes",
        F.array_join(F.transform("ingredients", line), "|").alias("ingredients"),
        F.array_join("steps", "|").alias("steps"), F.array_join("tags", "|").alias("tags"),
        "image_url", "confidence")
