"""Quantity arithmetic and shopping-list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import ingredients as I
from larder.functions import quantity as Q
from larder.functions import text as T
from larder.operators import shopping as S
from larder.plans import duck as D
from larder.plans.adapters import LINE_ORDER, LIST_ORDER
from larder.plans.registry import query

LINE_ID = "recipe_id, line_no, part_id, supp_id, price"
ID_COLS = LINE_ID.split(", ")


@query("q1_parse_quantity", f"SELECT {LINE_ID}, {D.parse_qty('quantity')} AS amount FROM @lines_v")
def _(src):
    return src("lines_v").select(*ID_COLS, Q.parse_quantity(F.col("quantity")).alias("amount"))


@query("q2_format_quantity", f"""
SELECT {LINE_ID}, {D.format_qty('a * 1.0 / 7')} AS sevenths, {D.format_qty('a * 2.5')} AS scaled
FROM (SELECT *, {D.parse_qty('quantity')} AS a FROM @lines_v) x""")
def _(src):
    a = Q.parse_quantity(F.col("quantity"))
    return src("lines_v").withColumn("a", a).select(
        *ID_COLS, Q.format_quantity(F.col("a") * F.lit(1.0) / 7).alias("sevenths"),
        Q.format_quantity(F.col("a") * F.lit(2.5)).alias("scaled"))


ING = """unnest(from_json(CASE WHEN json_valid(ingredients) AND ingredients <> 'null' THEN ingredients ELSE '[]' END,
  '[{"quantity":"VARCHAR","unit":"VARCHAR","item":"VARCHAR","note":"VARCHAR"}]'))"""
ING_ROWS = f"""i AS (SELECT id, s.n - 1 AS pos, l[s.n] AS g FROM (SELECT id, from_json(CASE WHEN json_valid(ingredients)
  AND ingredients <> 'null' THEN ingredients ELSE '[]' END, '[{{"quantity":"VARCHAR","unit":"VARCHAR","item":"VARCHAR","note":"VARCHAR"}}]') AS l
  FROM @recipes_v) r, LATERAL (SELECT unnest(generate_series(1, len(l))) AS n) s)"""
LINE = (f"{D.trim(D.collapse(chr(40) + 'concat_ws(' + repr(' ') + ', nullif(trim(g.quantity), ' + repr('') + '), nullif(trim(g.unit), ' + repr('') + '), nullif(trim(g.item), ' + repr('') + '))' + chr(41)))}")
SCALED = f"""sc AS (SELECT id, pos, g.unit AS unit, g.item AS item, g.note AS note, CASE WHEN {D.parse_qty('g.quantity')} IS NULL
  THEN g.quantity ELSE {D.format_qty(D.parse_qty('g.quantity') + ' * 1.5')} END AS quantity FROM i)"""


@query("q3_scaled_ingredients", f"WITH {ING_ROWS}, {SCALED} SELECT id, CAST(pos AS INTEGER) AS pos, quantity, item FROM sc")
def _(src):
    from larder.sources.tables import decode_nested

    scaled = Q.scale_ingredients(F.col("ingredients"), 1.5)
    rows = decode_nested(src("recipes_v")).select("id", F.posexplode(scaled).alias("pos", "g"))
    return rows.select("id", "pos", "g.quantity", "g.item")


@query("q4_ingredient_lines", f"WITH {ING_ROWS} SELECT id, CAST(pos AS INTEGER) AS pos, {LINE} AS line, "
       f"{LINE} || CASE WHEN g.note IS NULL THEN '' ELSE ' (' || trim(g.note) || ')' END AS full_line FROM i")
def _(src):
    from larder.sources.tables import decode_nested

    rows = decode_nested(src("recipes_v")).select("id", F.posexplode("ingredients").alias("pos", "g"))
    return rows.select("id", "pos", Q.ingredient_line(F.col("g")).alias("line"),
                       Q.ingredient_line(F.col("g"), with_note=True).alias("full_line"))


@query("q5_merge_keys", f"WITH {ING_ROWS} SELECT id, CAST(pos AS INTEGER) AS pos, {D.merge_key('g.item')} AS key FROM i")
def _(src):
    from larder.sources.tables import decode_nested

    rows = decode_nested(src("recipes_v")).select("id", F.posexplode("ingredients").alias("pos", "g"))
    return rows.select("id", "pos", Q.merge_key(F.col("g.item")).alias("key"))


@query("q6_servings_count", r"""
SELECT id, CASE WHEN n > 0 AND n < 1000 THEN CAST(floor(n + 0.5) AS INTEGER) END AS servings_count
FROM (SELECT id, TRY_CAST(regexp_extract(servings, '(\d+(\.\d+)?)', 1) AS DOUBLE) AS n FROM @recipes_v) x""")
def _(src):
    return src("recipes_v").select("id", Q.servings_count(F.col("servings")).alias("servings_count"))


@query("q7_leading_quantity", f"SELECT id, {D.lead('text')} AS qty, {D.rest('text')} AS rest FROM @grocery_v")
def _(src):
    return src("grocery_v").select("id", Q.leading_quantity(F.col("text")).alias("qty"),
                                   Q.after_quantity(F.col("text")).alias("rest"))


@query("t13_parsed_lines", r"""
WITH l AS (SELECT id, text, regexp_extract(text, '^((?:\d+\s+\d+/\d+)|(?:\d+/\d+)|(?:\d+-\d+)|(?:\d+(?:[.,]\d+)?)|½)\s*', 1) AS qty,
  regexp_replace(text, '^((?:\d+\s+\d+/\d+)|(?:\d+/\d+)|(?:\d+-\d+)|(?:\d+(?:[.,]\d+)?)|½)\s*', '') AS r FROM @grocery_v),
u AS (SELECT *, CASE WHEN regexp_matches(r, '^(cup|tbsp) ') THEN regexp_extract(r, '^(cup|tbsp) ', 1) END AS unit FROM l)
SELECT id, nullif(qty, '') AS quantity, unit, regexp_replace(r, '^(cup|tbsp) ', '') AS item, CAST(NULL AS VARCHAR) AS note FROM u""")
def _(src):
    rows = src("grocery_v").select("id", I.parse_ingredient_line(F.col("text")).alias("p"))
    return rows.select("id", "p.quantity", "p.unit", "p.item", "p.note")


CONSOLIDATED = f"""
k AS (SELECT list_owner, recipe_id, line_no, part_id, supp_id, price, created_at,
  {D.trim(D.collapse("concat_ws(' ', quantity, unit, item)"))} AS text, {D.merge_key('item')} AS key FROM @lines_v),
q AS (SELECT *, {D.lead('text')} AS qty, {D.rest('text')} AS rest FROM k),
n AS (SELECT *, row_number() OVER w AS rn, first_value(qty) OVER w AS fq, first_value(rest) OVER w AS fr, first_value(text) OVER w AS ft
  FROM q WINDOW w AS (PARTITION BY list_owner, key ORDER BY created_at, recipe_id, line_no, part_id, supp_id, price)),
m AS (SELECT *, CASE WHEN rn = 1 THEN 'head' WHEN qty IS NOT NULL AND fq IS NOT NULL AND lower(rest) = lower(fr) THEN 'merge' ELSE 'own' END AS role FROM n),
g AS (SELECT list_owner, key, list(qty ORDER BY rn) FILTER (WHERE role = 'merge') AS adds, any_value(fq) AS fq, any_value(fr) AS fr,
  any_value(ft) AS ft, min(rn) AS rn FROM m WHERE role <> 'own' GROUP BY list_owner, key),
v AS (SELECT *, coalesce(len(adds), 0) AS merged, list_reduce(list_concat([fq], adds), lambda a, b: {D.snap('a + b')}) AS total FROM g)"""


@query("a5_shopping_list", f"""WITH {CONSOLIDATED}
SELECT v.list_owner, v.key, m.recipe_id, m.line_no, m.part_id, m.supp_id, m.price,
  CASE WHEN merged = 0 THEN v.ft ELSE trim({D.format_qty('total')} || ' ' || v.fr) END AS text, merged
FROM v JOIN m ON m.list_owner = v.list_owner AND m.key = v.key AND m.rn = 1
UNION ALL SELECT list_owner, key, recipe_id, line_no, part_id, supp_id, price, text, 0 FROM m WHERE role = 'own'""")
def _(src):
    return _consolidated(src).drop("created_at")


def _consolidated(src, chunks=None):
    line = F.struct("quantity", "unit", "item", "note")
    lines = src("lines_v").select(
        "list_owner", *LIST_ORDER, Q.ingredient_line(line).alias("text"),
        Q.merge_key(F.col("item")).alias("key"))
    return S.consolidate(lines, "list_owner", LIST_ORDER, chunks=chunks)


@query("a5_list_totals", f"""WITH {CONSOLIDATED}, o AS (SELECT list_owner, sum(merged) AS merged, count(*) AS owners FROM v GROUP BY list_owner),
p AS (SELECT list_owner, count(*) AS n FROM m WHERE role = 'own' GROUP BY list_owner)
SELECT o.list_owner, CAST(owners + coalesce(p.n, 0) AS BIGINT) AS added, CAST(merged AS BIGINT) AS merged
FROM o LEFT JOIN p ON p.list_owner = o.list_owner""")
def _(src):
    return _consolidated(src).groupBy("list_owner").agg(
        F.count("*").alias("added"), F.sum("merged").alias("merged"))


def _scaled(name, factor):
    """SQL: rendered, scaled ingredients with their owner, as CTE ``name``."""
    qty = D.parse_qty("g.quantity")
    # A recipe as it is keeps the spelling of its quantities.
    spelled = "g.quantity" if factor == 1 else f"CASE WHEN {qty} IS NULL THEN g.quantity ELSE {D.format_qty(qty + f' * {factor}')} END"
    return f"""{name}_q AS (SELECT i.id, pos, {{'quantity': {spelled},
  'unit': g.unit, 'item': g.item, 'note': g.note}} AS g, o.o_custkey AS owner, r.favorite AS checked, r.created_at
  FROM i JOIN @recipes_v r ON r.id = i.id JOIN orders o ON o.o_orderkey = i.id),
{name} AS (SELECT id, pos, owner, checked, created_at, {LINE} AS text, {D.merge_key('g.item')} AS key FROM {name}_q WHERE {LINE} <> '')"""


ADDED = f"""{ING_ROWS}, {_scaled('li', 1)}, {_scaled('ad', 1.5)},
op AS (SELECT *, id * 1000 + pos AS line_id, {D.merge_key('text')} AS norm FROM li WHERE NOT checked),
own AS (SELECT a.id, a.owner, a.key, max(a.pos) AS last FROM ad a WHERE a.key <> '' GROUP BY ALL),
mt AS (SELECT k.owner, k.key, op.line_id, op.text FROM (SELECT DISTINCT owner, key FROM own) k JOIN op ON op.owner = k.owner
  AND (op.norm = k.key OR ends_with(op.norm, ' ' || k.key))
  QUALIFY row_number() OVER (PARTITION BY k.owner, k.key ORDER BY op.created_at, op.id, op.pos) = 1),
sq AS (SELECT own.id, own.key, 0 AS kind, -1 AS pos, mt.text, mt.line_id, own.last FROM own JOIN mt ON mt.owner = own.owner AND mt.key = own.key
  UNION ALL SELECT id, key, 1, pos, text, NULL, NULL FROM ad),
qs AS (SELECT *, {D.lead('text')} AS qty, {D.rest('text')} AS rest FROM sq),
ns AS (SELECT *, row_number() OVER w AS rn, first_value(qty) OVER w AS fq, first_value(rest) OVER w AS fr
  FROM qs WINDOW w AS (PARTITION BY id, key ORDER BY kind, pos)),
ms AS (SELECT *, CASE WHEN key = '' THEN 'own' WHEN rn = 1 THEN 'head' WHEN qty IS NOT NULL AND fq IS NOT NULL AND lower(rest) = lower(fr) THEN 'merge' ELSE 'own' END AS role FROM ns),
gs AS (SELECT id, key, list(qty ORDER BY rn) FILTER (WHERE role = 'merge') AS adds, any_value(fq) AS fq, any_value(fr) AS fr FROM ms WHERE role <> 'own' GROUP BY id, key),
vs AS (SELECT *, coalesce(len(adds), 0) AS merged, list_reduce(list_concat([fq], adds), lambda a, b: {D.snap('a + b')}) AS total FROM gs),
hs AS (SELECT ms.*, vs.merged, CASE WHEN merged = 0 THEN text ELSE trim({D.format_qty('total')} || ' ' || vs.fr) END AS now FROM ms JOIN vs ON vs.id = ms.id AND vs.key = ms.key WHERE role = 'head'),
rs AS (SELECT id AS request, 'update' AS action, line_id, CAST(NULL AS INTEGER) AS pos, now AS text FROM hs WHERE kind = 0 AND merged > 0
    QUALIFY row_number() OVER (PARTITION BY id, line_id ORDER BY last DESC, key DESC) = 1
  UNION ALL SELECT id, 'create', NULL, CAST(pos AS INTEGER), now FROM hs WHERE kind = 1
  UNION ALL SELECT id, 'create', NULL, CAST(pos AS INTEGER), text FROM ms WHERE role = 'own')"""


def _added(src, add=S.add_recipes):
    from larder.sources.tables import decode_nested

    owners = src("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"))
    recipes = decode_nested(src("recipes_v")).join(owners, "id")
    listed = S.ingredient_rows(recipes, ["id", "owner", F.col("favorite").alias("checked"), "created_at"])
    listed = listed.withColumnRenamed("id", "recipe_id").withColumn("id", F.col("recipe_id") * 1000 + F.col("pos"))
    wanted = S.ingredient_rows(recipes, [F.col("id").alias("request"), "owner"], 1.5)
    return add(wanted, listed, "request", "owner", ["created_at", "recipe_id", "pos"])


@query("a5_add_recipe", f"WITH {ADDED} SELECT * FROM rs")
def _(src):
    return _added(src)


SERIES = f"""{ADDED.split('sq AS (')[0]}
sm AS (SELECT a.*, {D.merge_key('a.text')} AS norm, mt.line_id, mt.text AS line_text FROM ad a LEFT JOIN mt ON mt.owner = a.owner AND mt.key = a.key),
sf AS (SELECT * FROM sm WHERE key <> '' AND line_id IS NULL),
fm AS (SELECT k.owner, k.key, m.id AS rid, m.pos AS rpos FROM (SELECT DISTINCT owner, key FROM sf) k JOIN sf m ON m.owner = k.owner
  AND (m.norm = k.key OR ends_with(m.norm, ' ' || k.key)) QUALIFY row_number() OVER (PARTITION BY k.owner, k.key ORDER BY m.id, m.pos) = 1),
ow AS (SELECT owner, id, key, min(pos) AS kpos FROM sf GROUP BY ALL),
tg AS (SELECT sm.owner, sm.id, sm.pos, sm.text, sm.line_id, sm.line_text, CASE WHEN sm.key = '' THEN '' WHEN sm.line_id IS NOT NULL THEN 'L' || sm.line_id
  WHEN sm.id > fm.rid THEN 'M' || fm.rid || ':' || fm.rpos ELSE 'M' || sm.id || ':' || ow.kpos END AS target
  FROM sm LEFT JOIN fm ON fm.owner = sm.owner AND fm.key = sm.key LEFT JOIN ow ON ow.owner = sm.owner AND ow.id = sm.id AND ow.key = sm.key),
sq AS (SELECT DISTINCT owner, target, 0 AS kind, CAST(NULL AS BIGINT) AS id, -1 AS pos, line_text AS text, line_id FROM tg WHERE line_id IS NOT NULL
  UNION ALL SELECT owner, target, 1, id, pos, text, NULL FROM tg),
qs AS (SELECT *, {D.lead('text')} AS qty, {D.rest('text')} AS rest FROM sq),
ns AS (SELECT *, row_number() OVER w AS rn, first_value(qty) OVER w AS fq, first_value(rest) OVER w AS fr
  FROM qs WINDOW w AS (PARTITION BY owner, target ORDER BY kind, id, pos)),
ms AS (SELECT *, CASE WHEN target = '' THEN 'own' WHEN rn = 1 THEN 'head' WHEN qty IS NOT NULL AND fq IS NOT NULL AND lower(rest) = lower(fr) THEN 'merge' ELSE 'own' END AS role FROM ns),
gs AS (SELECT owner, target, list(qty ORDER BY rn) FILTER (WHERE role = 'merge') AS adds, any_value(fq) AS fq, any_value(fr) AS fr FROM ms WHERE role <> 'own' GROUP BY owner, target),
vs AS (SELECT *, coalesce(len(adds), 0) AS merged, list_reduce(list_concat([fq], adds), lambda a, b: {D.snap('a + b')}) AS total FROM gs),
hs AS (SELECT ms.*, vs.merged, CASE WHEN merged = 0 THEN text ELSE trim({D.format_qty('total')} || ' ' || vs.fr) END AS now FROM ms JOIN vs ON vs.owner = ms.owner AND vs.target = ms.target WHERE role = 'head')
SELECT owner, 'update' AS action, line_id, CAST(NULL AS BIGINT) AS request, CAST(NULL AS INTEGER) AS pos, now AS text FROM hs WHERE kind = 0 AND merged > 0
UNION ALL SELECT owner, 'create', NULL, id, CAST(pos AS INTEGER), now FROM hs WHERE kind = 1
UNION ALL SELECT owner, 'create', NULL, id, CAST(pos AS INTEGER), text FROM ms WHERE role = 'own'"""


@query("a5_add_recipe_series", f"WITH {SERIES}")
def _(src):
    return _added(src, S.add_recipe_series)


@query("a5_added_counts", f"""WITH {ADDED} SELECT request, count(*) FILTER (WHERE action = 'create') AS added,
  count(*) FILTER (WHERE action = 'update') AS updated FROM rs GROUP BY request""")
def _(src):
    return _added(src).groupBy("request").agg(
        F.count_if(F.col("action") == "create").alias("added"), F.count_if(F.col("action") == "update").alias("updated"))


@query("j10_open_line_owners", f"""
WITH g AS (SELECT *, {D.merge_key('text')} AS norm FROM @grocery_v WHERE NOT checked),
k AS (SELECT DISTINCT list_owner, {D.merge_key('item')} AS key FROM @lines_v)
SELECT k.list_owner, k.key, g.id AS line_id, g.text AS line_text FROM k JOIN g ON g.list_owner = k.list_owner
  AND k.key <> '' AND (g.norm = k.key OR ends_with(g.norm, ' ' || k.key))
QUALIFY row_number() OVER (PARTITION BY k.list_owner, k.key ORDER BY g.created_at, g.recipe_id, g.line_no, g.part_id, g.supp_id, g.price) = 1""")
def _(src):
    keys = src("lines_v").select("list_owner", Q.merge_key(F.col("item")).alias("key"))
    return S.match_open_lines(src("grocery_v"), keys, "list_owner", LIST_ORDER)


def _titled(src):
    titles = src("recipes_v").select(F.col("id").alias("recipe_id"), F.col("title").alias("recipe_title"))
    return src("grocery_v").join(titles, "recipe_id", "left")


@query("w1_source_labels", """
WITH t AS (SELECT g.*, coalesce('from ' || r.title, '') AS label FROM @grocery_v g LEFT JOIN @recipes_v r ON r.id = g.recipe_id),
l AS (SELECT *, lag(label) OVER (PARTITION BY list_owner ORDER BY created_at, recipe_id, line_no, part_id, supp_id, price) AS before FROM t)
SELECT id, list_owner, CASE WHEN before = label THEN '' ELSE label END AS source_label FROM l""")
def _(src):
    lines = _titled(src).select("id", "list_owner", "recipe_title", *LIST_ORDER)
    return S.source_labels(lines, "list_owner", LIST_ORDER).select(
        "id", "list_owner", "source_label")


@query("j2_grocery_titles", """
SELECT g.id, g.text, g.checked, g.recipe_id, r.title AS recipe_title FROM @grocery_v g LEFT JOIN @recipes_v r ON r.id = g.recipe_id""")
def _(src):
    return _titled(src).select("id", "text", "checked", "recipe_id", "recipe_title")


@query("o4_list_order", """
SELECT list_owner, id, checked, row_number() OVER (ORDER BY checked, created_at, recipe_id, line_no, part_id, supp_id, price) AS place
FROM @grocery_v""")
def _(src):
    from larder.operators.ordered import numbered

    lines = src("grocery_v").select("list_owner", "id", "checked", *LIST_ORDER)
    return numbered(lines, S.list_order(*LIST_ORDER), "place").drop(*LIST_ORDER)


@query("a3_list_progress", """
SELECT list_owner, count(*) FILTER (WHERE checked) AS checked_count, count(*) AS total,
  CAST(count(*) FILTER (WHERE checked) AS VARCHAR) || ' of ' || CAST(count(*) AS VARCHAR) || ' in the basket' AS progress
FROM @grocery_v GROUP BY list_owner""")
def _(src):
    return S.progress(src("grocery_v"), "list_owner")


@query("f6_open_lines", "SELECT id, text FROM @grocery_v WHERE NOT checked")
def _(src):
    return S.split_by_checked(src("grocery_v"))[0].select("id", "text")


@query("f6_checked_lines", "SELECT id, text FROM @grocery_v WHERE checked")
def _(src):
    return S.split_by_checked(src("grocery_v"))[1].select("id", "text")


@query("m7_clear_checked", "SELECT id, text, recipe_id FROM @grocery_v WHERE NOT checked")
def _(src):
    return S.clear_checked(src("grocery_v"), True).select("id", "text", "recipe_id")


@query("a7_cleared_count", "SELECT count(*) AS deleted FROM @grocery_v WHERE checked")
def _(src):
    return src("grocery_v").agg(F.count_if("checked").alias("deleted"))


@query("v6_clean_items", f"""SELECT * FROM (SELECT conv_id, turn, {D.collapse(D.trim('text'))} AS text FROM conversations) c
 WHERE text <> ''""")
def _(src):
    return S.clean_items(src("conversations").select("conv_id", "turn", "text"))


@query("t16_step_lists", r"""
SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda l: """ + D.trim(
    r"regexp_replace(l, '^\s*(?:\d+[.)]\s*|[-*•]\s*)', '')") + r"""), lambda l: l <> ''), '|') AS steps FROM documents""")
def _(src):
    return src("documents").select("doc_id", F.array_join(T.step_list(F.col("text")), "|").alias("steps"))


@query("w7_tag_lists", """
WITH p AS (SELECT o_orderkey, list_filter(list_transform(string_split(tags, ','), lambda t: trim(t)), lambda t: t <> '') AS l FROM
  (SELECT o_orderkey, o_orderpriority || ', ' || lower(o_orderpriority) || ' , Taco,' || o_orderstatus || ',, taco' AS tags FROM orders) o)
SELECT o_orderkey, array_to_string(list_filter(l, lambda t, i: list_position(list_transform(l, lambda x: lower(x)), lower(t)) = i), '|') AS tags FROM p""")
def _(src):
    text = F.concat("o_orderpriority", F.lit(", "), F.lower("o_orderpriority"), F.lit(" , Taco,"),
                    "o_orderstatus", F.lit(",, taco"))
    return src("orders").select("o_orderkey", F.array_join(T.tag_list(text), "|").alias("tags"))
