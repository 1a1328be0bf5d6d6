"""Catalog queries: search, filters, joins, orders, pages, set operations, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators import catalog as C
from larder.operators import changes as M
from larder.operators.keyed import latest_per_key, newest_n_per_key
from larder.plans import duck as D
from larder.plans.registry import query
from larder.sources import sinks
from larder.sources.tables import decode_nested


def recipes(src):
    return decode_nested(src("recipes_v"))


JSON_ING = """from_json(CASE WHEN json_valid(ingredients) AND ingredients <> 'null' THEN ingredients ELSE '[]' END,
  '[{"quantity":"VARCHAR","unit":"VARCHAR","item":"VARCHAR","note":"VARCHAR"}]')"""
JSON_LIST = """from_json(CASE WHEN json_valid({c}) THEN {c} ELSE '[]' END, '["VARCHAR"]')"""
DECODED = f"""r AS (SELECT * EXCLUDE (ingredients, tags, steps), {JSON_ING} AS ing,
  {JSON_LIST.format(c='tags')} AS tags, {JSON_LIST.format(c='steps')} AS steps FROM @recipes_v)"""


def found(needle: str) -> str:
    return (f"(contains(lower(title), '{needle}') OR contains(lower(coalesce(description, '')), '{needle}') "
            f"OR len(list_filter(tags, lambda t: contains(lower(t), '{needle}'))) > 0 "
            f"OR len(list_filter(ing, lambda i: contains(lower(i.item), '{needle}'))) > 0)")


@query("s1_decoded_recipes", f"""WITH {DECODED}
SELECT id, CAST(len(ing) AS INTEGER) AS n_ingredients, array_to_string(list_transform(ing, lambda i: i.item), '|') AS items,
  array_to_string(tags, '|') AS tags, CAST(len(steps) AS INTEGER) AS n_steps,
  CAST(json_extract(extraction, '$.confidence') AS DOUBLE) AS confidence FROM r""")
def _(src):
    return recipes(src).select(
        "id", F.size("ingredients").alias("n_ingredients"),
        F.array_join("ingredients.item", "|").alias("items"), F.array_join("tags", "|").alias("tags"),
        F.size("steps").alias("n_steps"), F.col("extraction.confidence").alias("confidence"))


@query("f1_search_shrimp", f"WITH {DECODED} SELECT id, title FROM r WHERE {found('shrimp')}")
def _(src):
    return C.search(recipes(src), "  SHRIMP ").select("id", "title")


@query("f1_search_literal_percent", f"WITH {DECODED} SELECT id FROM r WHERE {found('100%')}")
def _(src):
    return C.search(recipes(src), "100%").select("id")


@query("f2_tag_filter", f"WITH {DECODED} SELECT id, array_to_string(tags, '|') AS tags FROM r "
       "WHERE len(list_filter(tags, lambda t: lower(t) = 'veg')) > 0")
def _(src):
    return C.with_tag(recipes(src), "VEG").select("id", F.array_join("tags", "|").alias("tags"))


@query("f3_favourites", "SELECT id FROM @recipes_v WHERE favorite")
def _(src):
    return C.favourites(src("recipes_v"), "1").select("id")


@query("f3_not_favourites", "SELECT id FROM @recipes_v WHERE NOT favorite")
def _(src):
    return C.favourites(src("recipes_v"), "false").select("id")


@query("f4_normalised_queries", f"SELECT conv_id, turn, {D.collapse(D.trim('text'))} AS q FROM conversations")
def _(src):
    return src("conversations").select("conv_id", "turn", T.clean_line(F.col("text")).alias("q"))


@query("f5_failed_jobs", "SELECT id, url FROM @jobs_v WHERE status = 'failed'")
def _(src):
    return C.jobs_by_status(src("jobs_v"), "failed").select("id", "url")


FOLDER_LISTS = """fl AS (SELECT id, CASE WHEN o_custkey % 4 = 0 THEN ['empty', 'gone'] ELSE ['Brand#1', 'x' || CAST(o_custkey AS VARCHAR), 'Brand#2'] END AS ids
  FROM (SELECT o_orderkey AS id, o_custkey FROM orders) o)"""


def folder_lists(src):
    """Every recipe with the folder ids it was loaded with, some of them stale."""
    stale = F.array(F.lit("Brand#1"), F.concat(F.lit("x"), F.col("o_custkey").cast("string")), F.lit("Brand#2"))
    return src("orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_custkey") % 4 == 0, F.array(F.lit("empty"), F.lit("gone"))).otherwise(stale).alias("ids"))


@query("f11_known_folder_ids", f"WITH {FOLDER_LISTS} " + """
SELECT id, coalesce(array_to_string(list_filter(ids, lambda x: x IN ('empty') OR x IN ('Brand#1', 'Brand#2')), '|'), '') AS ids FROM fl""")
def _(src):
    kept = C.keep_known(folder_lists(src), "ids", src("folders_v"))
    return kept.select("id", F.array_join("ids", "|").alias("ids"))


@query("j1_folder_ids", """
SELECT r.id, coalesce(string_agg(l.folder_id, '|' ORDER BY l.folder_id), '') AS folder_ids
FROM @recipes_v r LEFT JOIN @folder_links_v l ON l.recipe_id = r.id GROUP BY r.id""")
def _(src):
    return C.with_folder_ids(src("recipes_v").select("id"), src("folder_links_v")).select(
        "id", F.array_join("folder_ids", "|").alias("folder_ids"))


@query("j3_jobs_with_recipes", """
WITH f AS (SELECT recipe_id, string_agg(folder_id, '|' ORDER BY folder_id) AS folder_ids FROM @folder_links_v GROUP BY recipe_id)
SELECT j.id, j.status, j.recipe_id, r.title AS recipe_title, CASE WHEN r.id IS NOT NULL THEN coalesce(f.folder_ids, '') END AS folder_ids
FROM @jobs_v j LEFT JOIN @recipes_v r ON r.id = j.recipe_id LEFT JOIN f ON f.recipe_id = r.id""")
def _(src):
    jobs = C.jobs_with_recipes(src("jobs_v"), src("recipes_v"), src("folder_links_v"))
    return jobs.select("id", "status", "recipe_id", "recipe_title", F.array_join("folder_ids", "|").alias("folder_ids"))


@query("j4_job_read", """
SELECT j.id, j.status, r.title AS recipe_title FROM @jobs_v j LEFT JOIN @recipes_v r ON r.id = j.id % 1500 AND j.status = 'done'""")
def _(src):
    jobs = src("jobs_v").withColumn("recipe_id", F.col("id") % 1500)
    return C.job_read(jobs, src("recipes_v")).select("id", "status", "recipe_title")


@query("j5_in_folder", """
SELECT id, title FROM @recipes_v WHERE id IN (SELECT recipe_id FROM @folder_links_v WHERE folder_id = 'Brand#12')""")
def _(src):
    return C.in_folder(src("recipes_v"), src("folder_links_v"), "Brand#12").select("id", "title")


@query("j6_unfiled", "SELECT id, title FROM @recipes_v WHERE id NOT IN (SELECT recipe_id FROM @folder_links_v)")
def _(src):
    return C.in_folder(src("recipes_v"), src("folder_links_v"), "none").select("id", "title")


@query("j8_attach_open_job", """
WITH o AS (SELECT url, max_by(id, created_at) AS open_job_id FROM @jobs_v WHERE status IN ('pending', 'running') GROUP BY url)
SELECT l.id, o.open_job_id FROM @links_v l LEFT JOIN o ON o.url = l.url""")
def _(src):
    return C.attach_open_job(src("links_v"), src("jobs_v")).select("id", "open_job_id")


@query("j9_unknown_folder_ids", f"WITH {FOLDER_LISTS} " + """
SELECT id AS recipe_id, f AS folder_id, 'Unknown folder id(s): ' || f || '.' AS reason FROM (SELECT id, unnest(ids) AS f FROM fl) x
WHERE f NOT IN (SELECT id FROM @folders_v)""")
def _(src):
    asked = folder_lists(src).select(F.col("id").alias("recipe_id"), F.explode("ids").alias("folder_id"))
    known = src("folders_v").select(F.col("id").alias("folder_id"))
    return C.unknown_ids(asked, known, "folder_id")


@query("a1_folder_counts", """
SELECT f.id, f.name, count(l.recipe_id) AS recipe_count FROM @folders_v f LEFT JOIN @folder_links_v l ON l.folder_id = f.id GROUP BY f.id, f.name""")
def _(src):
    return C.folder_counts(src("folders_v").select("id", "name"), src("folder_links_v"))


@query("a2_queue_depth", "SELECT count(*) AS pending FROM @jobs_v WHERE status = 'pending'")
def _(src):
    return C.jobs_by_status(src("jobs_v"), "pending").agg(F.count("*").alias("pending"))


@query("a6_content_counts", f"""WITH {DECODED}
SELECT id, CAST(len(ing) AS INTEGER) AS ingredient_count, CAST(len(steps) AS INTEGER) AS step_count FROM r""")
def _(src):
    return C.content_counts(recipes(src))


SET_CHANGES = """sc AS (SELECT o_orderkey AS recipe_id, CASE o_orderkey % 3 WHEN 0 THEN ['Brand#1', 'Brand#2'] WHEN 1 THEN ['Brand#3'] ELSE ['empty', 'Brand#2'] END AS before,
  CASE o_orderkey % 5 WHEN 0 THEN ['Brand#2'] WHEN 1 THEN ['empty', 'empty'] WHEN 2 THEN ['Brand#1', 'Brand#4', 'Brand#1'] WHEN 3 THEN ['Brand#2', 'Brand#1'] ELSE ['Brand#3'] END AS after FROM orders)"""


def set_changes(src):
    """Folder sets of every recipe before and after an edit."""
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    k = F.col("o_orderkey")
    before = F.when(k % 3 == 0, lit("Brand#1", "Brand#2")).when(k % 3 == 1, lit("Brand#3")).otherwise(lit("empty", "Brand#2"))
    after = (F.when(k % 5 == 0, lit("Brand#2")).when(k % 5 == 1, lit("empty", "empty"))
             .when(k % 5 == 2, lit("Brand#1", "Brand#4", "Brand#1")).when(k % 5 == 3, lit("Brand#2", "Brand#1"))
             .otherwise(lit("Brand#3")))
    return src("orders").select(k.alias("recipe_id"), before.alias("before"), after.alias("after"))


@query("a8_folder_count_delta", f"WITH {SET_CHANGES}," + """
d AS (SELECT f AS id, sum(x) AS d FROM (SELECT unnest(list_filter(list_distinct(after), lambda v: NOT list_contains(before, v))) AS f, 1 AS x FROM sc
  UNION ALL SELECT unnest(list_filter(list_distinct(before), lambda v: NOT list_contains(after, v))), -1 FROM sc) y GROUP BY f),
c AS (SELECT f.id, count(l.recipe_id) AS n FROM @folders_v f LEFT JOIN @folder_links_v l ON l.folder_id = f.id GROUP BY f.id)
SELECT c.id, CAST(greatest(0, n + coalesce(d, 0)) AS BIGINT) AS recipe_count FROM c LEFT JOIN d ON d.id = c.id""")
def _(src):
    counted = C.folder_counts(src("folders_v").select("id"), src("folder_links_v"))
    return M.folder_count_delta(counted, set_changes(src))


@query("e1_replace_links", f"WITH {SET_CHANGES}," + """
n AS (SELECT recipe_id, after FROM sc WHERE recipe_id % 5 <> 4)
SELECT folder_id, recipe_id FROM @folder_links_v WHERE recipe_id NOT IN (SELECT recipe_id FROM n)
UNION SELECT unnest(after), recipe_id FROM n""")
def _(src):
    # Every fifth recipe was not edited and keeps its links.
    wanted = set_changes(src).where(F.col("recipe_id") % 5 != 4).select(
        "recipe_id", F.col("after").alias("folder_ids"))
    return M.replace_links(src("folder_links_v"), wanted)


@query("e2_set_difference", f"WITH {SET_CHANGES} " + """
SELECT recipe_id, coalesce(array_to_string(list_sort(list_filter(list_distinct(after), lambda v: NOT list_contains(before, v))), '|'), '') AS added,
  coalesce(array_to_string(list_sort(list_filter(list_distinct(before), lambda v: NOT list_contains(after, v))), '|'), '') AS removed FROM sc""")
def _(src):
    return set_changes(src).select(
        "recipe_id", F.array_join(F.array_sort(F.array_except("after", "before")), "|").alias("added"),
        F.array_join(F.array_sort(F.array_except("before", "after")), "|").alias("removed"))


@query("e3_same_set", f"WITH {SET_CHANGES} SELECT recipe_id, list_sort(list_distinct(before)) = list_sort(list_distinct(after)) AS same FROM sc")
def _(src):
    same = F.array_sort(F.array_distinct("before")) == F.array_sort(F.array_distinct("after"))
    return set_changes(src).select("recipe_id", same.alias("same"))


@query("e4_toggle_folder", f"WITH {SET_CHANGES} " + """
SELECT recipe_id, coalesce(array_to_string(CASE WHEN list_contains(before, 'Brand#2') THEN list_filter(before, lambda v: v <> 'Brand#2')
  ELSE list_append(before, 'Brand#2') END, '|'), '') AS ids FROM sc""")
def _(src):
    toggled = F.when(F.array_contains("before", "Brand#2"), F.array_remove("before", "Brand#2")).otherwise(
        F.array_append("before", F.lit("Brand#2")))
    return set_changes(src).select("recipe_id", F.array_join(toggled, "|").alias("ids"))


@query("e5_overlay", """
SELECT id, CASE WHEN id % 2 = 0 THEN CASE WHEN id % 4 = 0 THEN NULL ELSE 'new ' || platform END ELSE platform END AS author,
  CASE WHEN id % 3 = 0 THEN 90 ELSE duration_seconds END AS duration_seconds,
  'tier1:' || platform || CASE WHEN id % 5 = 0 THEN '' ELSE '|tier2:audio:m1' END AS tiers FROM @gathered_v""")
def _(src):
    g = src("gathered_v")
    base = g.select("id", F.col("platform").alias("author"), "duration_seconds",
                    F.array(F.concat(F.lit("tier1:"), F.col("platform"))).alias("tiers"))
    k = F.col("id")
    part = g.select(
        "id", F.when(k % 4 != 0, F.concat(F.lit("new "), F.col("platform"))).alias("author"),
        (k % 2 == 0).alias("has_author"), F.lit(90).alias("duration_seconds"),
        (k % 3 == 0).alias("has_duration_seconds"),
        F.when(k % 5 != 0, F.array(F.lit("tier2:audio:m1"))).alias("tiers"))
    out = M.overlay(base, part, "id", ["author", "duration_seconds"])
    return out.withColumn("tiers", F.array_join("tiers", "|"))


ORDER_SQL = {"recent": "created_at DESC, id DESC", "title": "title ASC, id ASC",
             "cooked": "cooked_count DESC, last_cooked_at DESC NULLS LAST, id DESC"}


def _top(sort):
    @query(f"o_order_{sort}", f"""SELECT id, title, row_number() OVER (ORDER BY {ORDER_SQL[sort]}) AS place
FROM @recipes_v""")
    def _(src):
        from larder.operators.ordered import numbered

        order = C.sort_columns(sort)
        recipes = src("recipes_v").select("id", "title", "cooked_count", "last_cooked_at", "created_at")
        return numbered(recipes, order, "place").select("id", "title", "place")


for _sort in ORDER_SQL:
    _top(_sort)


@query("o5_folder_order", "SELECT id, name FROM @folders_v ORDER BY name")
def _(src):
    return C.folder_order(src("folders_v").select("id", "name"))


@query("o6_recent_jobs", "SELECT id, status FROM @jobs_v ORDER BY created_at DESC, id DESC LIMIT 20")
def _(src):
    return C.recent_jobs(src("jobs_v")).select("id", "status")


@query("o7_largest_page", "SELECT id FROM @recipes_v ORDER BY created_at DESC, id DESC LIMIT 200")
def _(src):
    return C.page(src("recipes_v"), "recent", "999").select("id")


def _paged(sort):
    second = f"SELECT id, row_number() OVER (ORDER BY {ORDER_SQL[sort]}) AS n FROM @recipes_v"

    @query(f"o8_second_page_{sort}", f"""WITH n AS ({second})
SELECT id, (SELECT id FROM n WHERE n = 100) AS next_cursor FROM n WHERE n BETWEEN 51 AND 100""")
    def _(src):
        rows = src("recipes_v")
        cursor = C.page(rows, sort, 50).select("next_cursor").first()[0]
        return C.page(rows, sort, 50, cursor).select("id", "next_cursor")


for _sort in ORDER_SQL:
    _paged(_sort)


@query("o9_newest_five", "SELECT id, title FROM @recipes_v ORDER BY created_at DESC, id DESC LIMIT 5")
def _(src):
    return C.top(src("recipes_v"), "recent", 5).select("id", "title")


@query("o9_find_five", f"WITH {DECODED} SELECT id, title FROM r WHERE {found('olive')} ORDER BY created_at DESC, id DESC LIMIT 5")
def _(src):
    return C.top(C.search(recipes(src), "olive"), "recent", 5).select("id", "title")


@query("w6_latest_job_per_url", "SELECT url, max_by(id, created_at) AS id, max_by(status, created_at) AS status FROM @jobs_v GROUP BY url")
def _(src):
    return latest_per_key(src("jobs_v").select("url", "id", "status", "created_at"), ["url"],
                          [F.col("created_at"), F.col("id")]).drop("created_at")


@query("w3_recent_per_owner", """
WITH l AS (SELECT owner, recipe_id AS k, max(created_at) AS touched FROM @jobs_v WHERE recipe_id IS NOT NULL GROUP BY owner, recipe_id)
SELECT owner, k, touched FROM l QUALIFY row_number() OVER (PARTITION BY owner ORDER BY touched DESC) <= 200""")
def _(src):
    touched = src("jobs_v").where(F.col("recipe_id").isNotNull()).groupBy(
        "owner", F.col("recipe_id").alias("k")).agg(F.max("created_at").alias("touched"))
    return newest_n_per_key(touched, ["owner"], [F.desc("touched")], 200)


@query("v4_name_conflicts", """
WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN ' ' || p_name ELSE 'Empty' END AS name FROM part),
k AS (SELECT *, lower(trim(name)) AS f, min(id) OVER (PARTITION BY lower(trim(name))) AS first FROM n)
SELECT id, name, f IN (SELECT lower(trim(name)) FROM @folders_v) OR id <> first AS conflict FROM k""")
def _(src):
    k = F.col("p_partkey")
    new = src("part").select(k.alias("id"), F.when(k % 3 == 0, F.upper("p_brand")).when(
        k % 3 == 1, F.concat(F.lit(" "), F.col("p_name"))).otherwise(F.lit("Empty")).alias("name"))
    return M.name_conflicts(new, src("folders_v"))


@query("v5_folder_names", f"""SELECT conv_id, turn, nullif(substr({D.collapse(D.trim('text'))}, 1, 40), '') AS name FROM conversations""")
def _(src):
    return C.clean_names(src("conversations").select("conv_id", "turn", F.col("text").alias("name")))


@query("v5_folder_emoji", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '🍰' WHEN 1 THEN '👩‍🍳' WHEN 2 THEN substr(p_name, 1, 1) END AS glyph FROM part""")
def _(src):
    k = F.col("p_partkey")
    typed = F.when(k % 4 == 0, F.lit(" 🍰🍰")).when(k % 4 == 1, F.lit("👩‍🍳 cook")).when(
        k % 4 == 2, F.col("p_name")).otherwise(F.lit("  "))
    return src("part").select("p_partkey", T.first_glyph(typed).alias("glyph"))


NEW_GROCERY = "n AS (SELECT id, 'new ' || text AS text, NOT checked AS checked FROM @grocery_v WHERE line_no = 2)"


@query("m3_upsert", f"""WITH {NEW_GROCERY}, a AS (SELECT id, text, checked FROM n UNION ALL
  SELECT id || '-x', text, checked FROM n)
SELECT id, text, checked FROM a UNION ALL SELECT id, text, checked FROM @grocery_v WHERE id NOT IN (SELECT id FROM a)""")
def _(src):
    base = src("grocery_v").select("id", "text", "checked", "line_no")
    edited = base.where(F.col("line_no") == 2).select(
        "id", F.concat(F.lit("new "), F.col("text")).alias("text"), (~F.col("checked")).alias("checked"))
    added = edited.withColumn("id", F.concat("id", F.lit("-x")))
    return M.upsert(base.drop("line_no"), edited.unionByName(added))


def deleted(src):
    """Recipes of cancelled orders, the ones being removed."""
    return src("orders").where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("recipe_id"))


GONE = "gone AS (SELECT o_orderkey AS recipe_id FROM orders WHERE o_orderstatus = 'P')"


@query("m5_cascade_links", f"WITH {GONE} SELECT folder_id, recipe_id FROM @folder_links_v WHERE recipe_id NOT IN (SELECT recipe_id FROM gone)")
def _(src):
    return M.cascade_delete(src("folder_links_v"), deleted(src))


@query("m6_null_deleted", f"WITH {GONE} SELECT id, text, CASE WHEN recipe_id IN (SELECT recipe_id FROM gone) THEN NULL ELSE recipe_id END AS recipe_id FROM @grocery_v")
def _(src):
    return M.null_deleted(src("grocery_v").select("id", "text", "recipe_id"), deleted(src))


@query("m8_set_checked", "SELECT id, checked OR line_no = 3 AS checked FROM @grocery_v")
def _(src):
    g = src("grocery_v")
    return M.set_flag(g.select("id", "checked"), g.where(F.col("line_no") == 3).select("id", F.lit(True).alias("checked")), "checked")


@query("m8_delete_by_id", "SELECT id, text FROM @grocery_v WHERE line_no <> 4")
def _(src):
    g = src("grocery_v")
    return M.delete_by_id(g.select("id", "text"), g.where(F.col("line_no") == 4).select("id"))


@query("s7_content_addressed", "SELECT substr(sha256(text), 1, 20) || '.txt' AS name, count(*) AS copies FROM documents GROUP BY text")
def _(src):
    return sinks.content_addressed(src("documents"), "text", ".txt").select("name", "copies")
