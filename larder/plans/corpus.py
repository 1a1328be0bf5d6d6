"""Corpus, routing and schema-enforcement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import html as H
from larder.functions import scoring as S
from larder.functions import text as T
from larder.operators import changes as M
from larder.operators import corpus as C
from larder.operators import links as L
from larder.operators import validate as V
from larder.plans import duck as D
from larder.plans.registry import query
from larder.sources import tables as R

CLEAN = D.clean_for_score("text")
SCORED = lambda src, key: f"""c AS (SELECT *, {CLEAN} AS _c FROM {src}),
s AS (SELECT * EXCLUDE (_c), {D.score_of_clean('_c')} AS raw FROM c)"""  # noqa: E731


@query("flagship_page_catalog", f"""WITH {D.identity_key('pages', 'url', 'identity_key')},
w AS (SELECT * FROM u_key QUALIFY row_number() OVER (PARTITION BY identity_key ORDER BY page_id) = 1),
b AS (SELECT page_id, identity_key, {D.title('html')} AS title, {D.html_text('html')} AS text FROM w), {SCORED('b', 'page_id')}
SELECT page_id, identity_key, regexp_extract(identity_key, '^https?://([^/?]*)', 1) AS host, title, length(text) AS text_length,
  floor(raw * 100 + 0.5) / 100 AS score, raw >= 4.0::DOUBLE AS is_recipe FROM s""")
def _(src):
    keyed = L.with_identity_key(src("pages"))
    unique = L.unique_by_identity(keyed, "identity_key", "page_id")
    texts = C.page_texts(unique).withColumnRenamed("body", "text").drop("html", "url")
    return C.scored(texts).select(
        "page_id", "identity_key", F.regexp_extract("identity_key", r"^https?://([^/?]*)", 1).alias("host"),
        "title", F.char_length("text").cast("long").alias("text_length"), "score", "is_recipe")


@query("s2_page_scan", "SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS html_bytes, "
       "octet_length(encode(html)) > 3145728 AS over_cap, md5(html) AS content FROM pages")
def _(src):
    rows = R.scan_pages(src("pages"), 3 * 1024 * 1024)
    return rows.select("page_id", "html_bytes", "over_cap", F.md5("html").alias("content"))


@query("t1_normalised_documents", f"SELECT doc_id, {D.normalise('text')} AS text FROM documents")
def _(src):
    return src("documents").select("doc_id", T.normalise_text(F.col("text")).alias("text"))


@query("t2_decoded_pages", f"SELECT page_id, md5({D.decode('html')}) AS digest, length({D.decode('html')}) AS n FROM pages")
def _(src):
    rows = src("pages").select("page_id", H.decode_entities(F.col("html")).alias("t"))
    return rows.select("page_id", F.md5("t").alias("digest"), F.char_length("t").cast("long").alias("n"))


@query("t3_without_non_text", f"SELECT page_id, {D.drop_non_text('html')} AS html FROM pages")
def _(src):
    return src("pages").select("page_id", H.drop_non_text(F.col("html")).alias("html"))


@query("t4_html_to_text", f"SELECT page_id, {D.html_text('html')} AS text FROM pages")
def _(src):
    return src("pages").select("page_id", H.html_to_text(F.col("html")).alias("text"))


@query("t5_page_metadata", f"""SELECT page_id, {D.title('html')} AS title, 'https://i.example.com/' || CAST(page_id AS VARCHAR) || '.jpg' AS image FROM @ld_pages_v
UNION ALL SELECT -1 - page_id, {D.title('html')}, CAST(NULL AS VARCHAR) FROM pages""")
def _(src):
    meta = lambda df, k: df.select(k.alias("page_id"), H.page_title(F.col("html")).alias("title"),
                                   H.meta_content(F.col("html"), "og:image").alias("image"))
    return meta(src("ld_pages_v"), F.col("page_id")).unionByName(
        meta(src("pages"), -1 - F.col("page_id")))


WEB = f"w AS (SELECT page_id, {D.normalise('coalesce(' + D.title('html') + ', chr(32)) || chr(10) || chr(10) || ' + D.html_text('html'))} AS text FROM pages)"


@query("t6_web_texts", f"WITH {WEB} SELECT page_id, text, 'tier1:web-text' AS tier FROM w WHERE length(text) >= 80")
def _(src):
    return C.web_texts(src("pages").drop("url"))[0].select("page_id", "text", "tier")


LD_WEB = WEB.replace("FROM pages", "FROM @ld_pages_v")


@query("f8_too_little_text", f"WITH {LD_WEB} SELECT page_id, length(text) AS n, 'no readable text' AS reason FROM w WHERE length(text) < 80")
def _(src):
    # These pages carry structured data only: their readable text is the title.
    return C.web_texts(src("ld_pages_v"))[1].select(
        "page_id", F.char_length("text").cast("long").alias("n"), "reason")


@query("x1_document_scores", f"WITH {SCORED('documents', 'doc_id')} SELECT doc_id, floor(raw * 100 + 0.5) / 100 AS score, raw >= 4.0::DOUBLE AS is_recipe FROM s")
def _(src):
    return C.scored(src("documents")).select("doc_id", "score", "is_recipe")


@query("x1_caption_scores", f"WITH {SCORED('@captions_v', 'id')} SELECT id, floor(raw * 100 + 0.5) / 100 AS score, raw >= 4.0::DOUBLE AS is_recipe FROM s")
def _(src):
    return C.scored(src("captions_v")).select("id", "score", "is_recipe")


@query("f7_recipe_captions", f"WITH {SCORED('@captions_v', 'id')} SELECT id, text FROM s WHERE raw >= 4.0::DOUBLE")
def _(src):
    return C.recipes_only(src("captions_v")).select("id", "text")


@query("a4_distinct_verbs", f"SELECT doc_id, CAST(len(list_distinct(list_transform(regexp_extract_all({CLEAN}, {D.q(D.VERB)}), lambda v: lower(v)))) AS INTEGER) AS verbs FROM documents")
def _(src):
    return src("documents").select(
        "doc_id", S.distinct_verbs(S.score_text(F.col("text"))).alias("verbs"))


LINES = f"list_filter(list_transform(regexp_split_to_array(text || chr(10) || text, '\\r?\\n'), lambda l: {D.collapse(D.trim('l'))}), lambda l: l <> '')"


@query("w2_distinct_lines", f"""WITH l AS (SELECT doc_id, {LINES} AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), chr(10)) AS lines FROM l""")
def _(src):
    doubled = src("documents").select("doc_id", F.concat("text", F.lit("\n"), "text").alias("text"))
    return C.distinct_lines(doubled).select("doc_id", F.array_join("lines", "\n").alias("lines"))


@query("s3_embed_captions", """SELECT id, CASE WHEN id % 5 <> 0 THEN 'Dish ' || c || ' by @friend & co' || chr(10) || '1 cup rice' END AS caption,
  CASE WHEN id % 5 <> 0 THEN 'cook' || c END AS author, CASE WHEN id % 5 <> 0 THEN 'https://i.example.com/' || c || '.jpg?a=1&b=2' END AS thumbnail_url
FROM (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS c FROM orders) o""")
def _(src):
    return R.scan_embeds(src("embed_v"))


OEMBED = """o AS (SELECT id, CASE WHEN json_valid(value) THEN nullif(trim(value ->> '$.title'), '') END AS caption,
  CASE WHEN json_valid(value) THEN nullif(trim(value ->> '$.author_name'), '') END AS author,
  CASE WHEN json_valid(value) THEN value ->> '$.thumbnail_url' END AS thumbnail_url FROM @oembed_v)"""


@query("s4_oembed_records", f"WITH {OEMBED} SELECT * FROM o")
def _(src):
    return R.scan_oembed(src("oembed_v"))


META = """m AS (SELECT id, value ->> '$.title' AS title, value ->> '$.description' AS description,
  coalesce(value ->> '$.uploader', value ->> '$.channel') AS author, CAST(floor(CAST(value ->> '$.duration' AS DOUBLE) + 0.5) AS INTEGER) AS duration_seconds,
  CASE WHEN id % 9 = 0 THEN NULL WHEN id % 5 = 0 THEN 'human' WHEN id % 5 = 1 THEN 'gb' END AS caption_url FROM @vmeta_v)"""


@query("s5_video_metadata", f"WITH {META} SELECT * FROM m")
def _(src):
    return R.scan_video_meta(src("vmeta_v")).select(
        "id", "title", "description", "author", "duration_seconds", "caption_url")


VTT = f"""v AS (SELECT doc_id, list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(value, '\\r?\\n'), lambda l: {D.trim('l')}),
  lambda l: l <> '' AND l <> 'WEBVTT' AND NOT regexp_matches(l, '^(NOTE|STYLE|REGION|Kind:|Language:)') AND NOT regexp_matches(l, '^[0-9]+$') AND NOT contains(l, '-->')),
  lambda l: {D.collapse(D.trim("regexp_replace(l, '<[^>]+>', '', 'g')"))}), lambda l: l <> '') AS l FROM @vtt_v),
tr AS (SELECT doc_id, {D.normalise("array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), ' ')")} AS transcript FROM v)"""


@query("s6_transcripts", f"WITH {VTT} SELECT doc_id, transcript FROM tr")
def _(src):
    return R.scan_transcripts(src("vtt_v"))


@query("x2_tier_routing", f"""WITH {SCORED('@gathered_v', 'id')}
SELECT id, CASE WHEN has_json_ld THEN 'tier0' WHEN platform IN ('instagram', 'tiktok', 'youtube') AND raw < 4.0::DOUBLE AND coalesce(duration_seconds, 0) <= 300
  THEN 'tier2' ELSE 'tier3' END AS tier, CASE WHEN has_json_ld THEN 'tier0:json-ld' WHEN platform = 'web' THEN 'tier1:web-text' ELSE 'tier1:' || platform END
  || CASE WHEN NOT has_json_ld AND platform IN ('instagram', 'tiktok', 'youtube') AND raw < 4.0::DOUBLE AND coalesce(duration_seconds, 0) <= 300 THEN '|tier2:audio' ELSE '' END AS tiers FROM s""")
def _(src):
    return C.route(src("gathered_v")).select("id", "tier", F.array_join("tiers", "|").alias("tiers"))


@query("x3_source_priority", """SELECT id, coalesce(nullif(trim(supplied_text), ''), nullif(trim(raw_text), ''), 'fetched ' || CAST(id AS VARCHAR)) AS text,
  CASE WHEN coalesce(nullif(trim(supplied_text), ''), nullif(trim(raw_text), '')) IS NOT NULL THEN 'tier1:supplied-text' END AS label FROM @jobs_v""")
def _(src):
    text, label = C.source_text(F.col("supplied_text"), F.col("raw_text"),
                                F.concat(F.lit("fetched "), F.col("id").cast("string")))
    return src("jobs_v").select("id", text.alias("text"), label.alias("label"))


def _metadata(src):
    return R.scan_video_meta(src("vmeta_v")).select(
        "id", F.col("description").alias("m_description"), F.col("title").alias("m_title"), F.col("author").alias("m_author"),
        F.col("thumbnail_url").alias("m_thumbnail"))


@query("x7_embed_chain", f"""WITH {META}, e AS (SELECT id, CASE WHEN id % 5 <> 0 THEN 'Dish ' || c || ' by @friend & co' || chr(10) || '1 cup rice' END AS caption,
  CASE WHEN id % 5 <> 0 THEN 'cook' || c END AS author FROM (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS c FROM orders) o)
SELECT e.id, CASE WHEN caption IS NOT NULL THEN 'tier1:instagram-embed' WHEN description IS NOT NULL THEN 'tier1:instagram-ytdlp' END AS tier,
  coalesce(caption, description) AS text, CASE WHEN caption IS NOT NULL THEN e.author WHEN description IS NOT NULL THEN coalesce(m.author, e.author) END AS source_author,
  CASE WHEN caption IS NULL AND description IS NULL THEN 'no caption' END AS reason FROM e JOIN m ON m.id = e.id""")
def _(src):
    e = R.scan_embeds(src("embed_v")).select("id", F.col("caption").alias("e_text"), F.col("author").alias("e_author"),
                                              F.col("thumbnail_url").alias("e_thumbnail"))
    return C.embed_then_metadata(e.join(_metadata(src), "id")).select("id", "tier", "text", "source_author", "reason")


@query("x2_supplied_text", f"""WITH {SCORED('@gathered_v', 'id')},
p AS (SELECT *, CASE id % 4 WHEN 0 THEN 'pasted words ' || CAST(id AS VARCHAR) END AS pasted FROM s)
SELECT id, CASE WHEN pasted IS NOT NULL THEN 'tier3' WHEN has_json_ld THEN 'tier0' WHEN platform IN ('instagram', 'tiktok', 'youtube') AND raw < 4.0::DOUBLE
  AND coalesce(duration_seconds, 0) <= 300 THEN 'tier2' ELSE 'tier3' END AS tier,
  CASE WHEN pasted IS NOT NULL THEN 'tier1:supplied-text' ELSE CASE WHEN has_json_ld THEN 'tier0:json-ld' WHEN platform = 'web' THEN 'tier1:web-text' ELSE 'tier1:' || platform END
  || CASE WHEN NOT has_json_ld AND platform IN ('instagram', 'tiktok', 'youtube') AND raw < 4.0::DOUBLE AND coalesce(duration_seconds, 0) <= 300 THEN '|tier2:audio' ELSE '' END END AS tiers,
  pasted FROM p""")
def _(src):
    k = F.col("id") % 4
    rows = src("gathered_v").withColumn("supplied", F.when(
        k == 0, F.concat(F.lit(" pasted  words "), F.col("id").cast("string"), F.lit("\n"))).when(k == 1, F.lit("  ")))
    routed = C.route(rows, supplied="supplied")
    return routed.select("id", "tier", F.array_join("tiers", "|").alias("tiers"), F.when(k == 0, F.col("text")).alias("pasted"))


@query("x7_first_source", f"""WITH {META}, {OEMBED}
SELECT o.id, CASE WHEN o.caption IS NOT NULL THEN 'tiktok-oembed' WHEN coalesce(m.description, m.title) IS NOT NULL THEN 'tiktok-ytdlp' END AS tier,
  coalesce(o.caption, m.description, m.title) AS text, CASE WHEN o.caption IS NOT NULL THEN o.author ELSE
  CASE WHEN coalesce(m.description, m.title) IS NOT NULL THEN coalesce(m.author, o.author) END END AS source_author,
  CASE WHEN o.caption IS NULL AND coalesce(m.description, m.title) IS NULL THEN 'no caption' END AS reason FROM o JOIN m ON m.id = o.id""")
def _(src):
    o = R.scan_oembed(src("oembed_v")).select("id", F.col("caption").alias("o_text"), F.col("author").alias("o_author"),
                                               F.col("thumbnail_url").alias("o_thumbnail"))
    picked = C.oembed_then_metadata(o.join(_metadata(src), "id"))
    return picked.select("id", "tier", "text", "source_author", "reason")


@query("x4_caption_or_transcript", f"""WITH {META}, {VTT}, j AS (SELECT m.*, tr.transcript FROM m LEFT JOIN tr ON tr.doc_id = m.id),
d AS (SELECT *, coalesce(description, '') AS text FROM j), {SCORED('d', 'id')},
u AS (SELECT *, raw < 4.0::DOUBLE AND coalesce(length(transcript) > 80, false) AS use FROM s),
p AS (SELECT *, CASE WHEN use THEN {D.normalise("text || chr(10) || chr(10) || '--- transcript ---' || chr(10) || transcript")} ELSE text END AS body FROM u)
SELECT id, CASE WHEN use THEN 'tier1:youtube-description|tier1:youtube-captions' ELSE 'tier1:youtube-description' END AS tiers,
  length(body) >= 40 AS readable, {D.normalise("coalesce(title, '') || chr(10) || chr(10) || body")} AS text FROM p""")
def _(src):
    meta = R.scan_video_meta(src("vmeta_v")).select("id", "title", "description")
    # Texts take many times their size in the file: never sent whole to every task, whatever the planner estimates.
    spoken = R.scan_transcripts(src("vtt_v")).withColumnRenamed("doc_id", "id").hint("merge")
    out = C.caption_or_transcript(meta.join(spoken, "id", "left"))
    return out.select("id", F.array_join("tiers", "|").alias("tiers"), "readable", "text")


@query("x5_provenance", """SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'm1' ELSE 'm2' END AS model, (id % 100) / 100.0::DOUBLE AS confidence, text AS raw_text FROM @captions_v""")
def _(src):
    k = F.col("id")
    t3 = lambda m: F.lit(C.TIER3_PREFIX + m)
    tiers = (F.when(k % 3 == 0, F.array(F.lit("tier0:json-ld"))).when(k % 3 == 1, F.array(F.lit("tier1:web-text"), t3("m1")))
             .otherwise(F.array(t3("m1"), t3("m2"), F.lit("x"))))
    e = C.extraction(tiers, (k % 100) / F.lit(100.0), F.col("text"))
    return src("captions_v").select("id", e.alias("e")).select("id", "e.model", "e.confidence", "e.raw_text")


TAGS = "list_filter(list_transform(list_filter(CAST(value -> '$.tags' AS JSON[]), lambda j: json_type(j) = 'VARCHAR'), lambda j: regexp_replace(lower(trim(j ->> '$')), '^#', '')), lambda t: length(t) BETWEEN 2 AND 39)"
TEXTF = lambda k: f"CASE WHEN json_type(value, '$.{k}') = 'VARCHAR' THEN nullif(trim(value ->> '$.{k}'), '') END"
NUMF = lambda k: f"CASE WHEN json_type(value, '$.{k}') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'DECIMAL') THEN CAST(value ->> '$.{k}' AS DOUBLE) END"
COERCED = f"""ok AS (SELECT id, CASE WHEN json_valid(value) THEN value ELSE '{{}}' END AS value FROM @raw_json_v),
x AS (SELECT id, {TEXTF('title')} AS t, {TEXTF('description')} AS d, {TEXTF('servings')} AS s, {NUMF('totalMinutes')} AS m, {NUMF('confidence')} AS c,
  json_type(value, '$.isRecipe') = 'BOOLEAN' AND value ->> '$.isRecipe' = 'true' AS said, {TAGS} AS tags,
  CASE WHEN json_type(value, '$.ingredients') = 'ARRAY' THEN list_filter(list_transform(CAST(value -> '$.ingredients' AS JSON[]), lambda j:
    CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.item') = 'VARCHAR' THEN nullif(trim(j ->> '$.item'), '') END), lambda i: i IS NOT NULL) ELSE [] END AS items,
  CASE WHEN json_type(value, '$.steps') = 'ARRAY' THEN list_filter(list_transform(CAST(value -> '$.steps' AS JSON[]), lambda j:
    CASE WHEN json_type(j) = 'VARCHAR' THEN trim(regexp_replace(j ->> '$', '^\\s*\\d+[.)]\\s*', '')) ELSE '' END), lambda i: i <> '') ELSE [] END AS steps FROM ok),
co AS (SELECT id, coalesce(least(1.0, greatest(0.0, c)), 0.5)::DOUBLE AS confidence, coalesce({D.cap('t', 200)}, 'Untitled recipe') AS title, {D.cap('d', 2000)} AS description,
  s AS servings, nullif(greatest(0, CAST(floor(m + 0.5) AS INTEGER)), 0) AS total_minutes, array_to_string(list_transform(items, lambda i: {D.cap('i', 200)}), '|') AS items,
  array_to_string(steps, '|') AS steps, coalesce(array_to_string(list_filter(tags, lambda v, i: list_position(tags, v) = i)[1:5], '|'), '') AS tags,
  coalesce(said, false) AND (len(items) > 0 OR len(steps) > 0) AS is_recipe FROM x)"""


def coerced(src):
    return V.coerce_parsed(src("raw_json_v")).select(
        "id", "confidence", "title", "description", "servings", "total_minutes",
        F.array_join(F.transform("ingredients", lambda i: i["item"]), "|").alias("items"),
        F.array_join("steps", "|").alias("steps"), F.array_join("tags", "|").alias("tags"), "is_recipe")


COER_SEL = "SELECT id, confidence, title, description, servings, total_minutes, coalesce(items, '') AS items, coalesce(steps, '') AS steps, tags, is_recipe FROM co"


@query("v3_coerced_output", f"WITH {COERCED} {COER_SEL}")
def _(src):
    return coerced(src)


@query("x6_not_recipes", f"WITH {COERCED} SELECT id, title FROM co WHERE NOT is_recipe")
def _(src):
    return C.split_outcomes(coerced(src))[1].select("id", "title")


PATCH_REASON = """CASE recipe_id % 12 WHEN 1 THEN 'Unknown field: favourite' WHEN 4 THEN '`totalMinutes` must be between 0 and 10080.'
  WHEN 7 THEN '`title` must be a non-empty string.' WHEN 8 THEN '`favorite` must be a boolean.' WHEN 11 THEN '`tags` must be an array of strings.' END"""


@query("v1_checked_writes", f"SELECT recipe_id, {PATCH_REASON} AS reason FROM @patches_v")
def _(src):
    return V.validate_writes(src("patches_v")).select("recipe_id", "reason")


@query("v1_accepted_writes", f"""SELECT recipe_id, nullif(trim(body ->> '$.title'), '') AS title, body ->> '$.servings' AS servings,
  CAST(body ->> '$.totalMinutes' AS INTEGER) AS total_minutes, CASE WHEN recipe_id % 12 = 10 THEN 'a|b' END AS tags FROM @patches_v WHERE {PATCH_REASON} IS NULL""")
def _(src):
    return V.split_valid(V.validate_writes(src("patches_v")))[0].select(
        "recipe_id", "title", "servings", "total_minutes", F.array_join("tags", "|").alias("tags"))


@query("v2_ingredient_errors", """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 1 THEN '`ingredients[1]` must be an object.' WHEN 2 THEN '`ingredients[0].item` must be a non-empty string.'
  WHEN 3 THEN '`ingredients[0].unit` must be a string.' WHEN 4 THEN '`ingredients` must be an array of objects.' END AS reason FROM orders""")
def _(src):
    k = F.col("o_orderkey") % 5
    body = (F.when(k == 0, '{"ingredients":[{"item":" Rice ","unit":"","quantity":null}]}').when(k == 1, '{"ingredients":[{"item":"a"},"b"]}')
            .when(k == 2, '{"ingredients":[{"item":"  "}]}').when(k == 3, '{"ingredients":[{"item":"a","unit":5}]}').otherwise('{"ingredients":"x"}'))
    return V.validate_writes(src("orders").select(F.col("o_orderkey").alias("id"), body.alias("body"))).select("id", "reason")


@query("v2_ingredient_white_space", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 2 THEN '`ingredients[0].item` must be a non-empty string.' END AS reason,
  CASE o_orderkey % 5 WHEN 2 THEN 'rice' WHEN 3 THEN 'fish cake' WHEN 4 THEN 'plain' END AS item, CASE o_orderkey % 5 WHEN 3 THEN '2' END AS quantity FROM orders""")
def _(src):
    k = F.col("o_orderkey") % 5
    item = (F.when(k == 0, "\\t\\n").when(k == 1, "\u00a0 \u3000").when(k == 2, "\\trice\\r\\n")
            .when(k == 3, "\u2003fish cake \ufeff").otherwise("plain"))
    body = F.concat(F.lit('{"ingredients":[{"item":"'), item, F.lit('","quantity":"'), F.when(k == 3, " 2\\t").otherwise("\\t"), F.lit('"}]}'))
    checked = V.validate_writes(src("orders").select(F.col("o_orderkey").alias("id"), body.alias("body")))
    first = F.when(F.col("reason").isNull(), F.get("ingredients", F.lit(0)))
    return checked.select("id", "reason", first["item"].alias("item"), first["quantity"].alias("quantity"))


@query("m1_patched_recipes", r"""WITH b AS (SELECT id, title, servings, total_minutes, favorite, description, CASE WHEN n > 0 AND n < 1000 THEN CAST(floor(n + 0.5) AS INTEGER) END AS servings_count
  FROM (SELECT *, TRY_CAST(regexp_extract(servings, '(\d+(\.\d+)?)', 1) AS DOUBLE) AS n FROM @recipes_v) x), p AS (SELECT *, recipe_id % 12 AS k FROM @patches_v)
SELECT b.id, CASE WHEN k = 0 THEN trim(p.body ->> '$.title') ELSE title END AS title, CASE WHEN k IN (2, 3) THEN p.body ->> '$.servings' ELSE servings END AS servings,
  CASE k WHEN 2 THEN CAST(regexp_extract(p.body ->> '$.servings', '\d+', 0) AS INTEGER) WHEN 3 THEN 9 ELSE servings_count END AS servings_count,
  CASE WHEN k = 9 THEN 45 ELSE total_minutes END AS total_minutes, k = 9 OR favorite AS favorite, CASE WHEN k = 6 THEN NULL ELSE description END AS description
FROM b JOIN p ON p.recipe_id = b.id""")
def _(src):
    from larder.functions.quantity import servings_count

    base = src("recipes_v").select("id", "title", "servings", servings_count(F.col("servings")).alias("servings_count"),
                                   "total_minutes", "favorite", "description")
    valid, _bad = V.split_valid(V.validate_writes(src("patches_v")))
    return M.apply_patches(base, valid)


@query("m2_manual_recipes", r"""SELECT id, title, 'manual' AS source_platform, CAST(CASE WHEN id % 2 = 0 THEN 3 ELSE CASE WHEN n > 0 THEN floor(n + 0.5) END END AS INTEGER) AS servings_count,
  0 AS cooked_count, false AS favorite FROM (SELECT id, title, TRY_CAST(regexp_extract(servings, '(\d+(\.\d+)?)', 1) AS DOUBLE) AS n FROM @recipes_v) x""")
def _(src):
    rows = src("recipes_v").select("id", "title", "servings", F.lit("web").alias("source_platform"), F.when(
        F.col("id") % 2 == 0, F.lit(3)).alias("servings_count"), F.lit(None).cast("boolean").alias("favorite"))
    return M.create_manual(rows).drop("servings")
