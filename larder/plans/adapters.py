"""Catalog-shaped views over the given tables.

Each view is one SELECT that Spark and DuckDB both run; ``@name`` refers to a
table or to another view. Every view is row-wise over its base table (plus key
joins), so it grows with the data and never gathers a group.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from larder.sources.tables import read_table

TABLES = frozenset(
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations".split())

# (line_no, part_id, supp_id, price) orders the lines of a recipe totally.
LINE_ORDER = ["line_no", "part_id", "supp_id", "price"]
LIST_ORDER = ["created_at", "recipe_id", *LINE_ORDER]

VIEWS = {
    "lines_v": """
SELECT l.l_orderkey AS recipe_id, l.l_linenumber AS line_no, l.l_partkey AS part_id,
  l.l_suppkey AS supp_id, l.l_extendedprice AS price,
  CASE l.l_partkey % 8 WHEN 0 THEN '1/2' WHEN 1 THEN '1 1/2' WHEN 2 THEN '2-3'
    WHEN 3 THEN 'a splash' WHEN 4 THEN '1,5' WHEN 5 THEN '½' WHEN 6 THEN NULL
    ELSE CAST(CAST(floor(l.l_quantity) AS BIGINT) AS STRING) END AS quantity,
  CASE l.l_returnflag WHEN 'A' THEN 'cup' WHEN 'N' THEN 'tbsp' END AS unit,
  p.p_name AS item, CASE WHEN l.l_linestatus = 'F' THEN 'chopped' END AS note,
  o.o_custkey AS list_owner, l.l_shipdate AS created_at
FROM @lineitem l JOIN @part p ON p.p_partkey = l.l_partkey
JOIN @orders o ON o.o_orderkey = l.l_orderkey""",
    "recipes_v": """
SELECT o_orderkey AS id, 'Dish ' || CAST(o_custkey % 97 AS STRING) AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Plan ' || lower(o_orderpriority) END AS description,
  CASE o_orderkey % 5 WHEN 0 THEN NULL
    ELSE CASE o_orderkey % 4 WHEN 0 THEN 'https://instagram.com/reel/code'
      WHEN 1 THEN 'https://youtube.com/watch?v=vid' WHEN 2 THEN 'https://tiktok.com/@u/video/1000'
      ELSE 'https://blog.example.com/p/' END || CAST(o_orderkey AS STRING) END AS source_url,
  CASE o_orderkey % 5 WHEN 0 THEN 'manual'
    ELSE CASE o_orderkey % 4 WHEN 0 THEN 'instagram' WHEN 1 THEN 'youtube' WHEN 2 THEN 'tiktok'
      ELSE 'web' END END AS source_platform,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '@cook' || CAST(o_custkey AS STRING)
    ELSE ' cook ' END AS source_author,
  CASE o_orderkey % 5 WHEN 0 THEN 'Serves 4' WHEN 1 THEN '6-8 tacos' WHEN 2 THEN 'a crowd'
    WHEN 3 THEN '2.5 cups' END AS servings,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL
    ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 200 AS INT) END AS total_minutes,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN '{ broken'
    WHEN o_orderkey % 37 = 0 THEN 'null' ELSE
    '[{"quantity":"' || CASE o_orderkey % 6 WHEN 0 THEN '1/2' WHEN 1 THEN '1 1/3' WHEN 2 THEN '2-3'
      WHEN 3 THEN 'a splash' WHEN 4 THEN '1,5' ELSE CAST(o_custkey % 12 AS STRING) END ||
    '","unit":"cup","item":"' || CASE o_custkey % 5 WHEN 0 THEN 'Shrimp' WHEN 1 THEN 'olive oil'
      WHEN 2 THEN 'crème fraîche' WHEN 3 THEN 'Butter 100%' ELSE 'garlic cloves' END ||
    '"},{"item":"Rice","note":"serve with shrimp crackers"}' ||
    CASE WHEN o_custkey % 3 = 0 THEN ',{"quantity":"2","item":"shrimp"}' ELSE '' END || ']'
    END AS ingredients,
  CASE o_orderkey % 3 WHEN 0 THEN '[]' WHEN 1 THEN '["Mix."]' ELSE '["Mix.","Serve."]' END AS steps,
  CASE WHEN o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN
    '["' || lower(o_orderpriority) || '","Veg"]' ELSE '["vegetarian"]' END AS tags,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '{"tiers":["' || CASE o_orderkey % 4
    WHEN 0 THEN 'tier1:instagram-embed' WHEN 1 THEN 'tier1:youtube' WHEN 2 THEN 'tier1:tiktok-oembed'
    ELSE 'tier0:json-ld' END || '"' || CASE WHEN o_custkey % 7 = 0 THEN ',"tier2:audio:m1"' ELSE ''
    END || '],"model":' || CASE WHEN o_orderkey % 4 = 3 THEN 'null' ELSE '"m2"' END ||
    ',"confidence":0.' || CAST(10 + o_custkey % 90 AS STRING) || ',"rawText":"t"}' END AS extraction,
  o_orderstatus = 'F' AS favorite, CAST(o_custkey % 5 AS INT) AS cooked_count,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderdate END AS last_cooked_at,
  o_orderdate AS created_at
FROM @orders""",
    "folders_v": """
SELECT DISTINCT p_brand AS id, p_brand AS name,
  CASE WHEN p_brand LIKE '%1%' THEN '🍰' END AS emoji FROM @part
UNION ALL SELECT 'empty' AS id, 'Empty' AS name, NULL AS emoji""",
    "folder_links_v": """
SELECT DISTINCT p.p_brand AS folder_id, l.l_orderkey AS recipe_id
FROM @lineitem l JOIN @part p ON p.p_partkey = l.l_partkey WHERE l.l_linenumber = 1""",
    "grocery_v": """
SELECT CAST(recipe_id AS STRING) || '-' || CAST(line_no AS STRING) || '-' ||
  CAST(part_id AS STRING) || '-' || CAST(supp_id AS STRING) || '-' ||
  CAST(CAST(floor(price * 100 + 0.5) AS BIGINT) AS STRING) AS id,
  concat_ws(' ', quantity, unit, item) AS text, note IS NOT NULL AS checked,
  recipe_id, list_owner, created_at, line_no, part_id, supp_id, price
FROM @lines_v""",
    "jobs_v": """
SELECT event_id AS id,
  'https://www.instagram.com/reel/code' || CAST(user_id AS STRING) || '/' AS url,
  CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done'
    WHEN 'signup' THEN 'not_recipe' ELSE 'failed' END AS status,
  CASE WHEN event_type = 'view' THEN CASE event_id % 4 WHEN 0 THEN 'fetching'
    WHEN 1 THEN 'transcribing' WHEN 2 THEN 'structuring' END END AS stage,
  event_id % 4 AS attempts, user_id AS owner,
  CASE WHEN event_type = 'purchase' THEN event_id % 1500 END AS recipe_id,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '   '
    ELSE 'Network down.' || chr(10) || 'at line ' || CAST(event_id AS STRING) END AS error,
  CASE event_id % 3 WHEN 0 THEN 'raw words' WHEN 1 THEN ' ' END AS raw_text,
  CASE event_id % 7 WHEN 0 THEN ' pasted words ' WHEN 1 THEN '' END AS supplied_text,
  ts AS created_at, ts AS updated_at
FROM @events""",
    "links_v": """
SELECT event_id AS id, ts AS submitted_at, CASE event_id % 18
  WHEN 0 THEN 'https://www.instagram.com/reel/code' || u || '/'
  WHEN 1 THEN ' https://m.instagram.com/reel/code' || u || '/?igsh=abc#top'
  WHEN 2 THEN 'http://mobile.instagram.com/reels/code' || u
  WHEN 3 THEN 'https://www.instagram.com/share/reel/tok' || u || '/'
  WHEN 4 THEN 'https://youtu.be/vid' || u || 'xyz?si=1'
  WHEN 5 THEN 'https://www.youtube.com/watch?v=vid' || u || 'xyz&t=3'
  WHEN 6 THEN 'https://www.tiktok.com/@u/video/' || CAST(1000000 + user_id AS STRING) || '?_r=1'
  WHEN 7 THEN 'https://vm.tiktok.com/ZM' || u || '/'
  WHEN 8 THEN 'https://blog.example.com/?p=' || u || '&utm_source=ig&b=2&a=1&a=0'
  WHEN 9 THEN 'https://host.example.com:8443/r/' || u
  WHEN 10 THEN 'file:///etc/passwd' WHEN 11 THEN 'https://user:pw@example.com/r'
  WHEN 12 THEN '  ' WHEN 13 THEN 'instagram.com/p/code' || u
  WHEN 14 THEN 'http://intranet.local/r' WHEN 15 THEN 'http://singlehost/r/' || u
  WHEN 16 THEN 'http://example.com:443/r/' || u || '//' ELSE 'https://www.instagram.com/user' || u
  END AS url
FROM (SELECT event_id, ts, user_id, CAST(user_id AS STRING) AS u FROM @events) e""",
    "redirects_v": """
SELECT DISTINCT 'https://www.instagram.com/share/reel/tok' || CAST(user_id AS STRING) || '/' AS url,
  CASE WHEN user_id % 5 = 0 THEN 'https://www.instagram.com/accounts/login'
    ELSE 'https://www.instagram.com/reel/code' || CAST(user_id % 100 AS STRING) || '/?x=1' END AS final_url
FROM @events""",
    "ips_v": """
SELECT event_id, CASE event_id % 12
  WHEN 0 THEN CAST(event_id % 256 AS STRING) || '.' || CAST(user_id % 256 AS STRING) || '.1.2'
  WHEN 1 THEN '100.' || CAST(60 + user_id % 72 AS STRING) || '.0.1'
  WHEN 2 THEN '172.' || CAST(14 + user_id % 20 AS STRING) || '.255.255'
  WHEN 3 THEN '192.' || CAST(user_id % 200 AS STRING) || '.3.4'
  WHEN 4 THEN '198.' || CAST(16 + user_id % 5 AS STRING) || '.0.0'
  WHEN 5 THEN '169.' || CAST(253 + user_id % 3 AS STRING) || '.1.1'
  WHEN 6 THEN '::ffff:' || CAST(user_id % 200 AS STRING) || '.0.0.1'
  WHEN 7 THEN CASE user_id % 4 WHEN 0 THEN '::1' WHEN 1 THEN 'FE80::1' WHEN 2 THEN 'fd00::12' ELSE 'ff02::1' END
  WHEN 8 THEN '2001:db8::' || CAST(user_id % 100 AS STRING)
  WHEN 9 THEN 'host-' || CAST(user_id AS STRING) WHEN 10 THEN '1.2.3'
  ELSE CAST(220 + user_id % 40 AS STRING) || '.1.1.1' END AS ip
FROM @events""",
    "captions_v": """
SELECT o_orderkey AS id, CASE o_orderkey % 6
  WHEN 0 THEN 'Dish ' || c || ' you keep asking for!' || nl || nl || 'INGREDIENTS' || nl ||
    '- 1 lb shrimp, peeled' || nl || '- ' || c || ' cups flour' || nl || '- 1/2 tsp salt' || nl ||
    '• ½ cup oil' || nl || nl || nl || nl || 'METHOD' || nl || '1. Combine the flour and salt.  ' || nl ||
    '2. Whisk, fry and drain.' || nl || 'Serve.' || nl || '#easy #food' || c
  WHEN 1 THEN 'You asked and I delivered' || nl || nl || 'Full recipe is in my bio!! Link in bio' || nl || '#food #foodie' || c || ' #yum'
  WHEN 2 THEN 'Went to the new place on Lane ' || c || ' last night and honestly? Best tacos I have had, no notes.'
  WHEN 3 THEN 'Pasta: ' || c || '\u2009g spaghetti, 2\u2009cloves garlic, 1/2 cup oil, 1\u20091/2\u2009tsp salt. Boil, drain and toss.\u2009#pasta'
  WHEN 4 THEN '' END AS text
FROM (SELECT o_orderkey, CAST(o_custkey % 40 AS STRING) AS c, chr(10) AS nl FROM @orders) o""",
    "ld_pages_v": """
SELECT id AS page_id,
  '<html><head><title>' || title || '</title><meta property="og:image" content="https://i.example.com/' ||
  CAST(id AS STRING) || '.jpg"><script type=' ||
  CASE WHEN id % 2 = 0 THEN '"application/ld+json"' ELSE 'application/ld+json' END || '>' ||
  CASE WHEN id % 7 = 0 THEN '{ "broken": , }</script><script type="application/ld+json">' ELSE '' END ||
  CASE WHEN id % 11 = 0 THEN '<![CDATA[' ELSE '' END ||
  CASE WHEN id % 3 = 0 THEN '{"@graph":[{"@type":"WebSite","name":"s"},' ELSE '' END ||
  CASE WHEN id % 13 = 0 THEN '{"@type":"WebPage","mainEntity":' ELSE '' END ||
  '{"@type":' || CASE WHEN id % 5 = 0 THEN '["NewsArticle","recipe"]' WHEN id % 17 = 0 THEN '"Article"'
    ELSE '"Recipe"' END || CASE WHEN id % 19 = 0 THEN '' ELSE ',"name":"' || title || ' &amp; <b>more</b>"' END ||
  CASE id % 4 WHEN 0 THEN ',"prepTime":"PT10M","cookTime":"PT' || CAST(id % 90 AS STRING) || 'M"'
    WHEN 1 THEN ',"totalTime":"P0DT1H' || CAST(id % 60 AS STRING) || 'M30S"'
    WHEN 2 THEN ',"totalTime":' || CAST(id % 90 AS STRING) ELSE ',"totalTime":"soon"' END ||
  ',"recipeYield":' || CASE WHEN servings IS NULL THEN '4' ELSE '["' || servings || '","x"]' END ||
  CASE WHEN id % 23 = 0 THEN '' ELSE ',"recipeIngredient":["1 lb shrimp, peeled and deveined","' ||
    CAST(id % 9 AS STRING) || ' cups of flour (sifted)","1 1/2 tbsp. olive oil","salt &amp; pepper",""]' END ||
  ',"recipeInstructions":' || CASE id % 4
    WHEN 0 THEN '[{"@type":"HowToStep","text":"Mix."},{"@type":"HowToStep","text":"Serve."}]'
    WHEN 1 THEN '[{"@type":"HowToSection","name":"Prep","itemListElement":[{"@type":"HowToStep","text":"Chop."},{"name":"Wash."}]},"Fry well."]'
    WHEN 2 THEN '"1. Boil water<br>2) Add pasta</p>ok"' ELSE '["Stir it","- Bake","x"]' END ||
  ',"recipeCategory":"Dinner, Quick","recipeCuisine":["Thai","dinner"],"keywords":"a, Spicy Noodles"' ||
  ',"author":{"@type":"Person","name":"Cook ' || CAST(id % 50 AS STRING) || '"}' ||
  CASE id % 3 WHEN 0 THEN ',"image":"https://i.example.com/a.jpg"' WHEN 1 THEN
    ',"image":[{"@type":"ImageObject","url":"https://i.example.com/b.jpg"},"c.jpg"]' ELSE '' END || '}' ||
  CASE WHEN id % 13 = 0 THEN '}' ELSE '' END || CASE WHEN id % 3 = 0 THEN ']}' ELSE '' END ||
  CASE WHEN id % 11 = 0 THEN ']]>' ELSE '' END || '</script></head><body></body></html>' AS html
FROM @recipes_v""",
    "deep_pages_v": """
SELECT id AS page_id, '<script type="application/ld+json">{"@type":"Recipe","name":' ||
  repeat('[{"@value":null,"name":', CAST(id % 41 AS INT)) || '"' || title || ' {[&amp;"' || repeat('}]', CAST(id % 41 AS INT)) ||
  ',"author":' || repeat('[', CAST(id % 9 AS INT)) || '{"@value":{"text":["' || title || '",7,true,null,{"url":"u' ||
  CAST(id % 50 AS STRING) || '"}]},"name":"no"}' || repeat(']', CAST(id % 9 AS INT)) ||
  ',"image":' || repeat('{"url":null,"contentUrl":[[],', CAST(id % 23 AS INT)) || '"https://i.example.com/' ||
  CAST(id AS STRING) || '.jpg"' || repeat(']}', CAST(id % 23 AS INT)) ||
  ',"recipeIngredient":[' || repeat('{"text":[', CAST(id % 7 AS INT)) || '"2 cups flour"' || repeat(']}', CAST(id % 7 AS INT)) || ']' ||
  ',"recipeInstructions":[{"text":' || repeat('{"name":', CAST(id % 12 AS INT)) || '"Stir well."' || repeat('}', CAST(id % 12 AS INT)) ||
  '}],"keywords":' || repeat('[', CAST(id % 15 AS INT)) || '"Thai, Soup"' || repeat(']', CAST(id % 15 AS INT)) || '}</script>' AS html
FROM @recipes_v""",
    "raw_json_v": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 16 = 0 THEN 'not json' WHEN o_orderkey % 16 = 1 THEN '[1]' ELSE
  '{"isRecipe":' || CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN '"yes"' ELSE 'false' END ||
  ',"confidence":' || CASE o_orderkey % 5 WHEN 0 THEN '7' WHEN 1 THEN '-1' WHEN 2 THEN '"x"' WHEN 3 THEN '0.25' ELSE 'null' END ||
  ',"title":' || CASE o_orderkey % 4 WHEN 0 THEN '"' || repeat('long title ', 30) || '"' WHEN 1 THEN '"  "' WHEN 2 THEN '12' ELSE '" Dish ' || CAST(o_custkey AS STRING) || ' "' END ||
  ',"description":' || CASE o_orderkey % 3 WHEN 0 THEN 'null' ELSE '"' || repeat('d', 1995) || CAST(o_custkey AS STRING) || '"' END ||
  ',"servings":' || CASE o_orderkey % 2 WHEN 0 THEN '4' ELSE '"Serves 4"' END ||
  ',"totalMinutes":' || CASE o_orderkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '12.5' WHEN 2 THEN '"9"' WHEN 3 THEN '-3' ELSE CAST(o_custkey % 300 AS STRING) END ||
  ',"ingredients":' || CASE o_orderkey % 4 WHEN 0 THEN '"none"' WHEN 1 THEN '[]' ELSE
    '[{"quantity":" 1 ","unit":5,"item":" Flour "},{"item":"  "},"text",{"item":"' || repeat('long item ', 25) || '","note":"n"}]' END ||
  ',"steps":' || CASE o_orderkey % 3 WHEN 0 THEN '["1. Mix","2) Bake ","",7]' WHEN 1 THEN 'null' ELSE '[]' END ||
  ',"tags":["#Thai","thai","a",3,"' || lower(o_orderpriority) || '","b2","b3","b4","b5"],"notes":"' || CAST(o_custkey AS STRING) || '"}' END AS value
FROM @orders""",
    "patches_v": """
SELECT o_orderkey AS recipe_id, CASE o_orderkey % 12
  WHEN 0 THEN '{"title":" New ' || CAST(o_custkey AS STRING) || ' "}' WHEN 1 THEN '{"favourite":true}'
  WHEN 2 THEN '{"servings":"' || CAST(1 + o_custkey % 9 AS STRING) || ' bowls"}'
  WHEN 3 THEN '{"servings":"Serves 4","servingsCount":9}' WHEN 4 THEN '{"totalMinutes":99999}'
  WHEN 5 THEN '{}' WHEN 6 THEN '{"description":null,"notes":"  "}' WHEN 7 THEN '{"title":""}'
  WHEN 8 THEN '{"favorite":"yes"}' WHEN 9 THEN '{"totalMinutes":45,"favorite":true}'
  WHEN 10 THEN '{"tags":[" a ","","b"],"steps":["x"]}' ELSE '{"servings":null,"tags":[1]}' END AS body
FROM @orders""",
    "messages_v": """
SELECT event_id AS update_id, CASE WHEN event_id % 13 = 0 THEN 'edited_message' ELSE 'message' END AS kind,
  CASE WHEN event_id % 11 = 0 THEN '999' ELSE '42' END AS chat_id,
  CASE event_id % 10 WHEN 0 THEN 'https://www.instagram.com/reel/code' || u || '/'
    WHEN 1 THEN 'look (https://example.com/r/' || u || ').' WHEN 2 THEN 'a https://a.example.com/' || u || ', b http://b.example.com/x; https://a.example.com/' || u
    WHEN 3 THEN ' /FIND@some_bot spicy noodles' WHEN 4 THEN '/id' WHEN 5 THEN '  ' WHEN 6 THEN NULL
    WHEN 7 THEN 'just words' WHEN 8 THEN '1 cup rice https://example.com/r' ELSE '/list' END AS text,
  CASE event_id % 3 WHEN 0 THEN event_id % 50 END AS reply_to_bot_msg
FROM (SELECT event_id, CAST(user_id AS STRING) AS u FROM @events) e""",
    "failed_imports_v": """
SELECT DISTINCT event_id % 50 AS message_id FROM @events WHERE event_type = 'error' AND event_id % 50 < 25""",
    "http_v": """
SELECT event_id AS job_id, CAST(CASE event_id % 9 WHEN 0 THEN 200 WHEN 1 THEN 400 WHEN 2 THEN 401 WHEN 3 THEN 404
  WHEN 4 THEN 409 WHEN 5 THEN 429 WHEN 6 THEN 500 WHEN 7 THEN 503 ELSE 504 END AS INT) AS status FROM @events""",
    "embed_v": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN '<html>shell</html>' ELSE
  '<div><img alt="x" class="EmbeddedMediaImage" src="https://i.example.com/' || c || '.jpg?a=1&amp;b=2"><span class="UsernameText">cook' || c ||
  '</span><div class="Caption"><a class="CaptionUsername" href="/u">cook' || c || '</a><br/><br/>Dish ' || c ||
  ' by &#064;friend &amp; co<br>1 cup rice<div class="CaptionComments"><a>View all 12 comments</a></div></div>' END AS html
FROM (SELECT o_orderkey, CAST(o_custkey AS STRING) AS c FROM @orders) o""",
    "oembed_v": """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'oops' WHEN 1 THEN '{"author_name":"cook"}'
  ELSE '{"title":" Dish ' || CAST(o_custkey AS STRING) || ' ","author_name":" cook ","author_url":"u","thumbnail_url":"https://i.example.com/t.jpg"}' END AS value
FROM @orders""",
    "vmeta_v": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'null' ELSE
  '{"title":"Clip ' || CAST(o_custkey AS STRING) || '","uploader":' || CASE WHEN o_orderkey % 2 = 0 THEN '"up"' ELSE 'null' END || ',"channel":"chan"' ||
  CASE o_orderkey % 3 WHEN 0 THEN ',"description":"Short words about ' || CAST(o_custkey AS STRING) || '"' WHEN 1 THEN
   ',"description":"Ingredients: 1 cup flour, 2 cups milk, 1 tsp salt, 3 tbsp oil. Method: mix, whisk, bake and serve."' ELSE '' END ||
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ',"duration":59.5' ELSE ',"duration":301' END ||
  CASE o_orderkey % 5 WHEN 0 THEN ',"automatic_captions":{"de":[{"ext":"vtt","url":"de"}],"en":[{"ext":"srv1","url":"s"},{"ext":"vtt","url":"auto"}]},"subtitles":{"en":[{"ext":"vtt","url":"human"}]}'
   WHEN 1 THEN ',"automatic_captions":{"en-GB":[{"ext":"vtt","url":"gb"}]}' WHEN 2 THEN ',"subtitles":{"fr":[{"ext":"vtt","url":"fr"}]}' ELSE '' END || '}' END AS value
FROM @orders""",
    "vtt_v": """
SELECT doc_id, 'WEBVTT' || chr(10) || 'Kind: captions' || chr(10) || chr(10) || '1' || chr(10) ||
  '00:00:00.000 --> 00:00:02.000' || chr(13) || chr(10) || '<c>Hello</c>  there' || chr(10) || 'Hello there' || chr(10) ||
  '2' || chr(10) || '00:00:02.000 --> 00:00:04.000' || chr(10) || replace(text, '. ', '.' || chr(10)) || chr(10) || replace(text, '. ', '.' || chr(10)) AS value
FROM @documents""",
    "gathered_v": """
SELECT id, CASE id % 5 WHEN 0 THEN 'instagram' WHEN 1 THEN 'tiktok' WHEN 2 THEN 'youtube' WHEN 3 THEN 'web' ELSE 'manual' END AS platform,
  text, CAST(CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 60 ELSE 301 END AS INT) AS duration_seconds, id % 7 = 0 AS has_json_ld
FROM @captions_v""",
}


# Long texts and markup: a row costs far more to work on than to read, and a whole table
# may be one row group. What they are made from is dealt out before.
DEAR = frozenset("documents vtt_v vmeta_v captions_v gathered_v ld_pages_v deep_pages_v".split())


def _references(sql: str) -> list[str]:
    return sorted(set(re.findall(r"@(\w+)", sql)) & (TABLES | set(VIEWS)))


def view(spark: SparkSession, folder: str, name: str, deal: bool = False) -> DataFrame:
    """A base table or adapter view as a lazy DataFrame."""
    deal = deal or name in DEAR
    if name in TABLES:
        return read_table(spark, folder, name, deal)
    return view_over(
        spark, name, {ref: view(spark, folder, ref, deal) for ref in _references(VIEWS[name])})


def view_over(spark: SparkSession, name: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """An adapter view over given frames, for instance over streams."""
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
    for ref in inputs:
        sql = re.sub(rf"@{ref}\b", "{" + ref + "}", sql)
    return spark.sql(sql, **inputs)


def with_views(sql: str) -> str:
    """DuckDB text: ``sql`` preceded by the views it refers to (``@name``)."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for ref in _references(text):
            if ref in VIEWS and ref not in needed:
                visit(VIEWS[ref])
                needed.append(ref)

    visit(sql)
    ctes = [f"{name} AS ({VIEWS[name]})" for name in needed]
    body = sql.strip()
    if ctes:
        head, rest = ("WITH RECURSIVE ", body[len("WITH RECURSIVE "):]) if body.upper().startswith(
            "WITH RECURSIVE ") else ("WITH ", body[5:] if body.upper().startswith("WITH ") else "")
        body = head + ",\n".join(ctes) + (",\n" + rest if rest else "\n" + body)
    names = "|".join(sorted(TABLES | set(VIEWS)))
    return re.sub(rf"@({names})\b", r"\1", body)
