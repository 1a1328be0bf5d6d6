"""Link hygiene queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text as T
from larder.functions import urls as U
from larder.operators import links as L
from larder.operators import redaction
from larder.plans import duck as D
from larder.plans.registry import query

KEYED_PAGES = f"WITH {D.identity_key('pages', 'url', 'identity_key')}"
KEYED_LINKS = f"WITH {D.identity_key('@links_v', 'url', 'identity_key')}"
CLASSIFIED = f"WITH {D.classified('@links_v', 'url')}"


@query("u1_identity_key_pages", KEYED_PAGES + " SELECT page_id, url, identity_key FROM u_key")
def _(src):
    return L.with_identity_key(src("pages").select("page_id", "url"))


@query("u1_identity_key_links", KEYED_LINKS + " SELECT id, identity_key FROM u_key")
def _(src):
    return L.with_identity_key(src("links_v")).select("id", "identity_key")


@query("u2_classify_links", CLASSIFIED +
       " SELECT id, ok, platform, canonical_url, host, post_id, reason FROM c_cls")
def _(src):
    return L.classify_links(src("links_v")).drop("url", "submitted_at")


@query("f9_unsafe_links", CLASSIFIED + """
 SELECT reason, count(*) AS links FROM c_cls WHERE NOT ok GROUP BY reason""")
def _(src):
    return L.split_unsafe(src("links_v"))[1].groupBy("reason").agg(F.count("*").alias("links"))


@query("f10_private_addresses", r"""
WITH n AS (SELECT event_id, ip, regexp_matches(ip, '^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$') AS v4,
  lower(ip) AS s FROM @ips_v),
o AS (SELECT *, CASE WHEN v4 THEN list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT))
  WHEN starts_with(s, '::ffff:') THEN list_transform(string_split(substr(s, 8), '.'), lambda x: CAST(x AS BIGINT)) END AS b FROM n),
p AS (SELECT *, b[1] IN (0, 10, 127) OR (b[1] = 169 AND b[2] = 254) OR (b[1] = 172 AND b[2] BETWEEN 16 AND 31)
  OR (b[1] = 192 AND b[2] IN (168, 0)) OR (b[1] = 100 AND b[2] BETWEEN 64 AND 127)
  OR (b[1] = 198 AND b[2] IN (18, 19)) OR b[1] >= 224 AS inner_range FROM o)
SELECT event_id, ip, CASE WHEN b IS NOT NULL THEN inner_range
  WHEN contains(s, ':') THEN s IN ('::', '::1') OR regexp_matches(s, '^(f[cd]|fe[89ab]|ff)') ELSE true END AS is_private FROM p""")
def _(src):
    return L.private_addresses(src("ips_v"))


@query("u3_links_in_messages", r"""
WITH m AS (SELECT update_id, list_filter(list_transform(regexp_extract_all(text, '(?i)https?://[^\s<>"''`]+'),
  lambda u: regexp_replace(u, '[),.;:!?''"»”]+$', '')), lambda u: regexp_matches(u, '(?i)^https?://')) AS f FROM @messages_v),
x AS (SELECT update_id, unnest(f) AS url, generate_subscripts(f, 1) AS n FROM m),
d AS (SELECT update_id, url, min(n) AS n FROM x GROUP BY update_id, url)
SELECT update_id, CAST(row_number() OVER (PARTITION BY update_id ORDER BY n) - 1 AS INTEGER) AS pos, url FROM d""")
def _(src):
    return L.links_in_text(src("messages_v"), "text", ["update_id"])


@query("u3_message_entities", """SELECT event_id AS update_id, CAST(0 AS INTEGER) AS pos, CASE event_id % 5
  WHEN 0 THEN 'https://a.example.com/r' || user_id WHEN 1 THEN 'https://hidden.example.com/' || user_id WHEN 2 THEN 'https://cap.example.com/' || user_id
  ELSE 'https://plain.example.com/' || user_id END AS url FROM events WHERE event_id % 5 <> 4
UNION ALL SELECT event_id, 1, 'https://b.example.com' FROM events WHERE event_id % 5 = 1""")
def _(src):
    """An emoji before a marked link, a hidden link beside a marked one, a caption, useless marks, no link."""
    k, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    mark = lambda kind, at, n, url=F.lit(None): F.struct(
        F.lit(kind).alias("type"), F.lit(at).alias("offset"), (n if not isinstance(n, int) else F.lit(n)).cast("int").alias("length"),
        url.cast("string").alias("url"))
    first = F.concat(F.lit("https://a.example.com/r"), u)
    rows = src("events").select(
        F.col("event_id").alias("update_id"),
        F.when(k == 0, F.concat(F.lit("🍰🍰 "), first, F.lit("x).")))
        .when(k == 1, F.lit("here and https://b.example.com, https://unmarked.example.com"))
        .when(k == 3, F.concat(F.lit("see (https://plain.example.com/"), u, F.lit(").")))
        .when(k == 4, F.lit("nothing")).alias("text"),
        F.when(k == 2, F.concat(F.lit("dish https://cap.example.com/"), u)).alias("caption"),
        F.when(k == 0, F.array(mark("url", 5, F.length(first))))
        .when(k == 1, F.array(mark("text_link", 0, 4, F.concat(F.lit("https://hidden.example.com/"), u)), mark("url", 9, 22), mark("bold", 0, 4)))
        .when(k == 3, F.array(mark("url", 0, 3))).alias("entities"))
    return L.links_in_messages(rows, ["update_id"])


@query("u4_unique_pages", KEYED_PAGES + """
 SELECT page_id, url, identity_key FROM u_key QUALIFY identity_key IS NULL
  OR row_number() OVER (PARTITION BY identity_key ORDER BY page_id) = 1""")
def _(src):
    keyed = L.with_identity_key(src("pages").select("page_id", "url"))
    return L.unique_by_identity(keyed, "identity_key", "page_id")


@query("u4_link_winners", KEYED_LINKS + """
 SELECT id, identity_key, w AS winner_id, w = id AS is_winner FROM (SELECT *, CASE WHEN identity_key IS NULL THEN id
  ELSE first_value(id) OVER (PARTITION BY identity_key ORDER BY submitted_at, id) END AS w FROM u_key) z""")
def _(src):
    keyed = L.with_identity_key(src("links_v"))
    return L.link_to_winner(keyed, "identity_key", "id", "submitted_at").drop("url", "submitted_at")


@query("u5_display_host", f"WITH {D.url_parts('@links_v', 'url')}" + r"""
 SELECT id, CASE WHEN _scheme = '' OR (_web AND NOT _hostok) THEN '' ELSE regexp_replace(_hostname ||
  CASE WHEN _port = '' THEN '' ELSE ':' || _port END, '^www\.', '') END AS host FROM u_p""")
def _(src):
    return src("links_v").select("id", U.host_of(F.col("url")).alias("host"))


RESOLVED = "WITH " + D.classified("@links_v", "url") + ", " + D.classified("@redirects_v", "final_url", "t") + """,
j AS (SELECT l.id, l.url, l.submitted_at, l.platform, l.post_id AS own, l.canonical_url AS own_url,
  l.post_id IS NULL AND l.platform <> 'web' AS needs, coalesce(t.ok AND t.platform = l.platform AND t.post_id IS NOT NULL, false) AS found,
  t.post_id AS tid, t.canonical_url AS turl FROM c_cls l LEFT JOIN t_cls t ON t.url = l.canonical_url WHERE l.ok),
f AS (SELECT *, CASE WHEN needs THEN CASE WHEN found THEN turl END ELSE own_url END AS final FROM j),
""" + D.identity_key("f", "final", "identity_key", "k")


@query("u6_resolved_shares", RESOLVED + """
SELECT id, platform, CASE WHEN needs AND found THEN tid ELSE own END AS post_id, identity_key,
  needs AND NOT found AS unresolved FROM k_key""")
def _(src):
    return L.resolve_shares(src("links_v"), src("redirects_v")).drop("url", "submitted_at")


SECRETS = ["Ceterum", "password", "ation the", "example.com"]


@query("u7_redacted_documents", "SELECT doc_id, " + "replace(replace(replace(text, 'password', '***'), "
       "'ation the', '***'), 'example.com', '***') AS text FROM documents")
def _(src):
    return src("documents").select("doc_id", T.redact(F.col("text"), SECRETS).alias("text"))


@query("u7_redacted_by_table", """WITH l AS (SELECT list_sort(list_distinct(flatten(list(regexp_extract_all(text, '[A-Za-z]{8,}'))))) AS s FROM benchmark)
SELECT doc_id, list_reduce([text] || s, lambda t, w: replace(t, w, '***')) AS text FROM documents, l""")
def _(src):
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0)))
    secrets = src("benchmark").select(words.alias("secret")).distinct()
    return redaction.redact(src("documents").select("doc_id", "text"), secrets, order="secret")


SAVED = "saved AS (SELECT source_url FROM @recipes_v WHERE source_url IS NOT NULL)"


@query("j7_already_saved", KEYED_LINKS + f""", {SAVED}
 SELECT id, identity_key FROM u_key WHERE identity_key IN (SELECT source_url FROM saved)
  OR url IN (SELECT source_url FROM saved)""")
def _(src):
    keyed = L.with_identity_key(src("links_v"))
    return L.already_saved(keyed, src("recipes_v"), "id", "url", "identity_key", "source_url").select(
        "id", "identity_key")


@query("j7_not_saved", KEYED_LINKS + f""", {SAVED}
 SELECT id FROM u_key WHERE NOT coalesce(identity_key IN (SELECT source_url FROM saved), false)
  AND NOT coalesce(url IN (SELECT source_url FROM saved), false)""")
def _(src):
    keyed = L.with_identity_key(src("links_v"))
    return L.already_saved(
        keyed, src("recipes_v"), "id", "url", "identity_key", "source_url", "left_anti").select("id")


@query("m4_save_if_absent", RESOLVED + """,
sp AS (SELECT identity_key AS k, unnest([identity_key, url]) AS spelling FROM k_key WHERE identity_key IS NOT NULL),
st AS (SELECT k, min(r.id) AS stored FROM sp JOIN @recipes_v r ON r.source_url = sp.spelling GROUP BY k),
w AS (SELECT id, identity_key, CASE WHEN identity_key IS NULL THEN id ELSE
  first_value(id) OVER (PARTITION BY identity_key ORDER BY submitted_at, id) END AS winner FROM k_key)
SELECT id, identity_key, coalesce(stored, winner) AS saved_as, stored IS NULL AND winner = id AS created
FROM w LEFT JOIN st ON st.k = w.identity_key""")
def _(src):
    resolved = L.resolve_shares(src("links_v"), src("redirects_v"))
    return L.save_if_absent(
        resolved, src("recipes_v"), "identity_key", "url", "id", "source_url", "id", "submitted_at",
    ).select("id", "identity_key", "saved_as", "created")
