"""Job-ledger, counter and display queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import display as D
from larder.operators import ledger as L
from larder.operators import links as K
from larder.operators.ordered import floored_counter
from larder.plans import duck as Q
from larder.plans.catalog import DECODED, recipes
from larder.plans.registry import query

NOW = "2024-01-20 00:00:00"
SQL_NOW = f"TIMESTAMP '{NOW}'"
AGE = "(epoch_us({now}) - epoch_us({c})) / 1000000.0"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def deltas(src):
    e = src("events")
    return e.select("user_id", "event_id", "ts", F.when(F.col("event_type") == "purchase", 1).when(
        F.col("event_type") == "error", -1).otherwise(0).alias("d"))


@query("w5_floored_counter", """
WITH d AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS d FROM events),
s AS (SELECT *, sum(d) OVER w AS s, last_value(CASE WHEN d > 0 THEN ts END IGNORE NULLS) OVER w AS up FROM d
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS c FROM s)
SELECT event_id, user_id, CAST(c AS BIGINT) AS cooked_count, CASE WHEN c > 0 THEN up END AS last_cooked_at FROM m""")
def _(src):
    return floored_counter(deltas(src), ["user_id"], ["ts", "event_id"], "d", "ts").drop("d", "ts")


@query("w4_next_job", f"""
WITH c AS (SELECT * FROM @jobs_v WHERE status = 'pending' ORDER BY created_at, id LIMIT 5)
SELECT id, url FROM c WHERE {AGE.format(now=SQL_NOW, c='updated_at')} >= CASE WHEN attempts = 0 THEN 0 ELSE [5, 30, 120][least(attempts, 3)] END
ORDER BY created_at, id LIMIT 1""")
def _(src):
    return L.next_job(src("jobs_v"), now()).select("id", "url")


@query("l1_enqueue", f"WITH {Q.identity_key('@links_v', 'url', 'identity_key')}" + """,
o AS (SELECT DISTINCT regexp_replace(replace(url, 'www.', ''), '/$', '') AS k FROM @jobs_v WHERE status IN ('pending', 'running')),
st AS (SELECT identity_key FROM u_key WHERE identity_key IN (SELECT source_url FROM @recipes_v WHERE source_url IS NOT NULL)
  OR url IN (SELECT source_url FROM @recipes_v WHERE source_url IS NOT NULL))
SELECT id, CASE WHEN identity_key IS NULL THEN 'rejected' WHEN identity_key IN (SELECT identity_key FROM st WHERE identity_key IS NOT NULL) THEN 'saved'
  WHEN identity_key IN (SELECT k FROM o) THEN 'attached'
  WHEN row_number() OVER (PARTITION BY identity_key ORDER BY submitted_at, id) = 1 THEN 'created' ELSE 'attached' END AS outcome FROM u_key""")
def _(src):
    keyed = K.with_identity_key(src("links_v"))
    jobs = K.with_identity_key(src("jobs_v"), "url", "job_key")
    return L.enqueue(keyed, src("recipes_v"), jobs, "identity_key", "source_url", "job_key",
                     "url", "id", "submitted_at").select("id", "outcome")


def job_events(src):
    """Job history per user: sign-ups submit, views claim, and so on."""
    kind = (F.when(F.col("event_type") == "signup", "submit").when(F.col("event_type") == "view", "claim")
            .when(F.col("event_type") == "purchase", "succeed").when(F.col("event_type") == "error", "fail")
            .when(F.col("event_id") % 3 == 0, "not_recipe").when(F.col("event_id") % 3 == 1, "fail_permanent")
            .otherwise("submit"))
    return src("events").select("user_id", "ts", "event_id", kind.alias("event"))


SQL_EVENTS = """ev AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'succeed' WHEN 'error' THEN 'fail'
  ELSE CASE event_id % 3 WHEN 0 THEN 'not_recipe' WHEN 1 THEN 'fail_permanent' ELSE 'submit' END END AS event,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""


@query("l2_job_states", f"""WITH RECURSIVE {SQL_EVENTS},
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, 'none' AS status, 0 AS attempts FROM ev
  UNION ALL SELECT r.user_id, e.n, CASE WHEN event = 'submit' AND status NOT IN ('pending', 'running') THEN 'pending'
    WHEN event = 'claim' AND status = 'pending' THEN 'running' WHEN status = 'running' AND event = 'succeed' THEN 'done'
    WHEN status = 'running' AND event = 'not_recipe' THEN 'not_recipe' WHEN status = 'running' AND event = 'fail_permanent' THEN 'failed'
    WHEN status = 'running' AND event = 'fail' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE status END,
  CASE WHEN event = 'submit' AND status NOT IN ('pending', 'running') THEN 0 WHEN event = 'claim' AND status = 'pending' THEN attempts + 1 ELSE attempts END
  FROM r JOIN ev e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, status, attempts, n AS events FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""")
def _(src):
    return L.replay(job_events(src), "user_id", ["ts", "event_id"])


@query("l3_retry_eligibility", f"""SELECT id, CASE WHEN attempts = 0 THEN 0 ELSE [5, 30, 120][least(attempts, 3)] END AS cooldown_seconds,
  status = 'pending' AND {AGE.format(now=SQL_NOW, c='updated_at')} >= CASE WHEN attempts = 0 THEN 0 ELSE [5, 30, 120][least(attempts, 3)] END AS eligible FROM @jobs_v""")
def _(src):
    return L.with_eligibility(src("jobs_v"), now()).select("id", "cooldown_seconds", "eligible")


STALE = f"status = 'running' AND {AGE.format(now=SQL_NOW, c='updated_at')} > 900"


@query("l4_reclaimed_leases", f"SELECT id, CASE WHEN {STALE} THEN 'pending' ELSE status END AS status, CASE WHEN {STALE} THEN NULL ELSE stage END AS stage FROM @jobs_v")
def _(src):
    return L.reclaim_stale(src("jobs_v"), now()).select("id", "status", "stage")


@query("a7_reclaimed_count", f"SELECT count(*) AS reclaimed FROM @jobs_v WHERE {STALE}")
def _(src):
    # The write itself counts what it changes: the jobs are read once.
    return L.changed_rows(L.reclaim_stale(src("jobs_v"), now(), flag="reclaimed"), "reclaimed")


@query("l5_startup_requeue", "SELECT id, CASE status WHEN 'running' THEN 'pending' ELSE status END AS status, CASE status WHEN 'running' THEN NULL ELSE stage END AS stage FROM @jobs_v")
def _(src):
    return L.requeue_running(src("jobs_v")).select("id", "status", "stage")


@query("l6_claim", """WITH c AS (SELECT id FROM @jobs_v WHERE attempts < 2)
SELECT j.id, CASE WHEN t THEN 'running' ELSE status END AS status, CASE WHEN t THEN 'fetching' ELSE stage END AS stage, CASE WHEN t THEN NULL ELSE error END AS error,
  attempts + CASE WHEN t THEN 1 ELSE 0 END AS attempts FROM (SELECT *, status = 'pending' AND id IN (SELECT id FROM c) AS t FROM @jobs_v) j""")
def _(src):
    jobs = src("jobs_v")
    return L.claim(jobs, jobs.where(F.col("attempts") < 2)).select("id", "status", "stage", "error", "attempts")


@query("l7_timed_out", f"SELECT id, status NOT IN ('done', 'failed', 'not_recipe') AND {AGE.format(now=SQL_NOW, c='created_at')} >= 180 AS timed_out FROM @jobs_v")
def _(src):
    return src("jobs_v").select("id", (
        ~D.is_terminal(F.col("status")) & L.timed_out(F.col("created_at"), now())).alias("timed_out"))


@query("l8_stage_changes", """WITH s AS (SELECT *, lag(stage) OVER (PARTITION BY url ORDER BY created_at, id) AS before FROM @jobs_v
  WHERE stage IS NOT NULL AND status IN ('pending', 'running')) SELECT id, url, stage FROM s WHERE stage IS DISTINCT FROM before""")
def _(src):
    return L.stage_changes(src("jobs_v"), "url", ["created_at", "id"]).select("id", "url", "stage")


@query("l10_messages", """SELECT id, substr(trim(split_part(error, chr(10), 1)), 1, 160) AS first_line,
  CASE WHEN error IS NOT NULL THEN CASE WHEN status = 'failed' THEN substr(error, 1, 400) ELSE 'Something went wrong while importing that link.' END END AS message FROM @jobs_v""")
def _(src):
    return L.with_messages(src("jobs_v"), F.col("status") == "failed").select("id", "first_line", "message")


@query("l11_failure_classes", """SELECT job_id, status, status IN (429, 500, 503, 504) AS retryable, CASE WHEN status < 400 THEN NULL WHEN status = 409 THEN 'conflict'
  WHEN status IN (401, 404) THEN 'fatal' WHEN status = 429 THEN 'rate_limited' ELSE 'transient' END AS transport FROM @http_v""")
def _(src):
    return L.classify_failures(src("http_v"))


@query("f12_message_routing", r"""WITH m AS (SELECT *, coalesce(trim(text), '') AS t FROM @messages_v),
h AS (SELECT *, lower(split_part(regexp_extract(t, '^/\S*', 0), '@', 1)) AS head, regexp_extract(t, '(?i)https?://[^\s<>"''`]+', 0) AS u FROM m)
SELECT update_id, CASE WHEN kind <> 'message' THEN 'ignored' WHEN head = '/id' THEN 'command' WHEN chat_id <> '42' THEN 'dropped' WHEN head <> '' THEN 'command'
  WHEN t = '' THEN 'ignored' WHEN reply_to_bot_msg IN (SELECT message_id FROM @failed_imports_v) THEN 'retry_with_text' WHEN u <> '' THEN 'import'
  WHEN reply_to_bot_msg IS NOT NULL THEN 'lost_context' ELSE 'nudge' END AS action, nullif(head, '') AS command,
  nullif(regexp_replace(u, '[),.;:!?''"»”]+$', ''), '') AS first_url FROM h""")
def _(src):
    routed = L.route_messages(src("messages_v"), src("failed_imports_v"), "42")
    return routed.select("update_id", "action", "command", "first_url")


MINUTES = "CASE WHEN total_minutes > 0 THEN CASE WHEN total_minutes < 60 THEN total_minutes || ' min' WHEN total_minutes % 60 = 0 THEN (total_minutes // 60) || ' h' ELSE (total_minutes // 60) || ' h ' || (total_minutes % 60) END END"


@query("d1_minutes_label", f"SELECT id, {MINUTES} AS label FROM @recipes_v")
def _(src):
    return src("recipes_v").select("id", D.minutes_label(F.col("total_minutes")).alias("label"))


@query("d2_catalog_cards", f"""WITH {DECODED}, e AS (SELECT *, CAST(extraction AS JSON) AS x, trim(source_author) AS a FROM r)
SELECT id, concat_ws(' · ', '⏱️ ' || {MINUTES}, '🍽️ ' || servings, CASE source_platform WHEN 'instagram' THEN '📷' WHEN 'tiktok' THEN '🎵' WHEN 'youtube' THEN '▶️'
  WHEN 'web' THEN '🌐' ELSE '✍️' END || ' ' || CASE WHEN starts_with(a, '@') THEN a ELSE '@' || a END) AS meta,
  len(ing) || ' ingredient' || CASE len(ing) WHEN 1 THEN '' ELSE 's' END || ' · ' || len(steps) || ' step' || CASE len(steps) WHEN 1 THEN '' ELSE 's' END AS counts,
  CASE source_platform WHEN 'instagram' THEN 'Instagram' WHEN 'tiktok' THEN 'TikTok' WHEN 'youtube' THEN 'YouTube' WHEN 'web' THEN 'Web' ELSE 'By hand' END AS platform,
  CASE WHEN x IS NULL THEN '' ELSE concat_ws(', ', CASE x ->> '$.tiers[0]' WHEN 'tier0:json-ld' THEN 'Read straight from the page''s recipe data'
    WHEN 'tier1:instagram-embed' THEN 'Read from the Instagram caption' WHEN 'tier1:tiktok-oembed' THEN 'Read from the TikTok caption' ELSE 'Read from the YouTube description' END,
    CASE WHEN (x ->> '$.tiers[1]') IS NOT NULL THEN 'plus the spoken audio' END, 'structured by ' || (x ->> '$.model')) || ' · ' ||
    CAST(CAST(floor(CAST(x ->> '$.confidence' AS DOUBLE) * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% confident' END AS provenance FROM e""")
def _(src):
    c = F.col
    return recipes(src).select(
        "id", D.meta_line(c("total_minutes"), c("servings"), c("source_author"), c("source_platform")).alias("meta"),
        D.counts_line(c("ingredients"), c("steps")).alias("counts"), D.platform_label(c("source_platform")).alias("platform"),
        D.describe_extraction(c("extraction")).alias("provenance"))


REL = lambda c: f"""CASE WHEN ms < 60000 THEN 'just now' WHEN ms < 3600000 THEN CAST(CAST(floor(ms / 60000) AS BIGINT) AS VARCHAR) || ' min ago'
  WHEN ms < 86400000 THEN CAST(CAST(floor(ms / 3600000) AS BIGINT) AS VARCHAR) || 'h ago' WHEN floor(ms / 86400000) = 1 THEN 'yesterday'
  WHEN floor(ms / 86400000) < 30 THEN CAST(CAST(floor(ms / 86400000) AS BIGINT) AS VARCHAR) || ' days ago' ELSE strftime({c}, '%-d %b %Y') END"""  # noqa: E731


@query("d3_relative_times", f"SELECT event_id, {REL('ts')} AS age FROM (SELECT *, floor((epoch_us({SQL_NOW}) - epoch_us(ts)) / 1000.0) AS ms FROM events) e")
def _(src):
    return src("events").select("event_id", D.relative_time(F.col("ts"), now()).alias("age"))


@query("d4_monograms", """WITH h AS (SELECT p_partkey, p_name, list_reduce(list_concat([CAST(2166136261 AS BIGINT)],
  list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS hash FROM part)
SELECT p_partkey, hash, ['#b4472a', '#8a5a2b', '#4f6d3a', '#2f6b6b', '#7a3f63', '#9b6a1f', '#3f5a86', '#7c4a2d'][hash % 8 + 1] AS color,
  upper(substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) AS initials FROM h""")
def _(src):
    n = F.col("p_name")
    return src("part").select("p_partkey", D.fnv1a(n).alias("hash"), D.monogram_color(n).alias("color"),
                                      D.monogram_initials(n).alias("initials"))


@query("d5_job_display", f"""SELECT id, CASE status WHEN 'pending' THEN 'Queued…' WHEN 'done' THEN 'Done.' WHEN 'not_recipe' THEN 'That didn''t look like a recipe.' WHEN 'failed' THEN 'That import didn''t work.'
  ELSE CASE stage WHEN 'fetching' THEN 'Fetching the caption…' WHEN 'transcribing' THEN 'Listening to the audio…' WHEN 'structuring' THEN 'Writing it up…' ELSE 'Working on it…' END END AS message,
  CASE status WHEN 'done' THEN 1.0 WHEN 'pending' THEN 0.08 ELSE CASE stage WHEN 'fetching' THEN 0.3 WHEN 'transcribing' THEN 0.6 WHEN 'structuring' THEN 0.85 ELSE 0.18 END END::DOUBLE AS progress,
  status IN ('done', 'failed', 'not_recipe') AS terminal, {AGE.format(now=SQL_NOW, c='created_at')} >= 180 AS timed_out,
  CASE WHEN status IN ('pending', 'running') THEN 'keep-polling' WHEN status = 'done' AND recipe_id IS NOT NULL THEN 'done' WHEN status IN ('failed', 'not_recipe') THEN 'retry-with-text' ELSE 'failed' END AS decision,
  CASE status WHEN 'done' THEN '✅' WHEN 'failed' THEN '⚠️' WHEN 'not_recipe' THEN '🤔' ELSE '⏳' END AS glyph, status IN ('failed', 'not_recipe') AS can_retry_with_text FROM @jobs_v""")
def _(src):
    s, g = F.col("status"), F.col("stage")
    return src("jobs_v").select(
        "id", D.stage_message(s, g).alias("message"), D.stage_progress(s, g).alias("progress"), D.is_terminal(s).alias("terminal"),
        L.timed_out(F.col("created_at"), now()).alias("timed_out"), D.poll_decision(s, F.col("recipe_id")).alias("decision"),
        D.status_glyph(s).alias("glyph"), D.can_retry_with_text(s).alias("can_retry_with_text"))


@query("d6_cooked_labels", f"""SELECT id, CASE WHEN cooked_count <= 0 THEN 'Not cooked yet' ELSE 'Cooked ' || cooked_count || '×' || coalesce(' · last ' || {REL('last_cooked_at')}, '') END AS label
FROM (SELECT *, floor((epoch_us({SQL_NOW}) - epoch_us(last_cooked_at)) / 1000.0) AS ms FROM @recipes_v) r""")
def _(src):
    return src("recipes_v").select("id", D.cooked_line(
        F.col("cooked_count"), D.relative_time(F.col("last_cooked_at"), now())).alias("label"))


@query("d6_folder_summaries", """SELECT l.recipe_id, string_agg(CASE WHEN f.emoji IS NULL THEN f.name ELSE f.emoji || ' ' || f.name END, ' · ' ORDER BY f.name) AS summary
FROM @folder_links_v l JOIN @folders_v f ON f.id = l.folder_id GROUP BY l.recipe_id""")
def _(src):
    named = src("folders_v").select(F.col("id").alias("folder_id"), F.struct(
        "name", D.folder_label(F.col("name"), F.col("emoji")).alias("label")).alias("f"))
    grouped = src("folder_links_v").join(named, "folder_id").groupBy("recipe_id").agg(
        F.array_sort(F.collect_set("f")).alias("fs"))
    return grouped.select("recipe_id", F.array_join("fs.label", " · ").alias("summary"))
