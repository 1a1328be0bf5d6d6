"""Streaming queries: each runs the whole events table through a stream and reads the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.urls import canonical_url
from larder.operators import ledger as L
from larder.operators.links import with_identity_key
from larder.plans import duck as Q
from larder.plans.ledger import SQL_EVENTS, job_events
from larder.plans.registry import ORACLES, query
from larder.sources import sinks
from larder.session import scratch_path
from larder.streaming import jobs as S

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _events(src):
    """A source whose events table is a stream."""
    stream = S.event_stream(src.spark, src.folder, "events", EVENT_SCHEMA)
    return lambda name: stream if name == "events" else src(name)


def _job_stream(src):
    e = job_events(_events(src))
    return e.select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event")


@query("l2_job_states_stream", ORACLES["l2_job_states"].replace(", n AS events FROM r QUALIFY", " FROM r QUALIFY"))
def _(src):
    state, _ = S.job_states(_job_stream(src)).run().result()
    return S.current(state).withColumnRenamed("job", "user_id")


@query("l4_reclaimed_leases_stream", f"""WITH RECURSIVE {SQL_EVENTS.replace("AS n FROM events", "AS n, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events")},
wm AS (SELECT max(ts) - INTERVAL 15 MINUTE AS w FROM events),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, 'none' AS status, 0 AS attempts, CAST(NULL AS TIMESTAMP) AS reclaimed_at FROM ev
  UNION ALL SELECT user_id, n, CASE WHEN rec IS NOT NULL THEN 'pending' ELSE status END, attempts, rec FROM (
  SELECT *, CASE WHEN status = 'running' AND ((nxt IS NOT NULL AND nxt - ts > INTERVAL 15 MINUTE) OR (nxt IS NULL AND ts + INTERVAL 15 MINUTE <= (SELECT w FROM wm))) THEN ts + INTERVAL 15 MINUTE END AS rec FROM (
  SELECT r.user_id, e.n, e.ts, e.nxt, CASE WHEN event = 'submit' AND status NOT IN ('pending', 'running') THEN 'pending'
    WHEN event = 'claim' AND status = 'pending' THEN 'running' WHEN status = 'running' AND event = 'succeed' THEN 'done'
    WHEN status = 'running' AND event = 'not_recipe' THEN 'not_recipe' WHEN status = 'running' AND event = 'fail_permanent' THEN 'failed'
    WHEN status = 'running' AND event = 'fail' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status,
  CASE WHEN event = 'submit' AND status NOT IN ('pending', 'running') THEN 0 WHEN event = 'claim' AND status = 'pending' THEN attempts + 1 ELSE attempts END AS attempts
  FROM r JOIN ev e ON e.user_id = r.user_id AND e.n = r.n + 1) s) t)
SELECT user_id, attempts, CAST(epoch_us(reclaimed_at) AS BIGINT) AS at_micros FROM r WHERE reclaimed_at IS NOT NULL""")
def _(src):
    _, out = S.job_states(_job_stream(src), S.LEASE_SECONDS).run().result()
    return _reached(out)


def _reached(out):
    return out.select(F.col("job").alias("user_id"), F.col("attempts").cast("int").alias("attempts"), F.unix_micros("at").alias("at_micros"))


# Every event of a job with what is known of it afterwards, and when its next event comes.
JOURNAL = f"""{SQL_EVENTS.replace("AS n FROM events", "AS n, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events")},
wm AS (SELECT max(ts) - INTERVAL 15 MINUTE AS w FROM events),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, 'none' AS status, 0 AS attempts, CAST(NULL AS TIMESTAMP) AS created, CAST(NULL AS TIMESTAMP) AS updated, CAST(NULL AS TIMESTAMP) AS nxt FROM ev
  UNION ALL SELECT user_id, n, now, CASE WHEN now = 'pending' AND event = 'submit' AND was <> now THEN 0 WHEN now = 'running' AND was = 'pending' THEN attempts + 1 ELSE attempts END,
    CASE WHEN event = 'submit' AND was <> now THEN ts ELSE created END, CASE WHEN was <> now THEN ts ELSE updated END, nxt FROM (
  SELECT r.user_id, e.n, e.ts, e.nxt, e.event, r.status AS was, r.attempts, r.created, r.updated, CASE WHEN event = 'submit' AND status NOT IN ('pending', 'running') THEN 'pending'
    WHEN event = 'claim' AND status = 'pending' THEN 'running' WHEN status = 'running' AND event = 'succeed' THEN 'done'
    WHEN status = 'running' AND event = 'not_recipe' THEN 'not_recipe' WHEN status = 'running' AND event = 'fail_permanent' THEN 'failed'
    WHEN status = 'running' AND event = 'fail' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS now
  FROM r JOIN ev e ON e.user_id = r.user_id AND e.n = r.n + 1) s)"""


@query("l3_retry_due_stream", f"""WITH RECURSIVE {JOURNAL},
d AS (SELECT user_id, attempts, nxt, updated + to_seconds(CASE attempts WHEN 1 THEN 5 WHEN 2 THEN 30 ELSE 120 END) AS due FROM r WHERE status = 'pending' AND attempts > 0)
SELECT DISTINCT user_id, attempts, CAST(epoch_us(due) AS BIGINT) AS at_micros FROM d WHERE due <= coalesce(nxt, (SELECT w FROM wm))""")
def _(src):
    _, out = S.timers(_job_stream(src), L.retry_due).run().result()
    return _reached(out)


@query("l7_timed_out_stream", f"""WITH RECURSIVE {JOURNAL},
d AS (SELECT user_id, attempts, nxt, created + INTERVAL 180 SECOND AS due FROM r WHERE status IN ('pending', 'running')),
f AS (SELECT user_id, due, attempts, nxt, row_number() OVER (PARTITION BY user_id, due ORDER BY nxt NULLS LAST) AS k FROM d WHERE due <= coalesce(nxt, (SELECT w FROM wm)))
SELECT user_id, attempts, CAST(epoch_us(due) AS BIGINT) AS at_micros FROM f WHERE k = 1""")
def _(src):
    _, out = S.timers(_job_stream(src), L.timeout_due).run().result()
    return _reached(out)


@query("l8_stage_changes_stream", """WITH j AS (SELECT event_id, user_id, ts, CASE event_id % 4 WHEN 0 THEN 'fetching' WHEN 1 THEN 'transcribing' WHEN 2 THEN 'structuring' END AS stage
  FROM events WHERE event_type = 'view'), s AS (SELECT *, lag(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM j WHERE stage IS NOT NULL)
SELECT event_id, user_id, stage FROM s WHERE stage IS DISTINCT FROM before""")
def _(src):
    k = F.col("event_id") % 4
    staged = _events(src)("events").where(F.col("event_type") == "view").select(
        F.col("user_id").alias("job"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(k == 0, "fetching").when(k == 1, "transcribing").when(k == 2, "structuring").alias("stage"))
    _, out = S.stage_changes(staged).run().result()
    return out.select("event_id", F.col("job").alias("user_id"), "stage")


@query("l9_floored_counter_stream", f"""WITH w AS ({ORACLES['w5_floored_counter']})
SELECT w.user_id, w.cooked_count, CAST(epoch_us(w.last_cooked_at) AS BIGINT) AS last_micros FROM w JOIN events e ON e.event_id = w.event_id
QUALIFY row_number() OVER (PARTITION BY w.user_id ORDER BY e.ts DESC, e.event_id DESC) = 1""")
def _(src):
    from larder.plans.ledger import deltas

    d = deltas(_events(src)).select(
        F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "d")
    last, _ = S.floored_counts(d).run().result()
    return last.select(F.col("job").alias("user_id"), "cooked_count", F.unix_micros("last_cooked_at").alias("last_micros"))


@query("l1_enqueue_stream", f"WITH {Q.identity_key('@links_v', 'url', 'identity_key')}" + """,
o AS (SELECT DISTINCT regexp_replace(replace(url, 'www.', ''), '/$', '') AS k FROM @jobs_v WHERE status IN ('pending', 'running'))
SELECT DISTINCT identity_key FROM u_key WHERE identity_key IS NOT NULL AND identity_key NOT IN (SELECT source_url FROM @recipes_v WHERE source_url IS NOT NULL)
  AND identity_key NOT IN (SELECT k FROM o)""")
def _(src):
    from larder.plans.adapters import view_over

    links = view_over(src.spark, "links_v", {"events": _events(src)("events")})
    keyed = links.select(canonical_url(F.col("url")).alias("identity_key"))
    jobs = with_identity_key(src("jobs_v"), "url", "job_key")
    return S.enqueue(keyed, src("recipes_v"), jobs, "identity_key", "source_url", "job_key")


@query("s8_partition_overwrite", "SELECT doc_id, lang, source FROM documents")
def _(src):
    path = scratch_path(src.spark, "by-lang")
    rows = src("documents").select("doc_id", "lang", "source")
    sinks.overwrite_partitions(rows, path, "lang")
    # Writing the same partitions again replaces them.
    sinks.overwrite_partitions(rows, path, "lang")
    return src.spark.read.parquet(path).select("doc_id", "lang", "source")


@query("s9_published_tables", """SELECT 'link' AS kind, CAST(recipe_id AS VARCHAR) AS row_id, folder_id AS value FROM @folder_links_v
UNION ALL SELECT 'line', id, text FROM @grocery_v WHERE NOT checked""")
def _(src):
    root = scratch_path(src.spark, "published")
    lines = src("grocery_v").where(~F.col("checked")).select("id", "text")
    sinks.publish_tables({"links": src("folder_links_v").limit(0), "grocery": lines.limit(0)}, root)
    sinks.publish_tables({"links": src("folder_links_v"), "grocery": lines}, root)
    now = sinks.read_published(src.spark, root, "links", "grocery")
    links = now["links"].select(F.lit("link").alias("kind"), F.col("recipe_id").cast("string").alias("row_id"), F.col("folder_id").alias("value"))
    return links.unionByName(now["grocery"].select(
        F.lit("line").alias("kind"), F.col("id").alias("row_id"), F.col("text").alias("value")))


@query("s7_content_addressed_files", "SELECT DISTINCT substr(sha256(text), 1, 20) || '.txt' AS name FROM documents")
def _(src):
    path = scratch_path(src.spark, "contents")
    sinks.write_content_addressed(src("documents"), "text", path, extension=".txt")
    # A second run finds every content stored already and adds nothing.
    sinks.write_content_addressed(src("documents"), "text", path, src.spark.read.parquet(path), ".txt")
    return src.spark.read.parquet(path).select("name")
