"""Job ledger in batch: eligibility, leases, claims, state replay, routing of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from larder.functions.text import first_line, let, trim
from larder.functions.urls import extract_urls
from larder.operators import ordered
from larder.operators.ordered import previous_value
from larder.session import materialise

# Retry and lease policy.
BACKOFF_SECONDS = (5, 30, 120)
LEASE_SECONDS = 15 * 60
POLL_SECONDS = 180
MAX_ATTEMPTS = 3
CANDIDATES = 5
MAX_ERROR_CHARS = 400
GENERIC_ERROR = "Something went wrong while importing that link."
RETRYABLE = (429, 500, 503, 504)

# States of a job are numbered status * base + attempts, attempts from MAX_ATTEMPTS on being
# alike: none of them is retried. Their whole number is counted beside the state.
STATUSES = ("none", "pending", "running", "done", "not_recipe", "failed")
BASE = MAX_ATTEMPTS + 1
STATES = len(STATUSES) * BASE
# Event that takes up a stored record.
RESUME = "resume"


def cooldown_seconds(attempts: Column) -> Column:
    """Wait after a failed attempt, by attempts used; the last value repeats."""
    index = F.greatest(F.lit(1), F.least(attempts, F.lit(len(BACKOFF_SECONDS)))).cast("int")
    return F.element_at(F.array(*[F.lit(s) for s in BACKOFF_SECONDS]), index)


def _age(now: Column, since: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / F.lit(1e6)


def with_eligibility(jobs: DataFrame, now: Column) -> DataFrame:
    """Pending jobs that have waited out their cooldown; a first attempt never waits."""
    wait = F.when(F.col("attempts") > 0, cooldown_seconds(F.col("attempts"))).otherwise(F.lit(0))
    return jobs.withColumns({
        "cooldown_seconds": wait,
        "eligible": (F.col("status") == "pending") & (_age(now, F.col("updated_at")) >= wait)})


def next_job(jobs: DataFrame, now: Column) -> DataFrame:
    """First eligible of the five oldest pending jobs.

    The five are cut before eligibility is looked at; the two filters do not commute.
    """
    oldest = jobs.where(F.col("status") == "pending").orderBy("created_at", "id").limit(CANDIDATES)
    return with_eligibility(oldest, now).where("eligible").orderBy("created_at", "id").limit(1)


def reclaim_stale(jobs: DataFrame, now: Column, flag: str | None = None) -> DataFrame:
    """Running jobs untouched for longer than the lease go back to pending; ``flag`` names a column that marks them."""
    stale = (F.col("status") == "running") & (_age(now, F.col("updated_at")) > LEASE_SECONDS)
    return _requeue(jobs, stale, flag)


def requeue_running(jobs: DataFrame, flag: str | None = None) -> DataFrame:
    """After a restart nothing can be running: every such job is pending again."""
    return _requeue(jobs, F.col("status") == "running", flag)


def _requeue(jobs: DataFrame, which: Column, flag: str | None) -> DataFrame:
    return jobs.withColumns({
        "status": F.when(which, F.lit("pending")).otherwise(F.col("status")),
        "stage": F.when(~which, F.col("stage")),
        **({flag: F.coalesce(which, F.lit(False))} if flag else {})})


def changed_rows(changed: DataFrame, flag: str) -> DataFrame:
    """Write a changed table and return how many rows its ``flag`` marks, counted by the write itself.

    The new version is what the shared folder keeps; the count comes with it, from one scan.
    """
    seen = Observation()
    observed = changed.observe(seen, F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0)).alias(flag))
    materialise(observed.drop(flag), "changed")
    return changed.sparkSession.createDataFrame([(seen.get[flag],)], f"`{flag}` long")


def claim(jobs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Compare-and-set: chosen jobs that are still pending start running."""
    marked = jobs.join(chosen.select("id", F.lit(True).alias("_chosen")), "id", "left")
    take = F.coalesce(F.col("_chosen"), F.lit(False)) & (F.col("status") == "pending")
    return marked.withColumns({
        "status": F.when(take, F.lit("running")).otherwise(F.col("status")),
        "stage": F.when(take, F.lit("fetching")).otherwise(F.col("stage")),
        "error": F.when(~take, F.col("error")),
        "attempts": F.col("attempts") + take.cast("int"),
    }).select(*jobs.columns)


def timed_out(started: Column, now: Column) -> Column:
    return _age(now, started) >= POLL_SECONDS


def stage_changes(events: DataFrame, job: str, order: list[str], chunks: int | None = None) -> DataFrame:
    """Only the events whose stage differs from the last one announced for the job."""
    staged = events.where(F.col("stage").isNotNull() & F.col("status").isin("pending", "running"))
    seen = previous_value(staged, [job], order, "stage", "_before", chunks)
    return seen.where(~F.col("stage").eqNullSafe(F.col("_before"))).drop("_before")


def transition(state: Column, event: Column) -> Column:
    """Next state of a job.

    A finished job is only left by a new submission, which starts over. A failed
    attempt is retried until the attempts are used up or the failure is permanent.
    """
    attempts = state % BASE
    is_ = lambda name: F.floor(state / F.lit(BASE)) == STATUSES.index(name)
    to = lambda name: F.lit(STATUSES.index(name) * BASE)
    idle = ~(is_("pending") | is_("running"))
    retry = F.when(attempts >= MAX_ATTEMPTS, to("failed") + attempts).otherwise(to("pending") + attempts)
    nxt = (
        F.when((event == "submit") & idle, to("pending"))
        .when((event == "claim") & is_("pending"), to("running") + F.least(attempts + 1, F.lit(MAX_ATTEMPTS)))
        .when((event == "succeed") & is_("running"), to("done") + attempts)
        .when((event == "not_recipe") & is_("running"), to("not_recipe") + attempts)
        .when((event == "fail") & is_("running"), retry)
        .when((event == "fail_permanent") & is_("running"), to("failed") + attempts)
        .when((event == "expire") & is_("running"), to("pending") + attempts)
        .otherwise(state))
    return nxt.cast("int")


class Jobs(ordered.Machine):
    """Jobs: state, attempts since the last submission, when submitted and when last changed.

    A record: ``s``; ``n`` attempts, of a whole job where ``whole`` is set, else those to be
    added; ``created`` and ``updated``, null where unknown. A ``resume`` event carries such
    facts in ``held``.
    """

    states = STATES
    HELD = "struct<s:int,n:bigint,created:timestamp,updated:timestamp>"
    FIELDS = ("event", "held")

    def start(self, state: Column) -> Column:
        none = F.lit(None).cast("timestamp")
        return F.struct(state.cast("int").alias("s"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("whole"),
                        none.alias("created"), none.alias("updated"))

    def step(self, record: Column, event: Column) -> Column:
        taken, name, at = event["event"] == RESUME, event["event"], event["ts"].cast("timestamp")

        def after(state: Column) -> Column:
            moved = state != record["s"]
            submitted = moved & (name == "submit")
            n = F.when(submitted, F.lit(0)).otherwise(record["n"] + (moved & (name == "claim")).cast("int")).cast("long")
            held = event["held"]
            return F.when(taken, F.struct(
                held["s"].alias("s"), held["n"].alias("n"), F.lit(True).alias("whole"), held["created"].alias("created"),
                held["updated"].alias("updated"))).otherwise(F.struct(
                    state.alias("s"), n.alias("n"), (record["whole"] | submitted).alias("whole"),
                    F.when(submitted, at).otherwise(record["created"]).alias("created"),
                    F.when(moved, at).otherwise(record["updated"]).alias("updated")))

        return let(transition(record["s"], name), after)

    def join(self, a: Column, b: Column) -> Column:
        return F.struct(
            b["s"].alias("s"), F.when(b["whole"], b["n"]).otherwise(a["n"] + b["n"]).alias("n"),
            (a["whole"] | b["whole"]).alias("whole"), F.coalesce(b["created"], a["created"]).alias("created"),
            F.coalesce(b["updated"], a["updated"]).alias("updated"))


def plain_events(events: DataFrame) -> DataFrame:
    """Events as ``Jobs`` takes them."""
    return events.withColumn("held", F.lit(None).cast(Jobs.HELD))


def replay(events: DataFrame, job: str, order: list[str], chunks: int | None = None) -> DataFrame:
    """Current status and attempts of every job from its whole event history."""
    events, fields = plain_events(events), Jobs.FIELDS
    if "ts" not in order:
        # Times are not asked for here.
        events, fields = events.withColumn("ts", F.lit(None).cast("timestamp")), (*fields, "ts")
    final = ordered.replay(events, [job], order, fields, Jobs(), chunks)
    return final.select(job, status_of(F.col("record.s")).alias("status"), F.col("record.n").cast("int").alias("attempts"), "events")


def status_of(state: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STATUSES]), F.floor(state / F.lit(BASE)).cast("int"))


def retry_due(record: Column) -> Column:
    """When a failed attempt may be tried again; null for a job that waits for nothing."""
    waits = (status_of(record["s"]) == "pending") & (record["n"] > 0)
    return F.when(waits, F.timestamp_micros(F.unix_micros(record["updated"]) + cooldown_seconds(record["n"]) * 1_000_000))


def timeout_due(record: Column) -> Column:
    """When the wait for an unfinished job ends."""
    open_ = status_of(record["s"]).isin("pending", "running")
    return F.when(open_, F.timestamp_micros(F.unix_micros(record["created"]) + F.lit(POLL_SECONDS * 1_000_000)))


def classify_failures(rows: DataFrame) -> DataFrame:
    """What an HTTP status means for the model call and for the chat transport."""
    s = F.col("status")
    return rows.withColumns({
        "retryable": s.isin(*RETRYABLE),
        "transport": F.when(s < 400, F.lit(None).cast("string")).when(s == 409, "conflict")
        .when(s.isin(401, 404), "fatal").when(s == 429, "rate_limited").otherwise("transient")})


def user_message(error: Column, expected: Column) -> Column:
    """Sentence for the user: expected failures speak for themselves, bugs do not."""
    return F.when(expected, F.substring(error, 1, MAX_ERROR_CHARS)).otherwise(F.lit(GENERIC_ERROR))


def with_messages(jobs: DataFrame, expected: Column) -> DataFrame:
    return jobs.withColumns({
        "first_line": first_line(F.col("error")),
        "message": F.when(F.col("error").isNotNull(), user_message(F.col("error"), expected))})


def route_messages(messages: DataFrame, failed: DataFrame, allowed_chat: str) -> DataFrame:
    """What each incoming message asks for; branch order is part of the rule.

    A reply to a known failed import wins over the links it may contain.
    """
    from larder.operators.keyed import lookup

    known = failed.select(F.col("message_id").alias("reply_to_bot_msg"), F.lit(True).alias("_known"))
    text = F.coalesce(trim(F.col("text")), F.lit(""))
    head = F.lower(F.substring_index(F.regexp_extract(text, r"^/\S*", 0), "@", 1))
    urls = extract_urls(text)
    action = (
        F.when(F.col("kind") != "message", "ignored")
        .when(head == "/id", "command")
        .when(F.col("chat_id") != allowed_chat, "dropped")
        .when(head != "", "command")
        .when(text == "", "ignored")
        .when(F.coalesce(F.col("_known"), F.lit(False)), "retry_with_text")
        .when(F.size(urls) > 0, "import")
        .when(F.col("reply_to_bot_msg").isNotNull(), "lost_context")
        .otherwise("nudge"))
    joined = lookup(messages, known, ["reply_to_bot_msg"])
    return joined.select(
        *messages.columns, action.alias("action"),
        F.nullif(head, F.lit("")).alias("command"), F.get(urls, F.lit(0)).alias("first_url"))


def enqueue(submitted: DataFrame, saved: DataFrame, jobs: DataFrame, key: str, saved_key: str,
            job_key: str, url: str, row_id: str, *first: str) -> DataFrame:
    """Outcome of every submission: already saved, attached to an open job, or created.

    Saved is what is stored under the key or under the spelling in which one of
    its submissions came. Among submissions of one key only the earliest
    creates; later ones attach.
    """
    from larder.operators.keyed import attach

    spellings = submitted.where(F.col(key).isNotNull()).select(
        key, F.explode(F.array_distinct(F.array(key, url))).alias("_seen")).distinct()
    stored = spellings.join(saved.select(F.col(saved_key).alias("_seen")), "_seen", "left_semi").select(
        key, F.lit(True).alias("_saved")).distinct()
    opened = jobs.where(F.col("status").isin("pending", "running")).groupBy(
        F.col(job_key).alias(key)).agg(F.max_by("id", F.struct("created_at", "id")).alias("_open"))
    facts = submitted.groupBy(key).agg(
        F.min_by(row_id, F.struct(*first, row_id)).alias("_first"), F.count("*").alias("_n"))
    facts = facts.join(stored, key, "left").join(opened, key, "left")
    joined = attach(submitted, facts, [key], "_n")
    return joined.select(*submitted.columns, F.when(F.col(key).isNull(), "rejected").when(
        F.col("_saved"), "saved").when(F.col("_open").isNotNull(), "attached").when(
        F.col("_first") == F.col(row_id), "created").otherwise("attached").alias("outcome"))
