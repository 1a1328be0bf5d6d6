"""Streams in several triggers and any order of arrival, against a plain replay."""

import datetime as dt
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import ledger as L
from larder.streaming import jobs as S

SCHEMA = "job BIGINT, ts TIMESTAMP, event_id BIGINT, event STRING, stage STRING, d INT"
START = dt.datetime(2024, 1, 1)
YEARS = 10 * 365 * 86400


def events(seed, n=240, jobs=4):
    rng, out, at = random.Random(seed), [], START
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 5, 60, 400, 1200]))
        # The first job has a third of all events.
        job = 0 if i % 3 == 0 else 1 + rng.randrange(jobs - 1)
        out.append((job, at, i, rng.choice(["submit", "claim", "claim", "fail", "succeed", "not_recipe", "fail_permanent"]),
                    rng.choice(["fetching", "structuring", None]), rng.choice([1, -1, -1, 0, 1])))
    return out


def streamed(spark, tmp_path, rows, triggers, seed=0):
    """A folder of files, one per trigger, events dealt out at random."""
    rng, folder = random.Random(seed), tmp_path / "events.parquet"
    parts = [[] for _ in range(triggers)]
    for r in rows:
        parts[rng.randrange(triggers)].append(r)
    for i, part in enumerate(parts):
        path = str(tmp_path / f"part{i}")
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(path)
        folder.mkdir(exist_ok=True)
        for f in (tmp_path / f"part{i}").glob("part-*.parquet"):
            f.rename(folder / f"{i:03d}.parquet")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def step(status, attempts, event):
    if event == "submit" and status not in ("pending", "running"):
        return "pending", 0
    if event == "claim" and status == "pending":
        return "running", attempts + 1
    if status == "running" and event in ("succeed", "not_recipe", "fail_permanent"):
        return {"succeed": "done", "fail_permanent": "failed"}.get(event, event), attempts
    if status == "running" and event == "fail":
        return ("failed" if attempts >= 3 else "pending"), attempts
    return status, attempts


def replayed(rows, lease=None, mark=None):
    state, reclaimed = {}, []
    for job, ts, _, event, *_ in sorted(rows, key=lambda r: (r[1], r[2])):
        status, attempts, since = state.get(job, ("none", 0, ts))
        if lease and status == "running" and ts - since > lease:
            reclaimed.append((job, attempts, since + lease))
            status = "pending"
        state[job] = (*step(status, attempts, event), ts)
    for job, (status, attempts, since) in state.items():
        if lease and status == "running" and mark and since + lease <= mark:
            reclaimed.append((job, attempts, since + lease))
            state[job] = ("pending", attempts, since)
    return {j: (s, a) for j, (s, a, _) in state.items()}, sorted(reclaimed)


@pytest.mark.parametrize("triggers,chunks", [(1, None), (4, 3)])
def test_job_states_and_leases(spark, tmp_path, triggers, chunks):
    rows = events(triggers)
    stream = S.job_states(streamed(spark, tmp_path, rows, triggers), S.LEASE_SECONDS, YEARS, chunks).run()
    state, out = stream.result()
    want, reclaimed = replayed(rows, dt.timedelta(seconds=S.LEASE_SECONDS))
    got = S.current(state).collect()
    assert {r["job"]: (r["status"], r["attempts"]) for r in got} == want
    assert sorted((r["job"], r["attempts"], r["at"]) for r in out.collect()) == reclaimed and reclaimed
    assert stream.rejects().count() == 0


def test_late_events_are_rejected_and_the_rest_is_exact(spark, tmp_path):
    rows = events(9)
    stream = S.job_states(streamed(spark, tmp_path, rows, 4), S.LEASE_SECONDS, 3600).run()
    late = {r["event_id"] for r in stream.rejects().collect()}
    assert 0 < len(late) < len(rows)
    state, out = stream.result()
    mark = max(r[1] for r in rows) - dt.timedelta(seconds=3600)
    want, reclaimed = replayed([r for r in rows if r[2] not in late], dt.timedelta(seconds=S.LEASE_SECONDS), mark)
    got = S.current(state).collect()
    assert {r["job"]: (r["status"], r["attempts"]) for r in got} == want
    assert sorted((r["job"], r["attempts"], r["at"]) for r in out.collect()) == reclaimed


@pytest.mark.parametrize("triggers,delay", [(1, YEARS), (10, YEARS), (3, 3600)])
def test_stage_changes(spark, tmp_path, triggers, delay):
    rows = events(triggers + 20)
    stream = S.stage_changes(streamed(spark, tmp_path, rows, triggers), delay).run()
    late = {r["event_id"] for r in stream.rejects().collect()}
    last, want = {}, []
    for job, ts, i, _, stage, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if i not in late and stage is not None and last.get(job) != stage:
            last[job] = stage
            want.append(i)
    assert sorted(r["event_id"] for r in stream.result()[1].collect()) == sorted(want)
    assert bool(late) == (delay == 3600)


@pytest.mark.parametrize("triggers,delay", [(1, YEARS), (3, 3600)])
def test_floored_counts(spark, tmp_path, triggers, delay):
    rows = events(triggers + 40)
    stream = S.floored_counts(streamed(spark, tmp_path, rows, triggers), delay, 2).run()
    late = {r["event_id"] for r in stream.rejects().collect()}
    want = {}
    for job, ts, i, _, _, d in sorted(rows, key=lambda r: (r[1], r[2])):
        if i not in late:
            count, up = want.get(job, (0, None))
            count, up = max(0, count + d), ts if d > 0 else up
            want[job] = (count, up if count else None)
    assert {r["job"]: (r["cooked_count"], r["last_cooked_at"]) for r in stream.result()[0].collect()} == want


def dues(rows, kind, mark):
    """Timers that go off, by walking from event to event: (job, attempts, time)."""
    jobs, out = {}, set()
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        jobs.setdefault(r[0], []).append(r)
    for job, mine in jobs.items():
        status, attempts, created, updated = "none", 0, None, None
        for i, (_, ts, _, event, *_) in enumerate(mine):
            before = status, attempts
            status, attempts = step(status, attempts, event)
            if (status, attempts) != before:
                updated, created = ts, ts if event == "submit" else created
            end = mine[i + 1][1] if i + 1 < len(mine) else mark
            if kind == "retry" and status == "pending" and attempts:
                due = updated + dt.timedelta(seconds=[5, 30, 120][min(attempts, 3) - 1])
            elif kind == "timeout" and status in ("pending", "running"):
                due = created + dt.timedelta(seconds=180)
            else:
                continue
            if due <= end and not any(o[0] == job and o[2] == due for o in out):
                out.add((job, attempts, due))
    return sorted(out)


@pytest.mark.parametrize("kind", ["retry", "timeout"])
def test_timers(spark, tmp_path, kind, triggers=2, chunks=3):
    rows = events(3, 300, 3)
    due = {"retry": L.retry_due, "timeout": L.timeout_due}[kind]
    stream = S.timers(streamed(spark, tmp_path, rows, triggers), due, 30000, chunks, 3).run()
    late = {r["event_id"] for r in stream.rejects().collect()}
    mark = max(r[1] for r in rows) - dt.timedelta(seconds=30000)
    want = dues([r for r in rows if r[2] not in late], kind, mark)
    got = sorted((r["job"], r["attempts"], r["at"]) for r in stream.result()[1].collect())
    assert got == want and want


def in_files(spark, tmp_path, *frames):
    """A folder of files, one per trigger."""
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for i, df in enumerate(frames):
        df.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        for f in (tmp_path / f"part{i}").glob("part-*.parquet"):
            f.rename(folder / f"{i:03d}.parquet")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_a_timer_goes_off_when_nothing_of_the_job_follows(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    first = [(1, at(0), 1, "submit", None, 0), (2, at(1), 2, "submit", None, 0)]
    other = [(3, at(5000), 3, "submit", None, 0)]
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (first, other, [(3, at(9000), 4, "claim", None, 0)])]
    stream = S.timers(in_files(spark, tmp_path, *frames), L.timeout_due, 60).run()
    # The second trigger emits it: neither the end of the stream nor an event of the job is needed.
    second = spark.read.parquet(f"{stream.root}/output/trigger=1").collect()
    assert sorted((r["job"], r["at"]) for r in second) == [(1, at(180)), (2, at(181))]
    assert sorted(r["job"] for r in stream.result()[1].collect()) == [1, 2, 3]


def test_attempts_are_not_bounded(spark, tmp_path):
    """A job that is claimed and left alone 200 times."""
    rows = [(7, START, 0, "submit", None, 0)]
    rows += [(7, START + dt.timedelta(hours=i + 1), i + 1, "claim", None, 0) for i in range(200)]
    stream = S.job_states(streamed(spark, tmp_path, rows, 2), S.LEASE_SECONDS, YEARS, 5).run()
    state, out = stream.result()
    assert [tuple(r) for r in S.current(state).collect()] == [(7, "running", 200)]
    assert sorted(r["attempts"] for r in out.collect()) == list(range(1, 200))


def test_idle_keys_are_neither_read_nor_written(spark, tmp_path):
    """A million idle jobs, then a trigger with three events."""
    idle = spark.range(1_000_000).select(
        F.col("id").alias("job"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), F.col("id").alias("event_id"),
        F.lit("submit").alias("event"), F.lit(None).cast("string").alias("stage"), F.lit(1).alias("d"))
    few = spark.createDataFrame([(i, START + dt.timedelta(days=i), 2_000_000 + i, "claim", None, 1) for i in range(3)], SCHEMA)
    stream = S.floored_counts(in_files(spark, tmp_path, idle, few), 0).run()

    def size(trigger):
        return sum(f.stat().st_size for f in (pathlib.Path(stream.root.removeprefix("file:")) / f"state/trigger={trigger}").rglob("*.parquet"))

    touched = {r[0] for r in few.select(S.bucket_of("job", S.BUCKETS)).distinct().collect()}
    assert 0 < size(1) < size(0) * 2 * len(touched) / S.BUCKETS
    state, _ = stream.result()
    assert state.count() == 1_000_000 and {r["job"] for r in state.where("cooked_count = 2").collect()} == {0, 1, 2}


def test_enqueue_once_over_all_triggers(spark, tmp_path):
    rows = events(3, 60)
    keyed = streamed(spark, tmp_path, rows, 4).select(F.concat(F.lit("k"), (F.col("event_id") % 20).cast("string")).alias("key"))
    saved = spark.createDataFrame([("k1",), (None,)], "url STRING")
    jobs = spark.createDataFrame([("k2", "running"), ("k3", "done"), (None, "pending")], "k STRING, status STRING")
    got = [r["key"] for r in S.enqueue(keyed, saved, jobs, "key", "url", "k").collect()]
    assert sorted(got) == sorted({f"k{i}" for i in range(20)} - {"k1", "k2"})


def test_nothing_arrives(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    stream = S.event_stream(spark, str(tmp_path), "events", SCHEMA)
    state, out = S.job_states(stream, S.LEASE_SECONDS).run().result()
    assert state.count() == 0 and out.count() == 0
    keys = stream.select(F.col("event").alias("key"))
    none = spark.createDataFrame([], "url STRING, status STRING")
    assert S.enqueue(keys, none, none, "key", "url", "url").count() == 0
