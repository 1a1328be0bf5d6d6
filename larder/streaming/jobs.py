"""Event streams folded in order: job states, leases, timers, stage changes, counters, enqueue.

Each trigger is a batch of the operators that also run over whole histories, so
hot keys are cut into chunks here as well and nothing runs row by row in Python.
Events wait until the watermark has passed them and are applied in event order,
whatever order they arrived in; events older than what has been applied go to a
table of rejects.

State is cut into buckets by hash of the key. A trigger reads and writes the buckets
that its events fall into, and those in which a timer has come due; a manifest says
which trigger wrote a bucket last and when its next timer is due. Idle keys are
neither read nor written. State, manifest, waiting events and outputs are tables
numbered by trigger in the shared folder: a trigger that runs again replaces what it
wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import ledger as L
from larder.operators.ordered import floored_counter, previous_value, records_before, replay
from larder.session import materialise, scratch_path

LEASE_SECONDS = L.LEASE_SECONDS
# How long events wait for earlier ones.
DELAY_SECONDS = 15 * 60
ORDER = ["ts", "event_id"]
# A stored state comes before every event that follows it.
STORED = -(1 << 63)
LAST = (1 << 63) - 1
# Parts that the state of a stream is cut into.
BUCKETS = 256
BUCKET = "_bucket"

# (state so far, events in reach, watermark before, watermark) -> (new state, output)
Fold = Callable[[DataFrame, DataFrame, object, object], tuple[DataFrame, DataFrame]]


def event_stream(spark: SparkSession, folder: str, name: str, schema: str,
                 max_bytes: int = 1 << 30) -> DataFrame:
    """One table as a stream, be it a file or a folder of part files; a trigger takes about ``max_bytes``."""
    # A pattern, as a stream takes a plain path for a folder.
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes).parquet(
        f"{folder.rstrip('/')}/{name}[.]parquet")


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class OrderedStream:
    """A fold over an event stream, with its tables. State and events have the key ``job``.

    ``due`` gives, for a state row, when something happens to it without an event.
    """

    MANIFEST = "bucket INT, trigger INT, due TIMESTAMP"

    def __init__(self, events: DataFrame, fold: Fold, state: str, output: str,
                 delay_seconds: int = DELAY_SECONDS, label: str = "stream", due: Callable[[], Column] | None = None,
                 buckets: int = BUCKETS):
        self.spark, self.events, self.fold = events.sparkSession, events, fold
        self.state_schema, self.output_schema = state, output
        self.delay, self.root = delay_seconds, scratch_path(self.spark, label)
        self.due = due or (lambda: F.lit(None).cast("timestamp"))
        self.buckets = buckets

    def _table(self, kind: str, number: int, schema) -> DataFrame:
        if number < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/trigger={number}")

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{kind}/trigger={number}")

    def _mark(self, number: int):
        """Watermark after a trigger: one value."""
        return self._table("mark", number, "mark timestamp").agg(F.max("mark")).first()[0]

    def _state(self, manifest: list, touched: set[int] | None = None) -> DataFrame:
        """The last version of the touched buckets, of all by default."""
        paths = [f"{self.root}/state/trigger={r['trigger']}/{BUCKET}={r['bucket']}" for r in manifest
                 if touched is None or r["bucket"] in touched]
        if not paths:
            return self.spark.createDataFrame([], self.state_schema)
        return self.spark.read.schema(self.state_schema).parquet(*paths)

    def _manifest(self, number: int) -> list:
        """A row per bucket: bounded by their number."""
        return self._table("manifest", number, self.MANIFEST).collect()

    def _trigger(self, batch: DataFrame, number: int) -> None:
        # What this trigger reads must not change if the source is read twice.
        self._write(batch, "arrived", number)
        schema = batch.schema
        arrived, before = self._table("arrived", number, schema), self._mark(number - 1)
        late = F.col("ts") <= F.lit(before) if before is not None else F.lit(False)
        reach = F.max("ts") - F.expr(f"INTERVAL {self.delay} SECOND")
        mark = arrived.agg(F.greatest(reach, F.lit(before).cast("timestamp")).alias("mark"), F.lit(number).alias("number"))
        self._write(mark, "mark", number)
        mark = self._mark(number)
        self._write(arrived.where(late), "rejects", number)
        known = self._table("waiting", number - 1, schema).unionByName(arrived.where(~late))
        ready = F.col("ts") <= F.lit(mark) if mark is not None else F.lit(False)
        self._write(known.where(~ready), "waiting", number)
        self._advance(known.where(ready), number, before, mark)

    def _advance(self, ready: DataFrame, number: int, before, mark) -> None:
        manifest = self._manifest(number - 1)
        touched = {r[0] for r in ready.select(bucket_of("job", self.buckets)).distinct().collect()}
        touched |= {r["bucket"] for r in manifest if r["due"] is not None and mark is not None and r["due"] <= mark}
        state, out = self.fold(self._state(manifest, touched), ready, before, mark)
        bucketed = state.withColumn(BUCKET, bucket_of("job", self.buckets))
        bucketed.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/state/trigger={number}")
        self._write(out, "output", number)
        written = self.spark.read.schema(f"{self.state_schema}, {BUCKET} INT").parquet(f"{self.root}/state/trigger={number}")
        # A timer that the watermark has passed has had its effect.
        due = self.due()
        due = F.when(due > F.lit(mark), due) if mark is not None else due
        now = written.groupBy(F.col(BUCKET).alias("bucket")).agg(F.min(due).alias("due")).select(
            "bucket", F.lit(number).alias("trigger"), "due")
        kept = self.spark.createDataFrame([r for r in manifest if r["bucket"] not in touched], self.MANIFEST)
        self._write(kept.unionByName(now).coalesce(1), "manifest", number)

    def run(self) -> "OrderedStream":
        """Process everything that is available."""
        query = (
            self.events.writeStream.foreachBatch(self._trigger)
            .option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start())
        query.awaitTermination()
        return self

    def _all(self, kind: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{kind}").drop("trigger")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def result(self) -> tuple[DataFrame, DataFrame]:
        """(state, all outputs) as if the stream ended here: what still waits is applied as well."""
        marks = self._all("mark", "mark timestamp, number int")
        last = marks.agg(F.max("number")).first()[0]
        last = -1 if last is None else last
        done = self._all("output", self.output_schema)
        if last < 0:
            return self.spark.createDataFrame([], self.state_schema), done
        waiting, mark = self._table("waiting", last, self.events.schema), self._mark(last)
        state, out = self.fold(self._state(self._manifest(last)), waiting, mark, mark)
        return state, done.unionByName(out)

    def rejects(self) -> DataFrame:
        """Events that came after their time had been applied."""
        return self._all("rejects", self.events.schema)


JOB_STATE = "job BIGINT, ts TIMESTAMP, s INT, n BIGINT, created TIMESTAMP, updated TIMESTAMP"
JOB_OUTPUT = "job BIGINT, attempts BIGINT, at TIMESTAMP"


def _known(state: DataFrame, events: DataFrame) -> DataFrame:
    """Stored jobs as events that come before all others, and the events."""
    stored = state.select("job", "ts", F.lit(STORED).alias("event_id"), F.lit(L.RESUME).alias("event"),
                          F.struct("s", "n", "created", "updated").alias("held"))
    return stored.unionByName(L.plain_events(events.select("job", "ts", "event_id", "event")))


def _final(known: DataFrame, since: DataFrame, chunks: int | None) -> DataFrame:
    final = replay(known, ["job"], ORDER, L.Jobs.FIELDS, L.Jobs(), chunks)
    return final.join(since, "job").select("job", "ts", "record.s", "record.n", "record.created", "record.updated")


def _job_fold(lease_seconds: int | None, chunks: int | None) -> Fold:

    def fold(state: DataFrame, events: DataFrame, before, mark) -> tuple[DataFrame, DataFrame]:
        known = _known(state, events)
        since = known.groupBy("job").agg(F.max("ts").alias("ts"))
        out = known.sparkSession.createDataFrame([], JOB_OUTPUT)
        if lease_seconds is not None:
            lease = F.expr(f"INTERVAL {lease_seconds} SECOND")
            gaps = previous_value(known, ["job"], ORDER, "ts", "before", chunks)
            expired = gaps.where(F.col("ts") - F.col("before") > lease).select(
                "job", (F.col("before") + lease).alias("ts"), "event_id", F.lit("expire").alias("event"))
            ended = since.where(F.col("ts") + lease <= F.lit(mark)).select(
                "job", (F.col("ts") + lease).alias("ts"), F.lit(LAST).alias("event_id"), F.lit("expire").alias("event"))
            known = known.unionByName(L.plain_events(expired.unionByName(ended)))
            met = records_before(known, ["job"], ORDER, L.Jobs.FIELDS, L.Jobs(), lambda e: e["event"] == "expire", chunks)
            out = met.where(L.status_of(F.col("record.s")) == "running").select(
                "job", F.col("record.n").alias("attempts"), F.col("ts").alias("at"))
        return _final(known, since, chunks), out

    return fold


def current(state: DataFrame) -> DataFrame:
    """Status and attempts of every job."""
    return state.select("job", L.status_of(F.col("s")).alias("status"), F.col("n").cast("int").alias("attempts"))


def job_states(events: DataFrame, lease_seconds: int | None = None, delay_seconds: int = DELAY_SECONDS,
               chunks: int | None = None, buckets: int = BUCKETS) -> OrderedStream:
    """Job states from (job, ts, event_id, event); output: leases that ran out.

    A lease runs out between two events more than the lease apart, or once the
    watermark is past it.
    """
    def due() -> Column:
        running = L.status_of(F.col("s")) == "running"
        return F.when(running, F.col("ts") + F.expr(f"INTERVAL {lease_seconds} SECOND"))

    return OrderedStream(events, _job_fold(lease_seconds, chunks), JOB_STATE, JOB_OUTPUT, delay_seconds, "job-states",
                         due if lease_seconds is not None else None, buckets)


def timers(events: DataFrame, due: Callable[[Column], Column], delay_seconds: int = DELAY_SECONDS,
           chunks: int | None = None, buckets: int = BUCKETS) -> OrderedStream:
    """Output: (job, attempts, at) when a job's timer comes due, whether or not any event of it follows.

    ``due(record)`` says when, from what is known of a job; a job that moves on before has
    no timer any more. A timer goes off before events of the same time, each once: a
    trigger gives those that its watermark has passed and the one before had not.
    """

    def fold(state: DataFrame, events: DataFrame, before, mark) -> tuple[DataFrame, DataFrame]:
        known = materialise(_known(state, events), "timer-events")
        since = known.groupBy("job").agg(F.max("ts").alias("ts"))
        final = materialise(_final(known, since, chunks), "timer-states")
        met = records_before(known, ["job"], ORDER, L.Jobs.FIELDS, L.Jobs(), lambda e: e["event"] != L.RESUME, chunks)
        passed = met.withColumn("at", due(F.col("record"))).where(F.col("at") <= F.col("ts")).select(
            "job", F.col("record.n").alias("attempts"), "at", *ORDER)
        record = F.struct("s", "n", "created", "updated")
        left = final.withColumn("record", record).withColumn("at", due(F.col("record"))).where(
            F.col("at") <= F.lit(mark)).select("job", F.col("n").alias("attempts"), "at", "ts", F.lit(LAST).alias("event_id"))
        # A timer that outlives several events is seen before each of them: the first tells the attempts.
        out = passed.unionByName(left).groupBy("job", "at").agg(
            F.min_by("attempts", F.struct(*ORDER)).alias("attempts")).select("job", "attempts", "at")
        if before is not None:
            out = out.where(F.col("at") > F.lit(before))
        return final, out

    return OrderedStream(events, fold, JOB_STATE, JOB_OUTPUT, delay_seconds, "timers",
                         lambda: due(F.struct("s", "n", "created", "updated")), buckets)


def stage_changes(events: DataFrame, delay_seconds: int = DELAY_SECONDS, chunks: int | None = None) -> OrderedStream:
    """Output: the events (job, ts, event_id, stage) that announce a new stage."""

    def fold(state: DataFrame, events: DataFrame, before, mark) -> tuple[DataFrame, DataFrame]:
        stored = state.withColumn("event_id", F.lit(STORED))
        known = stored.unionByName(events.where(F.col("stage").isNotNull()).select("job", "ts", "stage", "event_id"))
        seen = previous_value(known, ["job"], ORDER, "stage", "before", chunks)
        changed = seen.where((F.col("event_id") != STORED) & ~F.col("stage").eqNullSafe(F.col("before")))
        last = known.groupBy("job").agg(F.max_by(F.struct("ts", "stage"), F.struct(*ORDER)).alias("last"))
        return last.select("job", "last.ts", "last.stage"), changed.select("job", "event_id", "stage", "ts")

    return OrderedStream(events, fold, "job BIGINT, ts TIMESTAMP, stage STRING",
                         "job BIGINT, event_id BIGINT, stage STRING, ts TIMESTAMP", delay_seconds, "stages")


def floored_counts(events: DataFrame, delay_seconds: int = DELAY_SECONDS, chunks: int | None = None) -> OrderedStream:
    """State: floored counter and time of its last rise per job, from (job, ts, event_id, d)."""

    def fold(state: DataFrame, events: DataFrame, before, mark) -> tuple[DataFrame, DataFrame]:
        stored = state.select("job", F.col("last_cooked_at").alias("ts"), F.lit(STORED).alias("event_id"),
                              F.col("cooked_count").cast("int").alias("d"))
        known = stored.unionByName(events.select("job", "ts", "event_id", F.col("d").cast("int").alias("d")))
        counted = floored_counter(known, ["job"], ORDER, "d", "ts", chunks)
        last = counted.groupBy("job").agg(F.max_by(F.struct("cooked_count", "last_cooked_at"), F.struct(*ORDER)).alias("last"))
        return last.select("job", "last.*"), events.sparkSession.createDataFrame([], "job BIGINT")

    return OrderedStream(events, fold, "job BIGINT, cooked_count BIGINT, last_cooked_at TIMESTAMP", "job BIGINT",
                         delay_seconds, "counters")


def enqueue(links: DataFrame, saved: DataFrame, jobs: DataFrame, key: str, saved_key: str, job_key: str,
            label: str = "enqueue", buckets: int = BUCKETS) -> DataFrame:
    """Keys to enqueue, each once: not saved, no open job, and not enqueued by an earlier trigger.

    A trigger compares with what the stream itself has written, so it makes no
    difference when or how often a link comes.
    """
    spark = links.sparkSession
    root = scratch_path(spark, label)
    taken = saved.select(F.col(saved_key).alias(key)).unionByName(
        jobs.where(F.col("status").isin("pending", "running")).select(F.col(job_key).alias(key)))
    taken = taken.where(F.col(key).isNotNull()).distinct()
    schema = f"`{key}` STRING"

    def written() -> DataFrame:
        try:
            return spark.read.schema(f"{schema}, {BUCKET} INT, trigger INT").parquet(f"{root}/out")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], f"{schema}, {BUCKET} INT, trigger INT")

    def trigger(batch: DataFrame, number: int) -> None:
        fresh = materialise(batch.where(F.col(key).isNotNull()).select(key).distinct().withColumn(
            BUCKET, bucket_of(key, buckets)), "fresh")
        touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]
        # Only the buckets of this trigger's keys are read; a trigger that runs again does not see itself.
        before = written().where(F.col(BUCKET).isin(touched) & (F.col("trigger") < number)).select(key)
        new = fresh.join(taken, key, "left_anti").join(before, key, "left_anti").withColumn("trigger", F.lit(number))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, "trigger").parquet(f"{root}/out")

    links.writeStream.foreachBatch(trigger).option("checkpointLocation", f"{root}/progress").trigger(
        availableNow=True).start().awaitTermination()
    return written().select(key)
