"""Ordered work inside a key, cut into chunks so that no key sits in one task.

Rows are range-partitioned on (key, order): cuts fall by row count, not by key,
so a key with a third of all rows simply spans a third of the chunks. Each
chunk is worked on alone, then carried into the next one of the same key.

Only a key that crosses a cut has more than one chunk, and every cut is crossed
by at most one key. With P chunks there are at most P - 1 such keys and 2 P
(key, chunk) pairs; that bound is what makes broadcasting the carries safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import materialise

CHUNK = "_chunk"
# Rows of a chunk: their number follows the data.
ROWS_PER_CHUNK = 100_000


def numbered(rows: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Every row with its place, from one, in a total order over all rows.

    Rows are range-partitioned and sorted; a place is the place inside the
    partition plus the rows of the partitions before it, of which there is one
    short count each. No task sees more than its partition.
    """
    ranged = materialise(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(
        out, F.col("_before") + inside + 1).drop("_at", "_part", "_before")


class Chunked:
    """Rows with a chunk number, plus the keys that span several chunks."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str],
                 chunks: int | None = None):
        self.keys, self.order = list(keys), list(order)
        # Counting, finding the cuts and dealing each read the rows: what makes them is run once.
        rows = materialise(rows, "unchunked")
        chunks = chunks or max(1, -(-rows.count() // ROWS_PER_CHUNK))
        ranged = rows.repartitionByRange(chunks, *self.keys, *self.order)
        # Written out once: chunk numbers must not change if a task is run again.
        self.rows = materialise(ranged.withColumn(CHUNK, F.spark_partition_id()))
        self.split_keys = (
            self.rows.groupBy(*self.keys)
            .agg(F.min(CHUNK).alias("_first"), F.max(CHUNK).alias("_last"))
            .where(F.col("_first") < F.col("_last")).select(*self.keys))

    @property
    def window(self) -> Window:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*self.order)

    @property
    def running(self) -> Window:
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def before(self) -> Window:
        """Earlier chunks of the same key, on a frame of chunk summaries."""
        return Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(
            Window.unboundedPreceding, -1)

    def summaries(self, rows: DataFrame, *aggs: Column) -> DataFrame:
        """One row per chunk of each split key."""
        split = rows.join(F.broadcast(self.split_keys), self.keys, "left_semi")
        return split.groupBy(*self.keys, CHUNK).agg(*aggs)

    def carry(self, rows: DataFrame, carries: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(carries), [*self.keys, CHUNK], "left")


def previous_value(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, out: str,
    chunks: int | None = None,
) -> DataFrame:
    """``lag(column)`` per key in order, for keys of any size."""
    c = Chunked(rows, keys, order, chunks)
    inside = c.rows.withColumn(out, F.lag(column).over(c.window)).withColumn(
        "_head", F.row_number().over(c.window) == 1)
    ends = c.summaries(c.rows, F.max_by(F.struct(column), F.struct(*order)).alias("_end"))
    carries = ends.withColumn(
        "_end", F.lag("_end").over(Window.partitionBy(*c.keys).orderBy(CHUNK)))
    value = F.when(F.col("_head"), F.col(f"_end.{column}")).otherwise(F.col(out))
    return c.carry(inside, carries).withColumn(out, value).drop("_head", "_end", CHUNK)


def floored_counter(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], delta: str, at: str,
    chunks: int | None = None,
) -> DataFrame:
    """Running counter that never goes below zero, with the time of its last rise.

    With S the running sum, the floored count is ``S - least(0, running min of S)``:
    sums and minima carry over from chunk to chunk. The time is cleared whenever
    the count is zero.
    """
    c = Chunked(rows, keys, order, chunks)
    inside = c.rows.withColumn("_s", F.sum(delta).over(c.running))
    inside = inside.withColumns({
        "_m": F.min("_s").over(c.running),
        "_up": F.last(F.when(F.col(delta) > 0, F.col(at)), ignorenulls=True).over(c.running),
    })
    ends = c.summaries(
        inside, F.sum(delta).alias("_total"), F.min("_s").alias("_low"),
        F.max_by(F.when(F.col(delta) > 0, F.col(at)),
                 F.when(F.col(delta) > 0, F.struct(*order))).alias("_up_end"))
    ends = ends.withColumn("_base", F.coalesce(F.sum("_total").over(c.before), F.lit(0)))
    carries = ends.select(
        *c.keys, CHUNK, "_base",
        F.min(F.col("_base") + F.col("_low")).over(c.before).alias("_base_low"),
        F.last("_up_end", ignorenulls=True).over(c.before).alias("_base_up"))
    base = F.coalesce(F.col("_base"), F.lit(0))
    total = base + F.col("_s")
    low = F.least(F.lit(0), F.coalesce(F.col("_base_low"), F.lit(0)), base + F.col("_m"))
    out = c.carry(inside, carries).withColumn("cooked_count", (total - low).cast("long"))
    last_up = F.coalesce(F.col("_up"), F.col("_base_up"))
    out = out.withColumn("last_cooked_at", F.when(F.col("cooked_count") > 0, last_up))
    return out.drop("_s", "_m", "_up", "_base", "_base_low", "_base_up", CHUNK)


class Machine:
    """A finite state with facts beside it, stepped through events; the facts are not bounded.

    A record has the field ``s``, an integer state from zero, and the facts since its
    ``start``. ``step(record, event)`` gives the next record. ``join(a, b)`` puts the
    record ``b`` of a chunk behind the record ``a`` of everything before it, where the
    chunk was entered in the state ``a`` ends in: what a chunk counts is relative.
    """

    states = 1

    def start(self, state: Column) -> Column:
        return F.struct(state.alias("s"))

    def step(self, record: Column, event: Column) -> Column:
        raise NotImplementedError

    def join(self, a: Column, b: Column) -> Column:
        return b


def _exits(c: Chunked, fields: Sequence[str], machine: Machine) -> DataFrame:
    """Per chunk of a key its events in order and the record it gives for every entry state.

    A chunk that is not the first of its key cannot know its entry state, so it is
    summarised for all of them; work per chunk is bounded by the chunk.
    """
    firsts = c.rows.join(F.broadcast(c.split_keys), c.keys, "left_semi").groupBy(
        *c.keys).agg(F.min(CHUNK).alias("_first"))
    per_chunk = c.rows.groupBy(*c.keys, CHUNK).agg(F.array_sort(F.collect_list(
        F.struct(*c.order, *fields))).alias("_events"), F.count("*").alias("events"))
    per_chunk = per_chunk.join(F.broadcast(firsts), c.keys, "left")

    def fold(start: Column) -> Column:
        return F.aggregate(F.col("_events"), machine.start(start), machine.step)

    entry = F.when(
        F.coalesce(F.col("_first"), F.col(CHUNK)) == F.col(CHUNK), F.array(F.lit(0)),
    ).otherwise(F.sequence(F.lit(0), F.lit(machine.states - 1)))
    return per_chunk.select(*c.keys, CHUNK, "_events", "events", F.transform(entry, fold).alias("_exit"))


def _composed(tables: Column, machine: Machine) -> Column:
    """The record after the given chunks of a key."""
    return F.aggregate(tables, machine.start(F.lit(0)), lambda r, t: machine.join(r, F.get(t["_exit"], r["s"])))


def _tables(exits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is gathered per key: one short table per chunk."""
    return exits.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(CHUNK, "_exit"))).alias("_tables"), F.sum("events").alias("events"))


def replay(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str],
    machine: Machine, chunks: int | None = None,
) -> DataFrame:
    """Final record per key after all its events in order, and their number."""
    per_key = _tables(_exits(Chunked(rows, keys, order, chunks), fields, machine), keys)
    return per_key.select(*keys, _composed(F.col("_tables"), machine).alias("record"), "events")


def records_before(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str],
    machine: Machine, which, chunks: int | None = None,
) -> DataFrame:
    """Key, order and record before every event for which ``which(event)`` holds."""
    c = Chunked(rows, keys, order, chunks)
    exits = _exits(c, fields, machine)
    entries = _tables(exits, c.keys).select(*c.keys, F.explode(F.transform(F.col("_tables"), lambda t, i: F.struct(
        t[CHUNK].alias(CHUNK), _composed(F.slice("_tables", F.lit(1), i), machine).alias("_entry")))).alias("_e"),
    ).select(*c.keys, "_e.*")
    met = F.struct(*[F.col(f"_events.{o}")[0].alias(o) for o in c.order], F.col("_entry").alias("record"))
    # The entry record goes in as it is: from here on facts are whole, not relative.
    start = F.struct(F.col("_entry").alias("r"), F.filter(F.array(met), lambda _: F.lit(False)).alias("met"))

    def walk(acc: Column, e: Column) -> Column:
        now = F.struct(*[e[o].alias(o) for o in c.order], acc["r"].alias("record"))
        return F.struct(machine.step(acc["r"], e).alias("r"), F.when(
            which(e), F.concat(acc["met"], F.array(now))).otherwise(acc["met"]).alias("met"))

    walked = exits.where(F.exists("_events", which)).join(entries, [*c.keys, CHUNK]).select(
        *c.keys, F.explode(F.aggregate(F.col("_events"), start, walk)["met"]).alias("_m"))
    return walked.select(*c.keys, "_m.*")
