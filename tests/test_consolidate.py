"""Lists are consolidated with one exchange; only owners too large for a task are cut."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import ordered, shopping

SCHEMA = "owner long, key string, day int, n int, text string"


def lines(seed, owners=8, rows=900):
    rnd = random.Random(seed)
    out = []
    for n in range(rows):
        key = rnd.choice(["rice", "rice", "oil", "salt", "", None])
        amount = rnd.choice(["1/2", "1/3", "1 3/4", "2", "0,4", "½", "a splash", ""])
        owner = rnd.choice([None, 1, 1, 1, 1, *range(owners)])
        out.append((owner, key, rnd.randrange(30), n, rnd.choice([None, *[f"{amount} {rnd.choice(['cup', 'CUP', 'g'])} {key}"] * 9])))
    return out + out[::10]


def got(spark, rows, **more):
    df = shopping.consolidate(spark.createDataFrame(rows, SCHEMA).repartition(4), "owner", ["day", "n"], **more)
    assert df.columns == ["owner", "key", "day", "n", "text", "merged"]
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_gives_the_same_lists(spark, monkeypatch, seed):
    rows = [r for r in lines(seed) if r[0] is not None]
    whole = got(spark, rows)
    assert got(spark, rows, chunks=1) == whole
    # Owner 1 is cut into chunks, the others are folded whole.
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 200)
    assert got(spark, rows) == whole
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 7)
    assert got(spark, rows) == whole


def test_lines_without_an_owner_or_a_key(spark):
    rows = lines(3)
    assert got(spark, rows) == got(spark, rows, chunks=1)
    assert got(spark, []) == []


def test_lines_are_sent_once(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 300)
    rows = spark.range(3000).select(
        (F.col("id") % 500).alias("owner"), (F.col("id") % 7).cast("string").alias("key"), "id", F.lit("2 cups rice").alias("text"))
    df = shopping.consolidate(rows, "owner", ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    assert df.count() == 3000 and df.agg(F.sum("merged")).first()[0] == 0


def test_lean_tables_leave_the_session_as_it_was(spark):
    from larder import session

    before = spark.conf.get(session.CLEANUP, None)
    rows = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s"))
    table = session.materialise(rows, "lean", lean=True)
    assert spark.conf.get(session.CLEANUP, None) == before
    assert table.count() == 10 and table.agg(F.sum("s")).first()[0] == 999 * 500
    assert any(".zstd." in f for f in table.inputFiles())
