import random
from fractions import Fraction

import duckdb
import pytest

from larder.llm import mixing
from helpers import AWKWARD, SCHEMA, docs, prose, stored


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, budget, open_ = {}, Fraction(3, 2) * sum(sizes.values()), set(names)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            budget -= target[s]
        open_ -= over
    return target


def check(rows):
    sizes = {}
    for r in rows:
        sizes.setdefault(r["src"], 0)
        sizes[r["src"]] += r["size"]
    want = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in rows if r["src"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * (1 + want[s]) for r in mine)
        assert sum(r["taken"] for r in mine) == int(want[s] + Fraction(1, 2))
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine)


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_exact_budgets(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = ["b", "a", "é", None, "B", "z", ""]
    texts = AWKWARD + [prose(i, rng.choice([1, 5, 50, 400])) for i in range(80)]
    df = stored(docs(spark, texts, clash=True, source=lambda i: names[min(i % 11, 6)]), tmp_path)
    got = mixing.mixed(df).collect()
    src = {r["doc_id"]: r["source"] for r in df.select("doc_id", "source").collect()}
    rows = [{**r.asDict(), "src": src[r["doc_id"]]} for r in got]
    assert len(rows) == len(texts)
    check(rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed(df.repartition(5)).collect()))


def test_the_mix_repeats_whole_documents(spark, tmp_path):
    texts = AWKWARD + [prose(i, 20 + i) for i in range(60)]
    df = stored(docs(spark, texts, clash=True, source=lambda i: None if i % 2 else "big"), tmp_path)
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mixed(df).collect()}
    got = mixing.sample(df)
    assert got.columns == df.columns
    times = {}
    for r in got.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        assert r["text"] == texts[r["doc_id"]]
    assert times == {i: -(-t // s) for i, (t, s) in taken.items() if t}


def test_repeated_rows_share_the_cut(spark, tmp_path):
    rows = [(1, "a b c", None, "s", None)] * 7 + [(None, "d", None, "t", None)] * 5
    got = mixing.mixed(stored(spark.createDataFrame(rows, SCHEMA), tmp_path)).collect()
    for size in (3, 1):
        mine = [r for r in got if r["size"] == size]
        assert 0 <= mine[0]["target"] - sum(r["taken"] for r in mine) < len(mine)


def test_no_words_and_no_rows(spark, tmp_path):
    df = stored(docs(spark, [None, "", " "]), tmp_path)
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mixed(df).collect()] == [(0, 0.0, 0)] * 3
    assert mixing.sample(df).count() == 0
    assert mixing.mixed(stored(df.limit(0), tmp_path, "none")).count() == 0


def test_sql_agrees_on_awkward_rows(spark, tmp_path):
    names = ["b", "a", None]
    texts = AWKWARD + [prose(i, i % 50) for i in range(40)]
    df = stored(docs(spark, texts, source=lambda i: names[i % 3]), tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/docs/*.parquet')")
    want = con.execute(mixing.SQL).fetchall()
    assert sorted(map(tuple, mixing.mixed(df).collect())) == sorted(want)
