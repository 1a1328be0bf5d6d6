"""Hot keys: forced splits must give what one pass in order gives."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from larder.operators import keyed, ledger, links, ordered, shopping


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(7)
    # One key holds most rows.
    rows = [(rnd.choice([1, 1, 1, 2, 3]), n, rnd.choice([1, -1, -1, 0, 1]),
             rnd.choice(["submit", "claim", "claim", "fail", "succeed", "fail_permanent", "not_recipe"]),
             rnd.choice(["a", "a", "b", None])) for n in range(600)]
    return rows, spark.createDataFrame(rows, "k int, n int, d int, event string, label string")


@pytest.mark.parametrize("chunks", [1, 7, 40])
def test_floored_counter(events, chunks):
    rows, df = events
    got = {r["n"]: (r["cooked_count"], r["last_cooked_at"])
           for r in ordered.floored_counter(df, ["k"], ["n"], "d", "n", chunks).collect()}
    state = {}
    for k, n, d, *_ in rows:
        count, at = state.get(k, (0, None))
        count = max(0, count + d)
        at = n if d > 0 else at
        state[k] = (count, at if count else None)
        assert got[n] == state[k]


@pytest.mark.parametrize("chunks", [1, 9, 40])
def test_previous_value(events, chunks):
    rows, df = events
    got = {r["n"]: r["before"] for r in ordered.previous_value(df, ["k"], ["n"], "label", "before", chunks).collect()}
    last = {}
    for k, n, _, _, label in rows:
        assert got[n] == last.get(k)
        last[k] = label


@pytest.mark.parametrize("chunks", [1, 9, 40])
def test_replay(events, chunks):
    from test_streams import step

    rows, df = events
    got = {r["k"]: (r["status"], r["attempts"]) for r in ledger.replay(df, "k", ["n"], chunks=chunks).collect()}
    state = {}
    for k, _, _, event, _ in rows:
        state[k] = step(*state.get(k, ("none", 0)), event)
    assert got == state


def snap(v):
    r = int(v * 1000 + Fraction(1, 2)) / 1000
    whole, frac = int(r), r - int(r)
    if frac == 0:
        return Fraction(whole)
    for d in (2, 3, 4, 6, 8):
        n = int(frac * d + 0.5)
        if 0 < n < d and abs(frac - n / d) < 0.02:
            return whole + Fraction(n, d)
    return Fraction(int(r * 10 + 0.5), 10)


@pytest.mark.parametrize("chunks", [1, 11, 60])
def test_consolidate_is_an_ordered_fold(spark, chunks):
    rnd = random.Random(3)
    amount = {"1/2": Fraction(1, 2), "1/3": Fraction(1, 3), "0.4": Fraction(2, 5), "1 3/4": Fraction(7, 4), "2": Fraction(2), "0.07": Fraction(7, 100)}
    rows = []
    for n in range(500):
        key = rnd.choice(["rice", "rice", "rice", "oil"])
        qty = rnd.choice([*amount, *amount, "a splash"])
        rows.append((1, n, f"{qty} {rnd.choice(['cup', 'cup', 'CUP', 'g'])} {key}", key))
    df = spark.createDataFrame(rows, "owner int, n int, text string, key string")
    got = {(r["n"]): (r["text"], r["merged"]) for r in shopping.consolidate(df, "owner", ["n"], chunks=chunks).collect()}
    heads, want = {}, {}
    for _, n, text, key in rows:
        qty = next((q for q in amount if text.startswith(q + " ")), None)
        rest = text[len(qty) + 1:] if qty else text
        head = heads.get(key)
        if head is None:
            heads[key] = [n, amount.get(qty), rest, 0, text]
        elif qty and head[1] is not None and rest.lower() == head[2].lower():
            head[1], head[3] = snap(head[1] + amount[qty]), head[3] + 1
        else:
            want[n] = (text, 0)
    assert {n: v for n, v in got.items() if n not in {h[0] for h in heads.values()}} == want
    for n, total, rest, merged, text in heads.values():
        assert got[n][1] == merged
        if merged:
            qty = got[n][0][: -len(rest) - 1]
            assert abs(sum(Fraction(p) for p in qty.split()) - total) < Fraction(1, 10**6)
        else:
            assert got[n][0] == text


def test_existing_lines_are_not_hijacked_by_a_suffix(spark):
    df = spark.createDataFrame(
        [(1, 1, "1 tbsp olive oil", "olive oil"), (1, 2, "1 tbsp oil", "oil"), (1, 3, "2 tbsp oil", "oil")],
        "owner int, n int, text string, key string")
    got = sorted(r["text"] for r in shopping.consolidate(df, "owner", ["n"]).collect())
    assert got == ["1 tbsp olive oil", "3 tbsp oil"]


@pytest.mark.parametrize("hot_rows", [1, 50, 10**9])
def test_attach_keeps_every_row(spark, hot_rows):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 < 2, F.lit("hot")).when(
        F.col("id") % 30 == 2, F.lit(None)).otherwise((F.col("id") % 40).cast("string")).alias("k"))
    facts = rows.groupBy("k").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    got = keyed.attach(rows, facts, ["k"], "n", rows_per_task=hot_rows)
    assert got.count() == 3000
    want = {r["k"]: r["first"] for r in facts.collect()}
    assert all(r["first"] == (want[r["k"]] if r["k"] else None) for r in got.collect())


def test_link_to_winner(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, "b")], "id int, key string")
    got = {r["id"]: (r["winner_id"], r["is_winner"]) for r in links.link_to_winner(df, "key", "id").collect()}
    assert got == {1: (1, True), 3: (1, False), 2: (2, True), 4: (4, True), 5: (5, True)}


def test_spread_lookup_deals_a_hot_key_over_tasks(spark, monkeypatch):
    """One URL on a third of the rows, known to no per-key table, and rows without a key on another third."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"u{i % 50}") for i in range(9000)]
    df = spark.createDataFrame(rows, "id int, url string").repartition(6)
    facts = spark.createDataFrame([(f"u{i}", i) for i in range(0, 50, 2)] + [("hot", 7)], "url string, fact int")
    known = {f"u{i}": i for i in range(0, 50, 2)} | {"hot": 7}
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for per_key, want in ((facts, known), (facts.where("url <> 'hot'"), {k: v for k, v in known.items() if k != "hot"})):
            out = keyed.spread_lookup(df, per_key, "url", rows_per_task=300)
            got = {r["id"]: r["fact"] for r in out.collect()}
            assert got == {i: want.get(u) for i, u in rows}
            largest = out.where("url is not null").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
            assert largest < 2400, largest
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_redirect_listed_twice_keeps_the_rows(spark):
    rows = spark.createDataFrame([(1, "https://vm.tiktok.com/ZMabc/"), (2, None), (3, "https://vm.tiktok.com/ZMabc/")], "id int, url string")
    to = "https://www.tiktok.com/@u/video/7212345678901234567"
    listed = links.classify_links(rows.where("id = 1"), "url").first()["canonical_url"]
    redirects = spark.createDataFrame([(listed, to)] * 3, "url string, final_url string")
    assert sorted(r["id"] for r in links.resolve_shares(rows, redirects).collect()) == [1, 3]


def test_many_secrets_in_list_order(spark):
    """Ten thousand secrets, overlapping ones and such as only a replacement makes, in one block and in many."""
    from larder.operators import redaction

    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(6, 14))) for _ in range(10_000)]
    words += ["x***yyyy", "xabcdabcdyyyy", "abcdabcd", None, "short"]
    texts = [" ".join(rnd.choice([w or "" for w in words]) for _ in range(30)) for _ in range(40)] + [None, "", "xabcdabcdyyyy " * 3]

    def plain(text):
        for w in words:
            if w and len(w) >= 8 and text is not None:
                text = text.replace(w, "***")
        return text

    secrets = spark.createDataFrame(list(enumerate(words)), "position int, secret string").repartition(5)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for block_bytes in (1 << 24, 200_000):
        got = {r["id"]: r["text"] for r in redaction.redact(df, secrets, block_bytes=block_bytes).collect()}
        assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_recipes_one_after_the_other(spark):
    """Three recipes onto one list in one run, as three runs of which each sees what the last one left."""
    requests = [(1, 1, 0, "2 cups flour", "flour"), (1, 1, 1, "1 tbsp olive oil", "olive oil"), (1, 1, 2, "1 tbsp oil", "oil"),
                (1, 1, 3, "salt", "salt"), (1, 2, 0, "1 cups flour", "flour"), (1, 2, 1, "1 tbsp oil", "oil"), (1, 2, 2, "3 eggs", "eggs"),
                (1, 3, 0, "100 g flour", "flour"), (1, 3, 1, "1 tbsp olive oil", "olive oil"), (1, 3, 2, "2 eggs", "eggs"),
                (1, 3, 3, "", ""), (2, 3, 0, "1 lb shrimp", "shrimp"), (2, 4, 0, "1/2 lb shrimp", "shrimp")]
    requests = [r for r in requests if r[3]]
    lines = [(1, 90, 0, "1 cups flour", False), (1, 91, 1, "7 eggs", True), (2, 92, 0, "2 lb shrimp", False)]
    wanted_schema, line_schema = "owner int, request int, pos int, text string, key string", "owner int, id int, at int, text string, checked boolean"

    state, single = list(lines), []
    for n in (1, 2, 3, 4):
        mine = [r for r in requests if r[1] == n]
        out = shopping.add_recipes(spark.createDataFrame(mine, wanted_schema), spark.createDataFrame(state, line_schema),
                                   "request", "owner", ["at"]).collect()
        owners = {r[0] for r in mine}
        for r in sorted(out, key=lambda r: r["pos"] if r["pos"] is not None else -1):
            if r["action"] == "update":
                state = [(*x[:3], r["text"], x[4]) if x[1] == r["line_id"] else x for x in state]
        for owner in owners:
            for r in sorted((r for r in out if r["action"] == "create"), key=lambda r: r["pos"]):
                if any(m[0] == owner and m[2] == r["pos"] for m in mine) and len(owners) == 1:
                    state.append((owner, n * 1000 + r["pos"], n * 1000 + r["pos"], r["text"], False))
                elif any(m[0] == owner and m[2] == r["pos"] and m[3] == r["text"] for m in mine):
                    state.append((owner, n * 1000 + r["pos"], n * 1000 + r["pos"], r["text"], False))
    final = sorted((x[0], x[3]) for x in state)

    out = shopping.add_recipe_series(spark.createDataFrame(requests, wanted_schema), spark.createDataFrame(lines, line_schema),
                                     "request", "owner", ["at"]).collect()
    changed = {r["line_id"]: r["text"] for r in out if r["action"] == "update"}
    series = [(x[0], changed.get(x[1], x[3])) for x in lines] + [(r["owner"], r["text"]) for r in out if r["action"] == "create"]
    assert sorted(series) == final
    assert (1, "4 cups flour") in series and (2, "3 1/2 lb shrimp") in series and (1, "5 eggs") in series
