import hashlib

import pytest

from larder.llm import order_minhash
from helpers import AWKWARD, SCHEMA, docs, edited, prose, stored
from pyspark.sql import functions as F


def brute_words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    out, word = [], ""
    for c in text + " ":
        ideograph = any(a <= ord(c) <= b for a, b in ((0xE00, 0xE7F), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF)))
        if c == " " or ideograph:
            out += [word] if word else []
            word = ""
            out += [c] if ideograph else []
        else:
            word += c
    return out


def items(text, k):
    words = brute_words(text)
    seen, out = {}, []
    for i in range(max(1, len(words) - k + 1) if words else 0):
        mer = tuple(words[i:i + k])
        seen[mer] = seen.get(mer, 0) + 1
        out.append((mer, seen[mer], i))
    return out


def brute(spark, texts, k, count):
    """Fingerprints from the definition; only the hash function is Spark's."""
    mers = sorted({m for t in texts for m, *_ in items(t, k)})
    rows = spark.createDataFrame([(i, *m, *[None] * (k - len(m))) for i, m in enumerate(mers)],
                                 "i int, " + ", ".join(f"w{j} string" for j in range(k)))
    top = F.shiftright(F.xxhash64(F.struct(*[f"w{j}" for j in range(k)])).bitwiseAND(F.lit(~order_minhash.PLACE)), 24)
    most = max([n for t in texts for _, n, _ in items(t, k)], default=1)
    ranks = rows.select("i", top.alias("h")).crossJoin(spark.range(1, most + 1).select(F.col("id").cast("int").alias("n"))).select(
        "i", "n", F.array(*[F.xxhash64(F.xxhash64("h", "n"), F.lit(j)) for j in range(count)]).alias("g")).collect()
    rank = {(mers[r["i"]], r["n"]): r["g"] for r in ranks}
    pairs, out = set(), []
    for t in texts:
        sketches = []
        for j in range(count):
            picked = []
            for sign in (False, True):
                side = [(rank[m, n][j] >> 24, at) for m, n, at in items(t, k) if (rank[m, n][j] < 0) == sign]
                picked += [min(side)] if side else [(None, None)]
            a, b = picked
            if a[1] is not None and b[1] is not None and a[1] > b[1]:
                a, b = b, a
            sketches.append((a[0], b[0]))
        pairs.update(sketches)
        out.append(sketches)
    pairs = list(pairs)
    hashed = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a long, b long").select(
        "i", F.xxhash64("a", "b").alias("h")).collect()
    code = {pairs[r["i"]]: f"{r['h'] & 0xFFFFFFFF:08x}" for r in hashed}
    return ["".join(code[p] for p in s) for s in out]


@pytest.mark.parametrize("k", [1, 3])
def test_matches_the_definition(spark, tmp_path, k):
    texts = [t for t in AWKWARD if len(t or "") < 2000] + ["a b a b a b a", "a a a a", "日本語 日本語x", prose(4, 60), edited(prose(4, 60), 1)]
    df = stored(docs(spark, texts, clash=True), tmp_path)
    got = {r["doc_id"]: r["fingerprint"] for r in order_minhash.fingerprints(df, k, 4).collect()}
    assert [got[i] for i in range(len(texts))] == brute(spark, [t or "" for t in texts], k, 4)


def test_order_matters(spark, tmp_path):
    words = prose(7, 80).split(" ")
    df = stored(docs(spark, [" ".join(words), " ".join(words[40:] + words[:40]), " ".join(words[::-1])]), tmp_path)
    a, b, c = [r["fingerprint"] for r in order_minhash.fingerprints(df, 1, 64).orderBy("doc_id").collect()]
    same = lambda x, y: sum(x[i:i + 8] == y[i:i + 8] for i in range(0, 512, 8)) / 64
    assert 0.2 < same(a, b) < 0.9 and same(a, c) < 0.15


@pytest.mark.parametrize("bits", [2, 10])
def test_edited_texts_and_next_documents(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(order_minhash, "BLOCK_BITS", bits)
    monkeypatch.setattr(order_minhash, "SUPER_BITS", 1)
    texts = AWKWARD + [prose(i, 30 + i) for i in range(20)] + ["éß🙂" * 7]
    step = [0, 3, 50, 51, 900]
    ids = [step[i % 5] + 2000 * (i // 5) - 1000 for i in range(len(texts))]
    df = stored(spark.createDataFrame(
        [(i, t, None, None, None) for i, t in zip(ids, texts)], SCHEMA).repartition(3), tmp_path)
    got = {r["doc_id"]: r for r in order_minhash.edited_pairs(df).collect()}
    prints = {r["doc_id"]: r["fingerprint"] for r in order_minhash.fingerprints(df).collect()}
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    edits = []
    for at, i in enumerate(order):
        j = order[(at + 1) % len(order)]
        text, after = texts[i] or "", texts[j] or ""
        tail = len(text) // 4
        new = text[:len(text) - tail] + after[:tail]
        r = got[ids[i]]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == prints[ids[i]]
        same = sum(prints[ids[i]][c:c + 8] == prints[ids[j]][c:c + 8] for c in range(0, 256, 8)) / 32
        assert r["near_next"] == same
        edits.append((ids[i], new))
    again = stored(spark.createDataFrame([(i, t, None, None, None) for i, t in edits], SCHEMA), tmp_path, "edits")
    assert {r["doc_id"]: r["fingerprint"] for r in order_minhash.fingerprints(again).collect()} == {
        i: got[i]["edited_fingerprint"] for i in ids}


def test_repeats_null_ids_and_empty(spark, tmp_path):
    rows = [(1, "a b c d", None, None, None)] * 2 + [(None, "x y z w", None, None, None)] * 2 + [(5, None, None, None, None)]
    df = stored(spark.createDataFrame(rows, SCHEMA), tmp_path)
    got = order_minhash.edited_pairs(df).collect()
    assert len(got) == 5
    assert sorted(r["near_next"] for r in got if r["doc_id"] == 1) == [0.0, 1.0]
    for r in got:
        if r["doc_id"] is None:
            assert r["edited_sha256"] == hashlib.sha256(b"x y z ").hexdigest() and r["near_next"] == 0
    assert order_minhash.edited_pairs(stored(df.limit(0), tmp_path, "none")).count() == 0
    one = stored(df.where("doc_id = 5"), tmp_path, "one")
    assert [r["near_next"] for r in order_minhash.edited_pairs(one).collect()] == [1.0]


def test_main_path_is_native(spark, tmp_path):
    df = stored(docs(spark, ["a b c"]), tmp_path)
    plan = order_minhash.edited_pairs(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
