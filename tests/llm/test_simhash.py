import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from larder.llm import simhash
from larder.llm.components import components
from helpers import AWKWARD, SCHEMA, all_pairs, connected, docs, edited, prose, stored


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(texts):
    fp = [brute_fingerprint(t) for t in texts]
    near = [(a, b) for a, b in all_pairs(len(fp)) if (fp[a] ^ fp[b]).bit_count() <= 3]
    return dict(enumerate(zip(fp, connected(len(fp), near))))


@pytest.mark.parametrize("bucket", [1, 1024])
def test_matches_brute_force(spark, tmp_path, bucket):
    base = prose(5, 300)
    texts = AWKWARD + [edited(base, i) for i in range(60)] + [prose(i, 12) for i in range(30)]
    df = stored(docs(spark, texts, clash=True), tmp_path)
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.classes(df, bucket).collect()}
    want = brute(texts)
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts) - 40
    kept = simhash.keep_one(df, bucket)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})


@pytest.mark.parametrize("level", [1, 2, 3])
def test_tables_cover_every_pair_within_the_radius(level):
    rng, tables = np.random.default_rng(level), simhash.masks(level)
    assert len(tables) == 15
    for _ in range(3000):
        bits = rng.choice(64, 3, replace=False)
        difference = sum(1 << int(b) for b in bits)
        assert any(difference & (m % (1 << 64)) == 0 for m in tables)


def test_links_connect_like_all_pairs(spark):
    rng = np.random.default_rng(1)
    fps = {0, (1 << 63) - 1, -1}
    for centre in rng.integers(-2**63, 2**63, 6):
        for _ in range(60):
            x = int(centre)
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            fps.add((x + 2**63) % 2**64 - 2**63)
    fps = sorted(fps)
    near = [(a, b) for a, b in all_pairs(len(fps)) if (fps[a] % 2**64 ^ fps[b] % 2**64).bit_count() <= 3]
    want = {fps[i]: fps[r] for i, r in enumerate(connected(len(fps), near)) if i != r}
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    for bucket in (2, 1024):
        got = components(simhash.links(nodes, bucket)).where("node <> root")
        assert {r["node"]: r["root"] for r in got.collect()} == want


def test_components_of_a_path_and_a_star(spark):
    path = spark.range(99).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(200, 300).select(F.col("id").alias("a"), F.lit(1000).cast("long").alias("b"))
    got = {r["node"]: r["root"] for r in components(path.union(star)).collect()}
    assert got == {i: 0 for i in range(100)} | {i: 200 for i in [*range(200, 300), 1000]}
    assert components(path.limit(0)).count() == 0


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = prose(8, 1000)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text.encode()) % (1 << 64) == brute_fingerprint(text)


def test_repeated_rows_null_ids_and_empty(spark, tmp_path):
    rows = [(4, "a b c d", None, None, None)] * 2 + [(None, "a b c d", None, None, None), (None, "x y z", None, None, None)]
    df = stored(spark.createDataFrame(rows, SCHEMA), tmp_path)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(df).collect()) == [(0, "x y z"), (4, "a b c d")]
    none = stored(df.limit(0), tmp_path, "none")
    assert simhash.classes(none).count() == 0 and simhash.keep_one(none).count() == 0
