import hashlib

import numpy as np

import corpus_pipeline
from larder.llm import bpe, toxicity
from larder.llm.common import table
from conftest import DATA
from test_bpe import ids
from test_simhash import brute


def test_stages_against_brute_force(spark, tmp_path):
    labels = table(spark, DATA, "labels")
    start = table(spark, DATA, "documents")
    toxic = {r["doc_id"] for r in toxicity.scores(start, labels).where("predicted = 1").collect()}
    docs, seen = start, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "bpe":
            assert out.columns == start.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
    rows = {r["doc_id"]: r for r in start.collect()}
    clean = sorted(set(rows) - toxic)
    assert sorted(r["doc_id"] for r in seen["toxicity"]) == clean
    keep = {}
    for i in clean:
        keep[rows[i]["text"]] = i
    left = sorted(keep.values())
    assert sorted(r["doc_id"] for r in seen["exact_dedup"]) == left
    groups = brute([rows[i]["text"] for i in left])
    left = sorted(left[i] for i in {c for _, c in groups.values()})
    assert sorted(r["doc_id"] for r in seen["simhash_near_dedup"]) == left
    mixed = [r["doc_id"] for r in seen["mixing"]]
    assert set(mixed) <= set(left) and max(map(mixed.count, left)) <= 2
    size = lambda i: len(rows[i]["text"].split())
    assert sum(map(size, mixed)) >= 1.5 * sum(map(size, left))
    want = []
    for i in mixed:
        t = ids(rows[i]["text"])
        want.append((i, len(t), hashlib.sha256(np.array(t, "<u4").tobytes()).hexdigest()))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in seen["bpe"]) == sorted(want)
    assert all(r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]]["text"].encode()).hexdigest() for r in seen["bpe"])
    assert bpe.LEAF > 0


def test_every_stage_takes_an_empty_table(spark, tmp_path):
    docs = table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
