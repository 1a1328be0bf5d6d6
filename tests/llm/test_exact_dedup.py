import hashlib

import pytest

from larder.llm import exact_dedup
from helpers import AWKWARD, SCHEMA, docs, prose, stored


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    return {(i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""])) for i, t in rows}


@pytest.mark.parametrize("buckets", [1, 1 << 20])
@pytest.mark.parametrize("clash", [False, True])
def test_matches_brute_force(spark, tmp_path, buckets, clash):
    same_head = [prose(3, 30) + tail for tail in ("a", "b", "c", "a")]
    texts = AWKWARD + same_head + [prose(4, 20)] * 30
    df = stored(docs(spark, texts, clash), tmp_path)
    got = exact_dedup.copies(df, every_hash=True, buckets=buckets).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == brute(list(enumerate(texts)))
    assert all(bytes(r["sha256"]) == hashlib.sha256((texts[r["doc_id"]] or "").encode()).digest() for r in got)
    kept = exact_dedup.keep_one(df, buckets=buckets)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, *_, k in brute(list(enumerate(texts))) if k)


def test_content_is_hashed_only_for_groups_that_survive(spark, tmp_path):
    texts = ["a", "bb", "cc", "same", "same", "x" * 64 + "1", "x" * 64 + "2"]
    got = exact_dedup.copies(stored(docs(spark, texts), tmp_path)).collect()
    assert {r["doc_id"] for r in got if r["sha256"] is not None} == {3, 4, 5, 6}


def test_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(7, "t", None, None, None)] * 3 + [(None, "t", None, None, None), (None, "u", None, None, None)] * 2
    df = stored(spark.createDataFrame(rows, SCHEMA), tmp_path)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in exact_dedup.keep_one(df).collect()) == [(0, "u"), (7, "t")]


def test_empty(spark, tmp_path):
    df = stored(docs(spark, ["x"]).limit(0), tmp_path)
    assert exact_dedup.copies(df).count() == 0 and exact_dedup.keep_one(df).count() == 0
