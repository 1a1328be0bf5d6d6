import base64
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from larder.llm import rollup
from larder.llm.bpe import Vocabulary
from helpers import AWKWARD, docs, prose, stored

OLD = ("old", public_tokenizers.path("byte_bpe_50k.tiktoken"))
NEW = ("new", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def count(path, text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return len(tiktoken.Encoding("t", pat_str=Vocabulary.SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text))


def test_corpus_totals_against_a_recount(spark, tmp_path):
    texts = AWKWARD + ["same\nsame\nother", "x\n\n\ny"] + [prose(i, 30) for i in range(12)]
    df = stored(docs(spark, texts, clash=True), tmp_path)
    labels = spark.createDataFrame([(1, 1), (6, 1), (6, 0), (7, 0), (8, None), (None, 1), (999, 1), (11, 1)], "doc_id long, toxic int")
    got = rollup.maintained(df, labels, str(tmp_path / "root"), OLD, NEW).collect()
    want = Counter(), Counter()
    for i, text in enumerate(texts):
        if i in (1, 6, 11):
            continue
        slim = "\n".join(dict.fromkeys((text or "").split("\n")))
        for name, path in (OLD, NEW):
            key = (f"s{i % 2}", "en" if i % 3 else None, name)
            want[0][key] += 1
            want[1][key] += count(path, slim)
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in got} == {
        k: (n, want[1][k]) for k, n in want[0].items()}


def test_batches_commit_once_and_fold(spark, tmp_path):
    r = rollup.Rollup(spark, str(tmp_path / "root"))
    assert r.totals().count() == 0 and r.committed() == set()
    rows = spark.createDataFrame([("a", "en", 5), ("a", "en", None), (None, None, 3)], "source string, lang string, tokens long")
    state = lambda: sorted(map(tuple, r.totals().collect()), key=str)
    assert r.commit("1", rollup.inserts(rows, "t"))
    assert not r.commit("1", rollup.inserts(rows, "t"))
    first = [("a", "en", "t", 2, 5), (None, None, "t", 1, 3)]
    assert state() == sorted(first, key=str)
    r.commit("2", rollup.deletes(rows.where("source is null"), "t"))
    r.commit("empty", rollup.inserts(rows.limit(0), "t"))
    r.fold()
    assert r.committed() == {"1", "2", "empty"} and not r.commit("2", rollup.deletes(rows, "t"))
    assert state() == [("a", "en", "t", 2, 5)]
    revised = rows.where("tokens = 5").withColumn("after", rows.tokens + 10)
    r.commit("3", rollup.revisions(revised, "t", "tokens", "after"))
    assert state() == [("a", "en", "t", 2, 15)]
    r.fold()
    assert state() == [("a", "en", "t", 2, 15)]


def test_a_batch_that_fails_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    r = rollup.Rollup(spark, str(tmp_path / "root"))
    rows = spark.createDataFrame([("a", "en", 5)], "source string, lang string, tokens long")
    r.commit("1", rollup.inserts(rows, "t"))
    broken = rollup.inserts(rows, "t").withColumn("docs", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception):
        r.commit("2", broken)
    assert r.committed() == {"1"} and r.totals().count() == 1
    assert r.commit("2", rollup.inserts(rows, "t")) and r.totals().first()["docs"] == 2


def test_stream_sink_is_idempotent(spark, tmp_path):
    r = rollup.Rollup(spark, str(tmp_path / "root"))
    rows = rollup.inserts(spark.createDataFrame([("a", "en", 5)], "source string, lang string, tokens long"), "t")
    sink = r.sink("stream")
    for number in (0, 1, 1, 0):
        sink(rows, number)
    assert r.totals().first()["docs"] == 2
