"""Files that every scan cuts differently, as when executors come and go between two jobs."""

import pytest
from pyspark.sql import functions as F

from larder.llm import bpe, common, exact_dedup, line_dedup, simhash, surrogates
from helpers import docs, prose

CUT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def restless(spark, monkeypatch):
    before, calls = spark.conf.get(CUT), []

    def turn(real):
        def run(df, label="table"):
            out = real(df, label)
            calls.append(label)
            spark.conf.set(CUT, str((1 << 10, 1 << 27)[len(calls) % 2]))
            return out
        return run

    for module in (common, exact_dedup, line_dedup, simhash, surrogates):
        if hasattr(module, "materialise"):
            monkeypatch.setattr(module, "materialise", turn(module.materialise))
    yield lambda n: (calls.clear(), calls.extend(["start"] * n), spark.conf.set(CUT, str(1 << 27)))
    spark.conf.set(CUT, before)


def many_files(spark, tmp_path, texts):
    path = str(tmp_path / "docs")
    docs(spark, texts).repartitionByRange(12, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("first", [0, 1])
def test_rows_are_met_again_whatever_the_splits(spark, tmp_path, restless, first):
    texts = [prose(i % 97, 30) + f" a{i % 97}@x{i % 97}.org" for i in range(240)]
    df = many_files(spark, tmp_path, texts)
    for keep_one, best in ((exact_dedup.keep_one, max), (simhash.keep_one, min)):
        restless(first)
        got = sorted(r["doc_id"] for r in keep_one(df).collect())
        assert got == sorted(best(i for i in range(240) if i % 97 == k) for k in range(97)), keep_one.__module__


@pytest.mark.parametrize("first", [0, 1])
def test_lines_and_redraws_reach_their_own_documents(spark, tmp_path, restless, monkeypatch, first):
    texts = [f"own {i}\nshared by all\nowner {i}" if i % 3 else f"own {i}" for i in range(120)]
    df = many_files(spark, tmp_path, texts)
    restless(first)
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_spread_lines(df, min_sites=2, most_sent=0).collect()}
    assert got == {i: t.replace("shared by all\n", "") for i, t in enumerate(texts)}
    draws = surrogates.surrogate
    # The first draw of every address is one that others draw too.
    monkeypatch.setattr(surrogates, "surrogate", lambda key, kind, hint, canon, draw=0: (
        draws(key, kind, hint, canon, draw) if draw else draws(key, kind, hint, "1.2.3.4", 0)))
    monkeypatch.setattr(surrogates.assigned, "__defaults__", (surrogates.KEY, surrogates.surrogate))
    df = docs(spark, [f"host 9.8.{i // 200}.{i % 200}" for i in range(120)]).repartitionByRange(12, "doc_id")
    df.write.parquet(str(tmp_path / "ip"))
    restless(first)
    out = surrogates.replaced(spark.read.parquet(str(tmp_path / "ip"))).select(F.countDistinct("text")).first()[0]
    assert out == 120


@pytest.mark.parametrize("sent", [bpe.SENT, 0])
def test_tokens_reach_their_own_documents(spark, tmp_path, monkeypatch, sent):
    """Long texts are met again by content: no number of a scan is in the plan, and copies are encoded once."""
    texts = [prose(i % 7, 60) if i % 3 else f"short {i}" for i in range(60)]
    df = many_files(spark, tmp_path, texts)
    monkeypatch.setattr(bpe, "SENT", sent)
    coded = bpe.encode(df, leaf=64, back=True)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "monotonically_increasing_id" not in plan
    vocab = bpe.vocabulary(bpe.default_vocabulary())
    got = coded.collect()
    assert sorted(r["doc_id"] for r in got) == list(range(60))
    for r in got:
        assert bytes(r["ids"]) == vocab.encode(texts[r["doc_id"]].encode()).tobytes() and r["decoded"] == texts[r["doc_id"]]
