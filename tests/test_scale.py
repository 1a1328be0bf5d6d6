"""What lets queries grow with their tables: dealt rows, work done once, texts never broadcast."""

import random
import re

import pytest
from pyspark.sql import functions as F

from larder.functions import scoring, text
from larder.functions.text import WS_CHARS
from larder.operators.ordered import Chunked
from larder.plans import adapters, corpus  # noqa: F401
from larder.plans.registry import QUERIES
from larder.sources.tables import drop_repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of one file and one row group each."""
    at = str(tmp_path_factory.mktemp("tables"))
    spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("One. Two. "), F.col("id").cast("string")).alias("text")).coalesce(
        1).write.parquet(f"{at}/documents.parquet")
    spark.range(300).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
        F.lit(12.5).alias("o_totalprice"), F.to_date(F.lit("2020-01-01")).alias("o_orderdate"),
        F.lit("LOW").alias("o_orderpriority")).coalesce(1).write.parquet(f"{at}/orders.parquet")
    return at


@pytest.mark.parametrize("name", ["documents", "vtt_v", "captions_v", "gathered_v", "ld_pages_v", "deep_pages_v"])
def test_dear_rows_are_dealt_over_tasks(spark, folder, name):
    rows = adapters.view(spark, folder, name)
    tasks = rows.groupBy(F.spark_partition_id()).count().count()
    assert tasks >= spark.sparkContext.defaultParallelism
    assert rows.count() == (200 if name in ("documents", "vtt_v") else 300)


def test_transcripts_are_not_broadcast(spark, folder):
    plan = QUERIES["x4_caption_or_transcript"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_lines_compared_with_their_neighbours_are_made_once(apply):
    def made(c):
        return F.transform(F.split(c, ","), lambda w: F.nullif(w, F.lit("-")))

    assert str(drop_repeats(made(F.col("v")))).count("split(") == 1
    got = apply(lambda c: drop_repeats(made(c)), ["a,a,b,-,b,b,a", "-,-", "a", "", None])
    assert got == [["a", "b", "b", "a"], [], ["a"], [""], None]


def test_rows_to_chunk_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def key(n):
        seen.add(1)
        return n % 5

    rows = spark.range(1000).select(key("id").alias("k"), "id")
    assert Chunked(rows, ["k"], ["id"], chunks=4).rows.count() == 1000
    assert seen.value == 1000


def _texts():
    rnd = random.Random(3)
    return ["".join(rnd.choice(WS_CHARS + "ab.é\U0001f370  \n\r\t") for _ in range(rnd.randint(0, 40))) for _ in range(400)]


def test_collapse_on_every_white_space(apply):
    texts = _texts()
    assert apply(text.collapse, texts) == [re.sub(f"[{WS_CHARS}]+", " ", t) for t in texts]


def test_normalise_on_every_white_space(apply):
    def plain(t):
        blank = "".join(c for c in WS_CHARS if c != "\n")
        t = re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", t).replace(" ", " "))
        t = re.sub(rf"(?<![{blank}])[{blank}]+(?=\n|\Z)", "", t)
        return re.sub(r"\n{3,}", "\n\n", t).strip(WS_CHARS)

    texts = _texts()
    assert apply(text.normalise_text, texts) == [plain(t) for t in texts]


def test_every_verb_is_found(apply):
    verbs = [v.replace("[- ]?", "") for v in scoring.VERBS.split("|")] + ["saute", "air-fry", "air fry", "BAKE"]
    assert apply(scoring.distinct_verbs, verbs) == [1] * len(verbs)
    assert apply(scoring.distinct_verbs, [f"x{v}" for v in verbs] + ["bakes", "rested"]) == [
        1 if " " in v or "-" in v else 0 for v in verbs] + [0, 0]
