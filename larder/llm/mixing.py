"""Mixing sources to target weights, with exact budgets.

Every document gets a hash-random key. A source is sorted by it in ranges:
sums of words per range, their prefix sums, and inside the one range that holds
the cut the rows in order. What remains is one cut row per source, so neither
texts nor documents move; a document knows from its own key and its source's
cut how often it is taken.

* A size is the number of words; null texts have none and are never taken.
* A target over the source's size repeats it in whole passes; the last pass ends
  inside the document that the budget cuts. Rows that agree in key, id and size
  share what is left there equally, rounded down.
* A null source is a source of its own, last in order; null ids count as one id.
* Texts are counted whole, whatever their length. An empty table, or one without words, gives targets of zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import WORD, columns, fresh, whole
from larder.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
SEED = "mix"
# Ranges of keys a source is cut into: the top bits of a 60-bit key.
KEY_BITS, RANGE_BITS = 60, 12
NO_ID = -(1 << 63)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    """60 hash-random bits of an id, the same in every run."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, KEY_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "source", n_words(whole()).alias("size"), random_key(F.col("doc_id")).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"))


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """source, source_size and target, one row per source.

    Weights repeat over the sources in order; their places come from a range
    sort and the row counts of its partitions, not from one task. The share is
    dealt by weight; what exceeds a source's limit is dealt again until no
    target is above its limit. A round needs two sums only.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = sums.orderBy(F.col("source").asc_nulls_last()).withColumn(
        "place", F.monotonically_increasing_id())
    placed = materialise(ordered.select(
        "source", "source_size", F.shiftright("place", 33).alias("part"),
        F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "sources")
    before = placed.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("before") + F.col("nth"), F.lit(len(weights))).cast("int"))
    listed = materialise(placed.join(F.broadcast(before), "part").select(
        "source", "source_size", weight.alias("weight"),
        (F.col("source_size") * F.lit(passes)).alias("most")), "weights")
    total = listed.agg(F.sum("source_size")).first()[0] or 0
    level, known = 0.0, None
    while total:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        got = listed.agg(
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open")).first()
        if got == known or not got["open"]:
            break
        known, level = got, (share * total - got["given"]) / got["open"]
    return listed.select("source", "source_size", F.least(
        F.col("most").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source of ``plan``: whole passes and the row that ends the last pass.

    source, source_size, target, passes, cut_key, cut_id, cut_size, cut_words.
    A row before the cut is taken once more, the rows at it get ``cut_words``.
    """
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    size = F.col("source_size")
    plan = materialise(plan.select(
        "source", "source_size", "target",
        F.when(size > 0, F.expr("0L") + F.floor(budget / size)).otherwise(0).cast("long").alias("passes"),
        F.when(size > 0, budget % size).otherwise(F.lit(0)).cast("long").alias("rest")), "plan")
    part = F.shiftright("key", KEY_BITS - RANGE_BITS)
    sums = rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("part")
    sums = sums.withColumn("before", F.sum("words").over(along) - F.col("words"))
    wanted = plan.where("rest > 0").select(F.col("source").alias("of"), "rest")
    holds = sums.join(wanted, F.col("source").eqNullSafe(F.col("of"))).where(
        (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    holds = materialise(holds.select(
        "of", F.col("part").alias("at"), (F.col("rest") - F.col("before")).alias("left")), "ranges")
    inside = rows.join(holds, F.col("source").eqNullSafe(F.col("of")) & (part == F.col("at")))
    alike = inside.groupBy("of", "left", "key", "id", "size").agg(F.count("*").alias("n"))
    order = Window.partitionBy("of").orderBy("key", "id", "size")
    words = F.col("size") * F.col("n")
    ends = alike.withColumn("before", F.sum(words).over(order) - words).where(
        (F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + words))
    ends = ends.select(
        "of", F.col("key").alias("cut_key"), F.col("id").alias("cut_id"),
        F.col("size").alias("cut_size"),
        F.floor((F.col("left") - F.col("before")) / F.col("n")).cast("long").alias("cut_words"))
    return materialise(plan.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "rest"), "cuts")


def last_pass(key: Column, id_: Column, size: Column) -> Column:
    """Words of a row that the last, unfinished pass takes."""
    mine = F.struct(key.alias("key"), id_.alias("id"), size.alias("size"))
    cut = F.struct(F.col("cut_key").alias("key"), F.col("cut_id").alias("id"), F.col("cut_size").alias("size"))
    return F.when(F.col("cut_key").isNull(), F.lit(0)).when(mine < cut, size).when(
        mine == cut, F.col("cut_words")).otherwise(F.lit(0)).cast("long")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows = materialise(sized(docs), "sized")
    plan = cuts(rows, targets(rows)).withColumnRenamed("source", "of")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    taken = F.col("passes") * F.col("size") + last_pass(F.col("key"), F.col("id"), F.col("size"))
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def sample(docs: DataFrame) -> DataFrame:
    """The mix itself: documents with all columns, once for every pass that takes them.

    A document stays whole, also the one at the cut; what has no words is not taken.
    """
    rows = materialise(sized(docs), "sized")
    plan = cuts(rows, targets(rows))
    renamed = plan.select(*[F.col(c).alias(n) for c, n in zip(plan.columns, fresh(docs, *[f"mix_{c}" for c in plan.columns]))])
    names = dict(zip(plan.columns, renamed.columns))
    joined = docs.join(renamed, F.col("source").eqNullSafe(F.col(names["source"])))
    size, key = n_words(whole()), random_key(F.col("doc_id"))
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    mine = F.struct(key.alias("key"), id_.alias("id"), size.alias("size"))
    cut = F.struct(F.col(names["cut_key"]).alias("key"), F.col(names["cut_id"]).alias("id"),
                   F.col(names["cut_size"]).alias("size"))
    once_more = F.col(names["cut_key"]).isNotNull() & (
        (mine < cut) | ((mine == cut) & (F.col(names["cut_words"]) > 0)))
    times = F.when(size == 0, F.lit(0)).otherwise(
        F.col(names["passes"]) + F.when(once_more, F.lit(1)).otherwise(F.lit(0)))
    (nth,) = fresh(joined, "pass")
    return joined.withColumn(nth, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*columns(docs))


# One row per document; keys, sums and cuts as above, in windows.
SQL = """
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighted AS (
  SELECT source, source_size, 2 * source_size AS most,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sums),
filled AS (
  SELECT *, sum(most) OVER before AS given, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open,
    1.5::DOUBLE * sum(source_size) OVER () AS share
  FROM weighted WINDOW before AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT arg_min((share - coalesce(given, 0)) / open, most / weight) AS level FROM filled
  WHERE (share - coalesce(given, 0)) / open <= most / weight),
plan AS (
  SELECT source, source_size, least(most::DOUBLE, level * weight) AS target,
    floor(least(most::DOUBLE, level * weight) + 0.5)::BIGINT AS budget FROM weighted, levels),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM rows)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE size * (budget // source_size)
    + greatest(0, least(size, budget % source_size - before)) END)::BIGINT AS taken
FROM placed JOIN plan ON placed.source IS NOT DISTINCT FROM plan.source
"""
