"""Exact deduplication by progressive refinement.

Rows are grouped by length, the groups left with more than one row by the hash
of a prefix, and only rows of groups that survive both have their content
hashed. Group tables are reduced on the input tasks first; no text is shuffled.

* Null texts count as empty. Texts are equal when identical, byte for byte.
* Of equal texts the row with the largest ``doc_id`` stays (null is smaller than
  any id); of repeated rows with that id exactly one.
* Texts are hashed whole, whatever their length. An empty table gives an empty result.
* Extra columns are kept by ``keep_one`` whatever their names; ``copies`` does not read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import columns, fresh, numbered, whole
from larder.operators.keyed import attach
from larder.session import materialise

# Code points of the prefix that is hashed.
PREFIX = 64
# Surviving groups are marked in a table of at most this many buckets, which bounds what is
# broadcast. Groups that share a bucket only cause more rows to be hashed.
BUCKETS = 1 << 20


def surviving_buckets(rows: DataFrame, prefix: int = PREFIX, buckets: int = BUCKETS) -> DataFrame:
    """Buckets of the (length, prefix) groups that have more than one row.

    ``rows`` has the column ``body``.
    """
    shared = materialise(
        rows.groupBy(F.octet_length("body").alias("n_bytes")).count().where("count > 1")
        .select(F.pmod(F.xxhash64("n_bytes"), F.lit(buckets)).cast("int").alias("bucket")).distinct(),
        "lengths")
    left = _marked(rows, F.pmod(F.xxhash64(F.octet_length("body")), F.lit(buckets)), shared)
    groups = left.where("marked").groupBy(
        F.octet_length("body").alias("n_bytes"),
        F.xxhash64(F.substring("body", 1, prefix)).alias("head")).count()
    return materialise(groups.where("count > 1").select(
        F.pmod(F.xxhash64("n_bytes", "head"), F.lit(buckets)).cast("int").alias("bucket"),
    ).distinct(), "prefixes")


def _marked(rows: DataFrame, bucket, buckets: DataFrame) -> DataFrame:
    """``rows`` with ``marked``: the bucket is in the table, which has BUCKETS rows at most."""
    keyed = rows.withColumn("bucket", bucket.cast("int"))
    marks = F.broadcast(buckets.withColumn("hit", F.lit(True)))
    return keyed.join(marks, "bucket", "left").withColumn(
        "marked", F.coalesce("hit", F.lit(False))).drop("bucket", "hit")


def copies(docs: DataFrame, every_hash: bool = False, prefix: int = PREFIX,
           buckets: int = BUCKETS, number: str | None = None) -> DataFrame:
    """One row per document: doc_id, row (a number of the input row), keep_id, group_size, kept, sha256.

    ``sha256`` is binary, and null where the text was told apart before its
    content had to be hashed; ``every_hash`` fills it all the same. ``number``
    is the column of ``docs`` that numbers its rows; without it they are numbered here,
    for this result only.
    """
    place = F.col(number) if number else F.monotonically_increasing_id()
    rows = docs.select("doc_id", whole().alias("body"), place.alias("row"))
    found = surviving_buckets(rows, prefix, buckets)
    key = F.xxhash64(F.octet_length("body"), F.xxhash64(F.substring("body", 1, prefix)))
    marked = _marked(rows, F.pmod(key, F.lit(buckets)), found)
    digest = F.unhex(F.sha2("body", 256))
    hashed = materialise(marked.select(
        "doc_id", "row", "marked",
        (digest if every_hash else F.when(F.col("marked"), digest)).alias("sha256")), "hashed")
    within = hashed.where("marked").drop("marked")
    groups = within.groupBy("sha256").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep"),
    ).where("group_size > 1").withColumn("rows_of_key", F.col("group_size"))
    linked = attach(within, groups, ["sha256"], "rows_of_key", spread=["row"])
    alone = hashed.where("not marked").select(
        "doc_id", "row", "sha256", F.lit(None).cast("long").alias("group_size"),
        F.lit(None).cast(linked.schema["keep"].dataType).alias("keep"))
    single = F.col("group_size").isNull()
    return linked.unionByName(alone).select(
        "doc_id", "row",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (single | (F.col("row") == F.col("keep.row"))).alias("kept"), "sha256")


def keep_one(docs: DataFrame, prefix: int = PREFIX, buckets: int = BUCKETS) -> DataFrame:
    """The documents that stay, with all their columns."""
    (row,) = fresh(docs, "row")
    rows = numbered(docs, row)
    lost = materialise(copies(rows, False, prefix, buckets, row).where("not kept").select(
        F.col("row").alias(row)), "lost")
    return rows.join(lost, row, "left_anti").select(*columns(docs))
