"""SimHash near-duplicates found with covering locality-sensitive hashing.

A fingerprint has a bit set if more than half of a text's shingle hashes have
it. Two fingerprints link at ``RADIUS`` or fewer differing bits. Every bit gets
a non-zero vector over GF(2) of RADIUS + 1 dimensions; for each non-zero vector
``v`` there is a table keyed by the bits whose vector has an odd product with
``v``. The vectors of RADIUS differing bits leave some ``v`` orthogonal to all
of them, so its table does not look at any differing bit: the pair collides
there, always.

* Null and wordless texts have fingerprint zero and link like any other.
* ``component_id`` is the smallest id reachable over links; ids that are null
  are never the smallest unless a component has no other.
* Repeated rows share a component. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from xxhash import xxh64_intdigest

from larder.llm.common import columns, fresh, numbered, utf8
from larder.llm.components import components
from larder.operators.keyed import attach
from larder.session import materialise

RADIUS = 3
SHINGLE = 3
BITS = 64
SEED = 42
# Distinct fingerprints that are compared with each other in one go; larger buckets are split
# by further tables over the bits that their key leaves open.
BUCKET = 1024
LEVELS = 3
# Shingles hashed at a time, which bounds memory for long texts.
BLOCK = 1 << 15

_hash = partial(xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of one UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    total, ones = len(words) - width + 1, np.zeros(BITS, np.int64)
    for at in range(0, total, BLOCK):
        block = words[at:min(at + BLOCK, total) + width - 1]
        shingles = map(b" ".join, zip(*(block[i:] for i in range(width))))
        hashes = np.fromiter(map(_hash, shingles), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


@F.arrow_udf(LongType())
def fingerprint_of(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())


def masks(level: int, radius: int = RADIUS) -> list[int]:
    """Signed masks of the covering tables; each level deals the bits anew.

    The vectors 1 .. 2^(radius+1)-1 are dealt to the bits in turn, in an order
    that depends on the level, so that all masks keep about half of the bits.
    """
    count = (1 << (radius + 1)) - 1
    order = sorted(range(BITS), key=lambda i: xxh64_intdigest(b"%d" % i, seed=level))
    vector = {bit: 1 + place % count for place, bit in enumerate(order)}
    out = []
    for v in range(1, count + 1):
        mask = sum(1 << bit for bit, m in vector.items() if (m & v).bit_count() % 2)
        out.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return out


def _keys(nodes: DataFrame, level: int) -> DataFrame:
    """Rows (fp, mask, key) of the tables of one level; below the first level within their bucket."""
    tables = F.array(*[F.lit(m).cast("long") for m in masks(level)])
    wider = F.explode(tables).alias("more")
    if level == 1:
        out = nodes.select("fp", wider).select("fp", F.col("more").alias("mask"))
    else:
        out = nodes.select("fp", "mask", wider).select(
            "fp", F.col("mask").bitwiseOR(F.col("more")).alias("mask"))
    return out.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def _forest(batches):
    """Edges of a spanning forest of each bucket; rows come sorted by bucket."""
    held = None
    for batch in batches:
        now = tuple(batch.column(c).to_numpy() for c in ("mask", "key", "fp"))
        if held is not None:
            now = tuple(np.concatenate(p) for p in zip(held, now))
        mask, key, fp = now
        new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        last = int(new[-1]) if len(new) else 0
        yield _edges(fp[:last], np.concatenate(([0], new))[:-1] if last else np.zeros(0, int))
        held = tuple(p[last:] for p in now)
    if held is not None and len(held[2]):
        yield _edges(held[2], np.zeros(1, int))


def _edges(fp: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    ends = np.append(starts[1:], len(fp)) if len(starts) else starts
    pairs = []
    two = ends - starts == 2
    a, b = fp[starts[two]], fp[starts[two] + 1]
    near = np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS
    pairs.append(np.stack([a[near], b[near]], 1))
    for at, to in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
        pairs.append(_spanning(fp[at:to]))
    out = np.concatenate(pairs)
    return pa.record_batch([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])


def _spanning(members: np.ndarray) -> np.ndarray:
    """Star edges (smallest, member) of the connected parts of one bucket."""
    members = np.unique(members)
    left, edges = np.ones(len(members), bool), []
    for root in range(len(members)):
        if not left[root]:
            continue
        left[root], reached = False, [root]
        for at in reached:
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count((members[rest] ^ members[at]).view(np.uint64)) <= RADIUS]
            left[near] = False
            reached.extend(near.tolist())
        edges += [(members[root], members[i]) for i in reached[1:]]
    return np.array(edges, np.int64).reshape(-1, 2)


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``nodes`` (fp) that connect exactly what links connect.

    A bucket of more than ``bucket`` fingerprints is not compared as it is: the
    covering tables of the next level split it, and keep every pair within the
    radius together in one of them. After three levels a key fixes all but a
    few bits, so a bucket has a few hundred distinct fingerprints at most.
    """
    work, done = _keys(nodes, 1), None
    for level in range(1, LEVELS + 1):
        calm = work
        if level < LEVELS:
            hot = materialise(
                work.groupBy("mask", "key").count().where(F.col("count") > bucket).drop("count"), "hot")
            if hot.isEmpty():
                done = calm if done is None else done.unionByName(calm)
                break
            calm = work.join(hot, ["mask", "key"], "left_anti")
            work = _keys(work.join(hot, ["mask", "key"], "left_semi"), level + 1)
        calm = calm.select("fp", "mask", "key")
        done = calm if done is None else done.unionByName(calm)
    ordered = done.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return ordered.mapInArrow(_forest, "a long, b long").distinct()


def fingerprints(docs: DataFrame, number: str | None = None) -> DataFrame:
    """doc_id, row (the column ``number``, or a number given here) and fp of every document."""
    place = F.col(number) if number else F.monotonically_increasing_id()
    return docs.select("doc_id", place.alias("row"), fingerprint_of(utf8()).alias("fp"))


def classes(docs: DataFrame, bucket: int = BUCKET, number: str | None = None) -> DataFrame:
    """doc_id, row, fp, root (of the fingerprint) and component_id of every document."""
    marked = materialise(fingerprints(docs, number), "fingerprints")
    nodes = materialise(
        marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_docs")), "nodes")
    roots = components(links(nodes.select("fp"), bucket))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_fps"))
    facts = attach(rooted.select("fp", "n_docs", "root"), least, ["root"], "n_fps", spread=["fp"])
    facts = materialise(facts.select("fp", "n_docs", "root", "component_id"), "classes")
    return attach(marked, facts, ["fp"], "n_docs", spread=["row"]).select(
        "doc_id", "row", "fp", "root", "component_id")


def keep_one(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Documents with all columns, one of each component: the one with the smallest id.

    Of repeated rows with that id, and of a component without ids, the first row stays.
    """
    (row,) = fresh(docs, "row")
    rows = numbered(docs, row)
    found = materialise(classes(rows, bucket, row), "members")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min("row").alias("row"))
    lost = materialise(found.select("row").join(first, "row", "left_anti").select(
        F.col("row").alias(row)), "lost")
    return rows.join(lost, row, "left_anti").select(*columns(docs))
