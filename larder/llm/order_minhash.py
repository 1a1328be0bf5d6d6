"""Order MinHash fingerprints, in DataFrame functions only.

A text is cut into words (an ideograph counts as one) and these into k-mers of
``KMER`` words; the j-th occurrence of a k-mer is an item of its own. Each of
``SKETCHES`` hash functions ranks the items and picks the minimal one of either
sign, the two picked items keep the order they have in the text, and the pair is
hashed. Two texts agree in a sketch only if they share both items in the same
order, which makes the share of equal sketches follow the edit distance.

* Null and wordless texts have a fingerprint of their own, equal to each other's only.
* Equal texts have equal fingerprints. Texts shorter than a k-mer are one k-mer.
* An empty table gives an empty result.
* Of a text over 2^24 words positions count modulo 2^24.
* The next document is the next row by (doc_id, text), after the last the first;
  rows without an id have no place in that order and are followed by an empty text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import whole
from larder.session import materialise

SKETCHES = 32
KMER = 5
# Low bits that hold a position, below the bits of a hash.
PLACE = (1 << 24) - 1
# Ids in a row of 2^BLOCK_BITS are one block; a block has at most that many distinct ids.
BLOCK_BITS = 10
# Blocks in a row of 2^SUPER_BITS are ordered together.
SUPER_BITS = 12
# Characters that are words by themselves, in scripts without spaces.
IDEOGRAPHS = r"[\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]"


def words(text: Column) -> Column:
    apart = F.when(F.regexp_like(text, F.lit(IDEOGRAPHS)),
                   F.regexp_replace(text, f"({IDEOGRAPHS})", " $1 ")).otherwise(text)
    return F.filter(F.split(apart, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def kmers(w: Column, k: int = KMER) -> Column:
    """Hash and position of every k-mer, packed in one number, sorted."""
    many = F.when(F.size(w) == 0, 0).otherwise(F.greatest(F.size(w) - F.lit(k - 1), F.lit(1)))
    zipped = F.arrays_zip(*[F.slice(w, F.lit(i + 1), many).alias(f"w{i}") for i in range(k)])
    packed = F.transform(zipped, lambda z, i: F.xxhash64(z).bitwiseAND(F.lit(~PLACE)).bitwiseOR(
        i.cast("long").bitwiseAND(F.lit(PLACE))))
    return F.sort_array(packed)


def run_starts(packed: Column) -> Column:
    """Where runs of equal hashes start in sorted k-mers."""
    hashed = lambda i: F.shiftright(F.get(packed, i), 24)
    return F.filter(F.sequence(F.lit(0), F.size(packed) - 1), lambda i: (i == 0) | (hashed(i) != hashed(i - 1)))


def occurrences(starts: Column, total: Column) -> Column:
    """Occurrence number of every sorted k-mer: it counts from one in each run."""
    runs = F.flatten(F.transform(starts, lambda s, j: F.sequence(
        F.lit(1), F.coalesce(F.get(starts, j + 1), total) - s)))
    return F.when(F.size(starts) == total, F.array_repeat(F.lit(1), total)).otherwise(runs)


def sketches(texts: DataFrame, keys: list[str], text: str, k: int = KMER, count: int = SKETCHES) -> DataFrame:
    """``keys`` and the fingerprint of each row; keys must tell the rows apart.

    Rows are expected to be partitioned by one of the keys already: then neither
    words nor k-mers are shuffled.
    """
    items = texts.select(*keys, words(F.col(text)).alias("w")).select(*keys, kmers(F.col("w"), k).alias("packed"))
    items = items.withColumn("starts", F.when(F.size("packed") > 0, run_starts(F.col("packed"))))
    nth = occurrences(F.col("starts"), F.size("packed"))
    items = items.select(*keys, F.explode_outer(F.when(F.size("packed") > 0, F.arrays_zip(
        F.col("packed").alias("p"), nth.alias("nth")))).alias("item"))
    item = F.when(F.col("item").isNotNull(), F.xxhash64(F.shiftright(F.col("item.p"), 24), F.col("item.nth")))
    ranked = items.select(*keys, item.alias("h"), F.col("item.p").bitwiseAND(F.lit(PLACE)).alias("at")).select(
        *keys, "at", *[F.when(F.col("h").isNotNull(), F.xxhash64("h", F.lit(j))).alias(f"g{j}") for j in range(count)])
    mins = []
    for j in range(count):
        g = F.col(f"g{j}")
        value = g.bitwiseAND(F.lit(~PLACE)).bitwiseOR(F.col("at"))
        mins += [F.min(F.when(g >= 0, value)).alias(f"a{j}"), F.min(F.when(g < 0, value)).alias(f"b{j}")]
    least = ranked.groupBy(*keys).agg(*mins)

    def sketch(j: int) -> Column:
        a, b = F.col(f"a{j}"), F.col(f"b{j}")
        rank = lambda c: F.shiftright(c, 24)
        later = a.bitwiseAND(F.lit(PLACE)) > b.bitwiseAND(F.lit(PLACE))
        pair = F.when(later, F.xxhash64(rank(b), rank(a))).otherwise(F.xxhash64(rank(a), rank(b)))
        return F.lpad(F.hex(pair.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")

    return least.select(*keys, F.lower(F.concat(*[sketch(j) for j in range(count)])).alias("fingerprint"))


def likeness(a: Column, b: Column, count: int = SKETCHES) -> Column:
    """Share of equal sketches of two fingerprints."""
    same = [(F.substring(a, 8 * j + 1, 8) == F.substring(b, 8 * j + 1, 8)).cast("int") for j in range(count)]
    return reduce(lambda x, y: x + y, same) / F.lit(float(count))


def fingerprints(docs: DataFrame, k: int = KMER, count: int = SKETCHES) -> DataFrame:
    """doc_id and fingerprint of every document; rows stay where they are but for one exchange of sketches."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), whole().alias("body"))
    return sketches(rows, ["doc_id", "row"], "body", k, count).drop("row")


def _guests(docs: DataFrame) -> DataFrame:
    """(guest_id, host): the first id of each block is also sent to the block before it.

    Only ids are read. Blocks are ordered inside groups of 2^SUPER_BITS; the one
    global order is over the groups, a row for each four million ids.
    """
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"))
    firsts = ids.groupBy(F.shiftright("id", BLOCK_BITS).alias("block")).agg(F.min("id").alias("first"))
    firsts = firsts.withColumn("super", F.shiftright("block", SUPER_BITS))
    inside = firsts.withColumn("next", F.lead("first").over(Window.partitionBy("super").orderBy("block")))
    heads = firsts.groupBy("super").agg(F.min("first").alias("head"))
    order = Window.orderBy("super")
    heads = heads.select("super", F.coalesce(
        F.lead("head").over(order), F.min("head").over(Window.orderBy(F.lit(1)))).alias("after"))
    return materialise(inside.join(heads, "super").select(
        F.coalesce("next", "after").alias("guest_id"), F.col("block").alias("host")), "guests")


def with_next(docs: DataFrame) -> DataFrame:
    """Documents in blocks, each beside the text of the next: block, place, guest, doc_id, body, next_body.

    A block of consecutive ids is one window; the row that follows its last one
    visits as a guest. Texts are exchanged once.
    """
    rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("id"), whole().alias("body"))
    # Rows without an id are dealt by their text, below all blocks of ids.
    apart = F.lit(-(1 << 60)) + F.shiftright(F.xxhash64("body"), 52)
    home = F.coalesce(F.shiftright("id", BLOCK_BITS), apart)
    sent = rows.join(_guests(docs), F.col("id") == F.col("guest_id"), "left").select(
        "doc_id", "id", "body", F.explode(F.array_compact(F.array(
            F.struct(home.alias("block"), F.lit(False).alias("guest")),
            F.when(F.col("host").isNotNull(), F.struct(F.col("host").alias("block"), F.lit(True).alias("guest"))),
        ))).alias("stay")).select("doc_id", "id", "body", "stay.*")
    order = Window.partitionBy("block").orderBy("guest", "id", "body")
    following = F.when(F.col("id").isNotNull(), F.lead("body").over(order))
    return sent.select("block", F.row_number().over(order).alias("place"), "guest", "doc_id", "id", "body",
                       F.coalesce(following, F.lit("")).alias("next_body"))


def edited_pairs(docs: DataFrame, k: int = KMER, count: int = SKETCHES) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    The edit replaces the last quarter of the code points by the first as many
    of the next document.
    """
    n = F.length("body")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), n - tail), F.substring(F.col("next_body"), F.lit(1), tail))
    rows = with_next(docs).select("block", "place", "guest", "doc_id", "id", "body", edited.alias("edited"))
    keys = ["block", "place", "guest", "doc_id", "id", "n_chars", "edited_sha256", "which"]
    both = rows.select(
        "block", "place", "guest", "doc_id", "id", n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("body").alias("text")),
                          F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("t"),
    ).select(*keys[:-1], "t.*").where("not guest or which = 0")
    prints = sketches(both, keys, "text", k, count)
    pairs = prints.groupBy(*keys[:-1]).agg(
        F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    # What follows a row without an id is the empty text.
    none = _empty_fingerprint(k, count)
    after = F.when(F.col("id").isNotNull(), F.lead("fingerprint").over(Window.partitionBy("block").orderBy("place")))
    pairs = pairs.withColumn("after", F.coalesce(after, none)).where("not guest")
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), count).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("after"), count).alias("near_next"))


def _empty_fingerprint(k: int, count: int) -> Column:
    """What ``sketches`` gives a text without words: pairs of two nulls."""
    none = F.lit(None).cast("long")
    pair = F.lower(F.lpad(F.hex(F.xxhash64(none, none).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.repeat(pair, count)
