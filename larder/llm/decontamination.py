"""Benchmark decontamination: documents against a broadcast hash set of normalised test n-grams.

Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. A
window is ``window`` consecutive words of a benchmark item; an item of fewer words is
one window. Distinct windows are broadcast as sorted hashes over word numbers, with
the numbers themselves: a document's windows are looked up by hash and every hit is
verified word by word, so a hash collision costs time and never a result.

The set is bounded: items are normalised by Spark, cut into overlapping pieces and
measured. Up to ``block_bytes`` they are one set and documents are read once. Beyond
it pieces are dealt into blocks of that size, documents are scanned block by block,
and what the blocks hit is united per row, whatever the size of the benchmark.

* Null and empty texts have no words: no hits as a document, no window as an item.
* Long texts are read whole, a block of bytes at a time; a word of more than ``LONG``
  bytes stands in the set as its SHA-256.
* Windows that several items share hit all of them; items with one id count once, and
  a null id is spelled as the empty string. Repeated documents each get their row.
* An empty benchmark hits nothing; an empty corpus gives no rows.
* Only the columns named by ``keep`` are carried, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import LETTERS, fresh, numbered, utf8
from larder.session import materialise, ship_package

WINDOW = 10
# Bytes of normalised benchmark text in one broadcast set, at most twice that.
BLOCK_BYTES = 8 << 20
# Words of a piece of an item; pieces overlap by a window less one word.
PIECE = 1 << 14
# Bytes of a word that is kept as it is.
LONG = 64
# Bytes of a text that are words of their own at a time.
STRETCH = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _short(word: bytes) -> bytes:
    """The word itself, or a name for it that no word has."""
    return word if len(word) <= LONG else b"\x01" + hashlib.sha256(word).hexdigest().encode()


def stretches(text: bytes):
    """Words of a text, some at a time."""
    text = text.translate(LETTERS)
    at = 0
    while at < len(text):
        to = text.find(b" ", at + STRETCH)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


class Windows:
    """Distinct windows of benchmark pieces by length, and the items of each."""

    def __init__(self, pieces: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.numbers, self.items, self.sets = window, {}, sorted({i for i, _ in pieces}), {}
        place = {item: i for i, item in enumerate(self.items)}
        by_length: dict[int, tuple[list, list]] = {}
        for item, piece in pieces:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in piece.split()]
            size = min(window, len(ids))
            if size:
                windows, owners = by_length.setdefault(size, ([], []))
                windows.append(np.lib.stride_tricks.sliding_window_view(np.array(ids, np.uint32), size))
                owners.append(np.full(len(windows[-1]), place[item]))
        self.long = any(w[:1] == b"\x01" for w in self.numbers)
        for size, (windows, owners) in by_length.items():
            rows, of = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([of.ravel(), np.concatenate(owners)], axis=1), axis=0)
            starts = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
            hashes = self._hash(rows)
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            _, many = np.unique(hashes, return_counts=True)
            self.sets[size] = (hashes, order, rows, starts, pairs[:, 1], int(many.max()))

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for column in rows.T:
            out = out * _BASE + column
        return out

    def find(self, text: bytes) -> tuple[int, np.ndarray, list[str]]:
        """Number of words, the hit ones as [from, to) runs, and the items whose windows occur."""
        parts = [np.empty(0, np.uint32)]
        for words in stretches(text):
            if self.long:
                words = list(map(_short, words))
            parts.append(np.fromiter(map(self.numbers.get, words, repeat(0)), np.uint32, len(words)))
        ids = np.concatenate(parts)
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        change, items = None, []
        for size, (hashes, order, rows, starts, owners, many) in self.sets.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            seen = np.lib.stride_tricks.sliding_window_view(ids, size)[at]
            wanted = self._hash(seen)
            first = np.searchsorted(hashes, wanted)
            for nth in range(many):
                here = np.minimum(first + nth, len(hashes) - 1)
                row = order[here]
                ok = (hashes[here] == wanted) & (first + nth < len(hashes))
                ok[ok] = (rows[row[ok]] == seen[ok]).all(axis=1)
                if ok.any():
                    change = np.zeros(len(ids) + 1, np.int64) if change is None else change
                    np.add.at(change, at[ok], 1)
                    np.add.at(change, at[ok] + size, -1)
                    for r in np.unique(row[ok]):
                        items.append(owners[starts[r]:starts[r + 1]])
        if change is None:
            return len(ids), np.empty((0, 2), np.int64), []
        return len(ids), _runs(np.cumsum(change) > 0), [self.items[i] for i in np.unique(np.concatenate(items))]


def _runs(hit: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2)


def united(runs: np.ndarray) -> np.ndarray:
    """Runs that may overlap, as runs that do not."""
    out: list[list[int]] = []
    for start, end in sorted(map(tuple, runs.tolist())):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return np.array(out, np.int64).reshape(-1, 2)


def without(text: bytes, runs: np.ndarray) -> bytes:
    """The text without the words of the runs and what stands between them."""
    if not len(runs):
        return text
    inside = np.frombuffer(text.translate(LETTERS), np.uint8) != 32
    words = _runs(inside)
    out, at = [], 0
    for start, end in runs.tolist():
        out.append(text[at:words[start, 0]])
        at = words[end - 1, 1]
    return b"".join([*out, text[at:]])


def pieces(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, words): normalised items, long ones in overlapping pieces."""

    most = max(PIECE, 2 * window)

    def cut(batches):
        for batch in batches:
            items, out = [], []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                held: list[bytes] = []
                cut_any = False
                for words in stretches(body.as_py()):
                    held += map(_short, words)
                    while len(held) > most + window:
                        items.append(name)
                        out.append(b" ".join(held[:most]))
                        held, cut_any = held[most - window + 1:], True
                if len(held) >= (window if cut_any else 1):
                    items.append(name)
                    out.append(b" ".join(held))
            yield pa.record_batch([pa.array(items, pa.string()), pa.array(out, pa.binary())], ["item", "words"])

    named = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), utf8(text).alias("words"))
    return named.mapInArrow(cut, "item string, words binary").distinct()


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """The benchmark as broadcastable sets of windows, one after the other."""
    cut = materialise(pieces(benchmark, window), "benchmark-pieces")
    size = F.sum(F.octet_length("words") + F.octet_length("item") + 32)
    total = cut.agg(size).first()[0] or 0
    count = -(-total // block_bytes)
    while count > 1:
        block = F.pmod(F.xxhash64("item", "words"), F.lit(count)).cast("int")
        if cut.groupBy(block).agg(size.alias("b")).agg(F.max("b")).first()[0] <= max(2 * block_bytes, 4 * PIECE * (LONG + 2)):
            break
        count *= 2
    for k in range(count):
        part = cut if count == 1 else cut.where(F.pmod(F.xxhash64("item", "words"), F.lit(count)) == k)
        yield Windows([(r["item"], bytes(r["words"])) for r in part.collect()], window)


_FOUND = "n_words long, runs array<long>, items array<string>"


def _finder(shared) -> Column:
    """Column function: a UTF-8 text to its words, hit runs and items."""

    def find(texts: pa.Array) -> pa.Array:
        known, counts, runs, items = shared.value, [], [], []
        for text in texts:
            n, found, whose = known.find(text.as_py())
            counts.append(n)
            runs.append(found.ravel())
            items.append(whose)
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
            ["n_words", "runs", "items"])

    return F.arrow_udf(find, _FOUND)


def _finish(texts: pa.Array, runs: pa.Array) -> pa.Array:
    counts, left = [], []
    for text, found in zip(texts, runs):
        spans = united(np.array(found.as_py() or [], np.int64).reshape(-1, 2))
        counts.append(int((spans[:, 1] - spans[:, 0]).sum()))
        left.append(without(text.as_py(), spans) if len(spans) else None)
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(left, pa.binary())], ["n_hit", "left"])


def hits(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW,
         block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """Columns ``keep`` of every document, ``n_words``, ``n_hit``, ``items`` (sorted) and ``remaining``.

    ``remaining`` is the text without its hit words and what stands between two of
    them, null where nothing was hit.
    """
    spark = docs.sparkSession
    ship_package(spark)
    known = iter(blocks(benchmark, window, block_bytes))
    first, second = next(known, Windows([], window)), next(known, None)
    body, row, found, done = fresh(docs.select(*keep), "body", "row", "found", "done")
    kept = [F.col(f"`{c}`") for c in keep]
    finish = F.arrow_udf(_finish, "n_hit long, left binary")
    docs = docs.select(*kept, utf8(text).alias(body))
    if second is None:
        scanned = docs.withColumn(found, _finder(spark.sparkContext.broadcast(first))(F.col(body)))
    else:
        # A document is met again by its stored number, once per block.
        docs = numbered(docs, row)
        per_block, count = [], None
        for block in _chain(first, second, known):
            shared = spark.sparkContext.broadcast(block)
            part = materialise(docs.select(row, _finder(shared)(F.col(body)).alias(found)).select(row, f"{found}.*"), "hits")
            shared.destroy()
            count = part.select(row, "n_words") if count is None else count
            per_block.append(part.where(F.size("runs") > 0).select(row, "runs", "items"))
        every = per_block[0]
        for part in per_block[1:]:
            every = every.unionByName(part)
        per_row = every.groupBy(row).agg(
            F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
        per_row = count.join(per_row, row, "left").select(row, F.struct("n_words", "runs", "items").alias(found))
        scanned = docs.join(per_row, row)
    return scanned.select(
        *kept, F.col(f"{found}.n_words").alias(found), finish(F.col(body), F.col(f"{found}.runs")).alias(done),
        F.array_sort(F.array_distinct(F.coalesce(F.col(f"{found}.items"), F.array().cast("array<string>")))).alias(body),
    ).select(*kept, F.col(found).alias("n_words"), F.col(f"{done}.n_hit").alias("n_hit"), F.col(body).alias("items"),
             F.decode(F.col(f"{done}.left"), "UTF-8").alias("remaining"))


def _chain(*parts):
    for part in parts[:-1]:
        yield part
    yield from parts[-1]


def digests(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = hits(docs, benchmark, **options)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with the hit spans cut out of their texts."""
    left, *_ = fresh(docs, "left")
    renamed = docs.withColumnsRenamed({c: f"c{i}" for i, c in enumerate(docs.columns)})
    text = f"c{docs.columns.index('text')}"
    found = hits(renamed, benchmark, keep=tuple(renamed.columns), text=text, **options)
    return found.withColumn(text, F.coalesce("remaining", text)).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def without_documents(docs: DataFrame, benchmark: DataFrame, most_share: float = 0.0, **options) -> DataFrame:
    """``docs`` without those of which more than the share ``most_share`` of the words is hit."""
    renamed = docs.withColumnsRenamed({c: f"c{i}" for i, c in enumerate(docs.columns)})
    text = f"c{docs.columns.index('text')}"
    found = hits(renamed, benchmark, keep=tuple(renamed.columns), text=text, **options)
    return found.where(F.col("n_hit") <= F.col("n_words") * F.lit(most_share)).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


SQL = r"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
sized AS (SELECT item, w, least(len(w), 10) AS size FROM items WHERE len(w) > 0),
starts AS (SELECT item, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM sized),
windows AS (SELECT DISTINCT item, size, array_to_string(w[p:p + size - 1], ' ') AS win FROM starts),
sizes AS (SELECT DISTINCT size FROM sized),
places AS (
  SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p
  FROM lowered, sizes WHERE len(w) >= size),
seen AS (SELECT r, size, p, array_to_string(w[p:p + size - 1], ' ') AS win FROM places),
met AS (SELECT r, p, size, item FROM seen JOIN windows USING (size, win)),
words AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + size - 1)) AS q FROM met) GROUP BY r),
whose AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN words USING (r) LEFT JOIN whose USING (r)
"""
