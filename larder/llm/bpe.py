"""Byte-level BPE by tree concatenation, and its decoding.

A text longer than a leaf is cut into leaves that are encoded in parallel, as
rows of their own. Neighbours are then joined level by level: a window of tokens
on both sides of the join is encoded again and grown until its first token is
the one the left side has there and its last token the one the right side has.
A token sequence of byte-level BPE is right if and only if every two
neighbouring tokens are, and inside the window they are by construction while
outside they were before; one shared token on each side is thus enough. The
split into words knows contractions and looks past white space, so a window has
three characters of both sides and does not end in white space unless the text
does. The joined tokens equal those of the whole text, not approximately but exactly.

* Null texts count as empty and have no tokens.
* Strings of special tokens are cut out first and never split; they become their id.
* Repeated rows each get their row. An empty table gives an empty result. Only the columns
  named by ``keep`` are carried, so extra ones cannot clash.
* Tokens travel as bytes: little-endian unsigned 32-bit ids.
* The vocabulary is a file outside the repository, named by path.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import fresh, utf8

# Bytes of a leaf.
LEAF = 1 << 14
# Bytes of names of long documents that are sent to every task; more are joined by a shuffle.
SENT = 64 << 20
# Tokens on each side of a join that are encoded again at first.
WINDOW = 8
IDS = np.dtype("<u4")
# Fixed value: characters of the longest contraction that the split knows.
CONTEXT = 3


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _printable() -> dict[str, int]:
    """Byte-level alphabet: the character that stands for each byte in a vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    # Fixed value: how byte-level BPE splits a text before merging.
    SPLIT = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _printable()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = {s.encode(): i for s, i in special.items()}
        self.bytes = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for token, i in [*ranks.items(), *self.special.items()]:
            self.bytes[i] = token
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.core = tiktoken.Encoding("own", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.allowed = set(special)

    def encode(self, text: bytes) -> np.ndarray:
        return np.array(self.core.encode(text.decode(), allowed_special=self.allowed, disallowed_special=()), IDS)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def leaves(self, text: bytes, leaf: int) -> list[bytes]:
        """The text in pieces of about ``leaf`` bytes, cut between characters and outside special strings."""
        out, at = [], 0
        while len(text) - at > leaf:
            to = at + leaf
            while text[to] & 0xC0 == 0x80:
                to -= 1
            for s in self.special:
                near = text.find(s, max(at, to - len(s) + 1), to + len(s) - 1)
                if 0 <= near < to < near + len(s):
                    to = near if near > at else near + len(s)
            out.append(text[at:to])
            at = to
        return [*out, text[at:]]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _starts_character(data: bytes, at: int) -> bool:
    return at == len(data) or data[at] & 0xC0 != 0x80


def join(vocab: Vocabulary, left: np.ndarray, right: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Tokens of the concatenated text of two exact token sequences."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    wide = window
    while True:
        a, b = max(0, len(left) - wide), min(len(right), wide)
        tail, head = vocab.decode(left[a:]), vocab.decode(right[:b])
        # A token may end inside a character: such a window has no text of its own.
        after = vocab.decode(right[b:b + 1])
        if not (_starts_character(tail, 0) and _starts_character(after, 0) or a == 0 and b == len(right)):
            wide += 1
            continue
        before, after = tail.decode(), head.decode()
        # A contraction may lie across the join, and white space is split by what follows it.
        if (a > 0 and len(before) < CONTEXT) or (
                b < len(right) and (len(after) < CONTEXT or after[-1].isspace())):
            wide *= 2
            continue
        middle = vocab.encode(tail + head)
        agree_left = a == 0 or middle[0] == left[a]
        agree_right = b == len(right) or middle[-1] == right[b - 1]
        if agree_left and agree_right:
            return np.concatenate([left[:a], middle, right[b:]])
        wide *= 2


def tree(vocab: Vocabulary, parts: list[np.ndarray], window: int = WINDOW) -> np.ndarray:
    """Neighbours joined level by level until one sequence is left."""
    while len(parts) > 1:
        pairs = [join(vocab, *parts[i:i + 2], window) if i + 1 < len(parts) else parts[i]
                 for i in range(0, len(parts), 2)]
        parts = pairs
    return parts[0]


def _ids(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(data.as_py(), IDS)


def _text(vocab: Vocabulary, ids: np.ndarray) -> str:
    """Decoded text; characters of which tokens hold a part only are replaced."""
    return vocab.decode(ids).decode("utf-8", "replace")


def _coder(path: str, back: bool):
    """Column function: UTF-8 text to its tokens and, if ``back``, the text decoded from them."""

    def code(texts: pa.Array) -> pa.Array:
        vocab, ids, decoded = vocabulary(path), [], []
        for text in texts:
            found = vocab.encode(text.as_py())
            ids.append(found.tobytes())
            decoded.append(_text(vocab, found) if back else None)
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["ids", "decoded"])

    return F.arrow_udf(code, "ids binary, decoded string")


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with the text of their tokens; null tokens give a null text."""
    path = path or default_vocabulary()

    def texts(coded: pa.Array) -> pa.Array:
        vocab = vocabulary(path)
        return pa.array([_text(vocab, _ids(i)) if i.is_valid else None for i in coded], pa.string())

    return rows.withColumn(out, F.arrow_udf(texts, "string")(F.col(ids)))


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF, window: int = WINDOW,
           back: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``ids`` (the tokens of every whole text) and ``decoded``.

    ``decoded`` is the text the tokens decode to, made beside them where ``back``
    asks for it, else null.
    """
    path = path or default_vocabulary()
    body, row, nth, coded = fresh(docs.select(*keep), "body", "row", "nth", "coded")
    kept = [F.col(f"`{c}`") for c in keep]
    named = docs.select(*kept, utf8().alias(body))
    short = named.where(F.octet_length(body) <= leaf).select(*kept, _coder(path, back)(F.col(body)).alias(coded)).select(
        *kept, f"{coded}.ids", f"{coded}.decoded")

    def cut(batches):
        vocab = vocabulary(path)
        for batch in batches:
            for number, text in zip(batch.column(row).to_pylist(), batch.column(body)):
                parts = vocab.leaves(text.as_py(), leaf)
                yield pa.record_batch([pa.array([number] * len(parts), pa.binary()),
                                       pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], [row, nth, body])

    def grow(table: pa.Table) -> pa.Table:
        table, vocab = table.sort_by(nth), vocabulary(path)
        ids = tree(vocab, [_ids(i) for i in table.column("ids")], window)
        return pa.table([table.column(row)[:1], pa.array([ids.tobytes()], pa.binary()),
                         pa.array([_text(vocab, ids) if back else None], pa.string())], [row, "ids", "decoded"])

    # A long text goes by its digest, which is the same in every scan; copies of it are encoded once.
    long = named.where(F.octet_length(body) > leaf).withColumn(row, F.unhex(F.sha2(body, 256)))
    leaves = long.select(row, body).mapInArrow(cut, f"`{row}` binary, `{nth}` long, `{body}` binary")
    # Dealt by leaf, not by text: the leaves of one long text are encoded in parallel.
    tokens = leaves.dropDuplicates([row, nth]).select(row, nth, _coder(path, False)(F.col(body)).alias(coded)).select(
        row, nth, f"{coded}.ids")
    grown = tokens.groupBy(row).applyInArrow(grow, f"`{row}` binary, ids binary, decoded string")
    named_long = long.drop(body)
    narrow = not any(t in named_long.schema[c].dataType.simpleString() for c in keep for t in ("string", "binary", "<"))
    # Tokens stay where they were joined if the documents' names fit beside them: counted, and of fixed width.
    if narrow and long.count() <= SENT // (64 + 16 * len(keep)):
        named_long = F.broadcast(named_long)
    return short.unionByName(grown.join(named_long, row).select(*kept, "ids", "decoded"))


def digests(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    coded = encode(docs, path, leaf, back=True)
    return coded.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
