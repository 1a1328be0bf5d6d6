"""Masked pseudo-likelihood scores from a bidirectional window network.

The network predicts a token from the ``WINDOW`` tokens on either side of it:
their embeddings, one hidden layer, then the token's class and the token within
its class. A document's score is the sum of the log-probabilities of all its
tokens, each given both sides.

Vocabulary, counts and training cover the whole corpus. The network starts from
the frequencies of the tokens. Each round every partition trains on its own
documents, a hash-chosen share of the positions masked; the shares of the rounds
are disjoint and together all positions. The parameters are averaged by weight of the
positions seen: distributed, as lines of parameters that are added up in two steps, so
the driver only gets one network.

* Null, empty and wordless texts have no tokens and a log-likelihood of zero;
  their mean is null.
* Texts are scored whole. A word outside the vocabulary has the probability of that
  class of words in its place times that of its spelling: bytes, each given the two
  before it, counted over all such words of the corpus.
* Equal texts have equal scores but for the rounding of 32-bit sums. Over an empty table the result is empty.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import LETTERS, LINES, sent, summed, utf8
from larder.session import materialise

WINDOW = 2
EMBED, HIDDEN = 16, 32
CLASSES, MEMBERS = 64, 32
SIZE = CLASSES * MEMBERS
PAD, OTHER = 0, 1
# Rounds times share is one: every position is a target once.
ROUNDS, MASKED = 2, 0.5
STEP, RATE = 4096, 0.2
# Greatest logit.
TOP = 60.0
# Parameters that travel together.
LINE = 1 << 12
# Tokens scored at a time.
BLOCK = 1 << 14
# Symbols of a spelling: the bytes that words have, from one; zero is the end of a word.
_SPELLED = sorted(set(LETTERS) - {32})
SYMBOLS = len(_SPELLED) + 1
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[_SPELLED] = np.arange(1, SYMBOLS)
# Weight of the shorter context in the longer one.
BACK = 5.0
# Distinct words a task counts before it passes them on.
HELD = 1 << 18

SHAPES = {
    "embed": (SIZE, EMBED), "inner": (2 * WINDOW * EMBED, HIDDEN), "inner_b": (HIDDEN,),
    "group": (HIDDEN, CLASSES), "group_b": (CLASSES,),
    "member": (CLASSES, HIDDEN, MEMBERS), "member_b": (CLASSES, MEMBERS),
}
Network = dict[str, np.ndarray]


def words(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def vocabulary(docs: DataFrame, size: int = SIZE) -> dict[bytes, int]:
    """Ids of the most frequent words of the whole corpus, ties by the word; a bounded table."""

    def count(batches):
        held = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(words(text.as_py()))
                if len(held) > HELD:
                    yield _counts(held)
                    held = Counter()
        yield _counts(held)

    partial = docs.select(utf8().alias("body")).mapInArrow(count, "word binary, n long")
    top = partial.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size - 2)
    rows = sorted(top.collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    return {bytes(r["word"]): i + 2 for i, r in enumerate(rows)}


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def tokens(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """doc_id, the token ids of every document as little-endian 16-bit numbers, and its other words.

    Each of the other words, in ``rare``, is ended by a space.
    """

    def encode(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            listed = words(text.as_py())
            found = np.fromiter(map(ids.get, listed, repeat(OTHER)), "<u2", len(listed))
            rare = [listed[i] for i in np.flatnonzero(found == OTHER).tolist()]
            out.append({"ids": found.tobytes(), "rare": b" ".join([*rare, b""])})
        return pa.array(out, pa.struct([("ids", pa.binary()), ("rare", pa.binary())]))

    made = F.arrow_udf(encode, "ids binary, rare binary")(utf8()).alias("made")
    return docs.select("doc_id", made).select("doc_id", "made.ids", "made.rare")


def _trigrams(rare: bytes):
    """Numbers of (second last, last, next) symbol of spellings, in blocks; words do not see each other."""
    s = np.concatenate([np.zeros(2, np.uint8), _SYMBOL[np.frombuffer(rare, np.uint8)]])
    for at in range(2, len(s), BLOCK):
        c = s[at:at + BLOCK].astype(np.int64)
        b = s[at - 1:at - 1 + len(c)].astype(np.int64)
        yield (np.where(b > 0, s[at - 2:at - 2 + len(c)], 0) * SYMBOLS + b) * SYMBOLS + c


def spelling(coded: DataFrame) -> np.ndarray:
    """Log-probability of every symbol after every two, from all words in ``rare``; a table of fixed size."""

    def count(batches):
        held = np.zeros(SYMBOLS ** 3, np.int64)
        for batch in batches:
            for rare in batch.column(0):
                for at in _trigrams(rare.as_py()):
                    np.add.at(held, at, 1)
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array(at), pa.array(held[at])], ["at", "n"])

    met = coded.select("rare").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    return smoothed(met["at"].to_numpy(), met["n"].to_numpy())


def smoothed(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts of trigrams as log-probabilities: no spelling is impossible but the empty one."""
    three = np.zeros(SYMBOLS ** 3)
    three[at] = n
    three = three.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = three.sum(0)
    one = two.sum(0) + 1
    two += BACK * one / one.sum()
    two /= two.sum(-1, keepdims=True)
    three += BACK * two
    three[0, 0, 0] = 0
    three /= three.sum(-1, keepdims=True)
    with np.errstate(divide="ignore"):
        return np.log(three).astype(np.float32).ravel()


def spelled(table: np.ndarray, rare: bytes) -> float:
    """Summed log-probability of the spellings in ``rare``."""
    return sum(float(table[at].sum(dtype=np.float64)) for at in _trigrams(rare))


def initial(seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)
    return {k: np.zeros(s, np.float32) if k.endswith("_b") else
            (rng.standard_normal(s) / np.sqrt(s[-2] if k != "embed" else EMBED)).astype(np.float32) for k, s in SHAPES.items()}


def flatten(net: Network) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in SHAPES])


def unflatten(values: np.ndarray) -> Network:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at:at + n].reshape(s).astype(np.float32)
        at += n
    return out


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens in one array, texts parted by padding, and the places of the tokens."""
    gap = np.full(WINDOW, PAD, np.int64)
    parts = [gap]
    for t in texts:
        parts += [t.astype(np.int64), gap]
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = WINDOW + np.cumsum(lengths + WINDOW) - (lengths + WINDOW)
    places = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    return np.concatenate(parts), places


_AROUND = np.array([d for d in range(-WINDOW, WINDOW + 1) if d])


def _softmax(x: np.ndarray, of: tuple[np.ndarray, np.ndarray], axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probability of the entries ``of`` along an axis; exponentials of all, in place; their sums.

    Logits are cut at ``TOP``, which no trained network comes near: their exponentials
    then need no scaling.
    """
    np.minimum(x, TOP, out=x)
    score = x[of]
    np.exp(x, out=x)
    total = x.sum(axis=axis, keepdims=True)
    return score - np.log(total.ravel()), x, total


def _runs(groups: np.ndarray):
    """(class, rows) of each class among ``groups``, in which rows are sorted by class."""
    cuts = np.flatnonzero(np.diff(groups)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(groups)]):
        if b > a:
            yield groups[a], slice(a, b)


def forward(net: Network, flat: np.ndarray, places: np.ndarray):
    """Log-probability of the tokens at ``places``, sorted by class, and what the gradient needs.

    Classes stand in rows and tokens in columns, so that sums over classes run along memory.
    """
    targets = flat[places]
    order = np.argsort((targets // MEMBERS).astype(np.uint8), kind="stable")
    places, targets = places[order], targets[order]
    around = flat[places[:, None] + _AROUND]
    x = net["embed"].take(around, axis=0).reshape(len(places), -1)
    hidden = x @ net["inner"]
    hidden += net["inner_b"]
    np.tanh(hidden, out=hidden)
    group, member = targets // MEMBERS, targets % MEMBERS
    of_group = net["group"].T @ hidden.T
    of_group += net["group_b"][:, None]
    of_member = np.empty((len(places), MEMBERS), hidden.dtype)
    for g, some in _runs(group):
        np.matmul(hidden[some], net["member"][g], out=of_member[some])
        of_member[some] += net["member_b"][g]
    at = np.arange(len(places))
    score, of_group, groups = _softmax(of_group, (group, at), 0)
    inside, of_member, members = _softmax(of_member, (at, member), 1)
    return score + inside, order, (around, x, hidden, group, member, of_group, groups, of_member, members)


def gradient(net: Network, flat: np.ndarray, places: np.ndarray) -> dict[str, tuple[np.ndarray | slice, np.ndarray]]:
    """Gradient of the mean negative log-probability of the tokens at ``places``.

    Per parameter the rows it touches and their values: words and classes that do not
    occur have none.
    """
    _, _, (around, x, hidden, group, member, d_group, groups, d_member, members) = forward(net, flat, places)
    n, at, everything = len(places), np.arange(len(places)), slice(None)
    groups *= n
    members *= n
    d_group /= groups
    d_member /= members
    d_group[group, at] -= 1 / n
    d_member[at, member] -= 1 / n
    runs = list(_runs(group))
    classes = np.array([g for g, _ in runs])
    d_hidden = d_group.T @ net["group"].T
    of_class, of_class_b = (
        np.empty((len(runs), *shape), hidden.dtype) for shape in ((HIDDEN, MEMBERS), (MEMBERS,)))
    for i, (g, some) in enumerate(runs):
        np.matmul(hidden[some].T, d_member[some], out=of_class[i])
        d_member[some].sum(axis=0, out=of_class_b[i])
        d_hidden[some] += d_member[some] @ net["member"][g].T
    d_hidden *= 1 - hidden * hidden
    d_x = (d_hidden @ net["inner"].T).reshape(-1, EMBED)
    ids = around.ravel()
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    return {"group": (everything, (d_group @ hidden).T), "group_b": (everything, d_group.sum(axis=1)),
            "member": (classes, of_class), "member_b": (classes, of_class_b),
            "inner": (everything, x.T @ d_hidden), "inner_b": (everything, d_hidden.sum(0)),
            "embed": (ids[order][first], np.add.reduceat(d_x.take(order, axis=0), first))}


class Adagrad:
    def __init__(self, net: Network):
        self.net = {k: v.copy() for k, v in net.items()}
        self.seen = {k: np.full(v.shape, 1e-6, np.float32) for k, v in net.items()}

    def step(self, flat: np.ndarray, places: np.ndarray) -> None:
        for k, (rows, g) in gradient(self.net, flat, places).items():
            self.seen[k][rows] += g * g
            self.net[k][rows] -= RATE * g / np.sqrt(self.seen[k][rows])


def masks(text: np.ndarray, number: int, masked: float) -> np.ndarray:
    """Targets of a round: they depend on the text and the round only, and rounds take one share after the other."""
    mixed = (np.arange(1, len(text) + 1, dtype=np.uint64) + np.uint64(zlib.crc32(text.tobytes()) << 20)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    place = (mixed >> np.uint64(11)) / 2.0**53
    return (place - number * masked) % 1.0 < masked


def frequencies(coded: DataFrame) -> np.ndarray:
    """How often each token is in the corpus, plus one."""

    def count(batches):
        held = np.zeros(SIZE, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                held += np.bincount(np.frombuffer(ids.as_py(), "<u2"), minlength=SIZE)
        yield pa.record_batch([pa.array(np.arange(SIZE)), pa.array(held)], ["id", "n"])

    met = coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.ones(SIZE)
    out[met["id"].to_numpy()] += met["n"].to_numpy()
    return out


def train(coded: DataFrame, rounds: int = ROUNDS, masked: float = MASKED) -> Network:
    """One network from all documents of ``coded``."""
    net, often = initial(), frequencies(coded).reshape(CLASSES, MEMBERS)
    net["group_b"] = np.log(often.sum(1) / often.sum()).astype(np.float32)
    net["member_b"] = np.log(often / often.sum(1, keepdims=True)).astype(np.float32)
    for number in range(rounds):
        start = flatten(net)

        def local(batches, start=start, number=number):
            learner, n = Adagrad(unflatten(start)), 0
            for batch in batches:
                texts = [np.frombuffer(t.as_py(), "<u2") for t in batch.column(0)]
                flat, places = padded(texts)
                keep = np.concatenate([np.empty(0, bool)] + [masks(t, number, masked) for t in texts])
                chosen = places[keep]
                for at in range(0, len(chosen), STEP):
                    learner.step(flat, chosen[at:at + STEP])
                n += len(chosen)
            if n:
                # The weight goes behind the parameters, and all of them as a few long lines.
                sums = np.append(flatten(learner.net).astype(np.float64) * n, n)
                yield sent(np.pad(sums, (0, -len(sums) % LINE)).reshape(-1, LINE))

        lines = -(-(len(start) + 1) // LINE)
        sums = summed(coded.select("ids").mapInArrow(local, LINES), lines, LINE).ravel()
        if not sums[len(start)]:
            break
        net = unflatten(sums[:len(start)] / sums[len(start)])
    return net


def log_likelihood(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Summed log-probability of every text."""
    flat, places = padded(texts)
    score = np.empty(len(places))
    for at in range(0, len(places), BLOCK):
        part, order, _ = forward(net, flat, places[at:at + BLOCK])
        score[at:at + BLOCK][order] = part
    ends = np.cumsum([0] + [len(t) for t in texts])
    return np.array([score[a:b].sum() for a, b in zip(ends, ends[1:])], float)


def scores(docs: DataFrame, size: int = SIZE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and mean_log_likelihood of every document."""
    coded = materialise(tokens(docs, vocabulary(docs, size)), "tokens")
    # Network and spellings have a fixed size: a few hundred kilobytes, and 18 MB.
    values, table = flatten(train(coded, rounds)), spelling(coded)
    held = {}

    def score(ids: pa.Array, rare: pa.Array) -> pa.Array:
        if not held:
            held["net"] = unflatten(values)
        out, group, held_tokens = [np.empty(0)], [], 0
        for i in ids:
            group.append(np.frombuffer(i.as_py(), "<u2"))
            held_tokens += len(group[-1])
            if held_tokens >= BLOCK:
                out.append(log_likelihood(held["net"], group))
                group, held_tokens = [], 0
        out.append(log_likelihood(held["net"], group))
        return pa.array(np.concatenate(out) + [spelled(table, r.as_py()) for r in rare])

    n = F.expr("octet_length(ids) div 2").cast("long")
    rows = coded.select("doc_id", n.alias("n_tokens"), F.arrow_udf(score, "double")(F.col("ids"), F.col("rare")).alias("log_likelihood"))
    return rows.select("doc_id", "n_tokens", "log_likelihood", F.when(
        F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))
