import hashlib
import random
import re

import pytest

from larder.llm import decontamination
from helpers import AWKWARD, docs, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window=10):
    """Per text its words, hit places and items, by comparing every window with every other."""
    out = []
    for text in texts:
        words, hit, whose = split(text), set(), set()
        for item, body in items:
            w = split(body)
            n = min(window, len(w))
            for i in range(len(w) - n + 1) if n else ():
                for j in range(len(words) - n + 1):
                    if words[j:j + n] == w[i:i + n]:
                        hit |= set(range(j, j + n))
                        whose.add("" if item is None else str(item))
        out.append((len(words), len(hit), len(whose), hashlib.sha256(",".join(sorted(whose)).encode()).hexdigest(), bool(hit)))
    return out


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


ITEMS = [(10, prose(50, 30)), (9, prose(51, 12)), (2, "Short Item"), (None, prose(50, 30)), (9, prose(52, 15)),
         (3, None), (4, " .,! "), (5, "y" * 200 + " x " + prose(53, 9)), (2, "Short Item")]


def cases():
    rng, texts = random.Random(3), list(AWKWARD)
    for i in range(30):
        item = rng.choice(ITEMS)[1] or ""
        words = item.split()
        at = rng.randrange(max(1, len(words) - 8))
        part = " ".join(words[at:at + rng.randrange(8, 14)])
        texts.append(f"{prose(100 + i, 20)}. {part.upper() if i % 3 == 0 else part}, {prose(200 + i, 5)}")
    return [*texts, prose(50, 30) + "! " + prose(51, 12) + " short ITEM", "y" * 200 + "-x-" + prose(53, 9),
            "y" * 199 + "-x-" + prose(53, 9), prose(9, 300) * 40 + " " + prose(50, 30)]


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("block_bytes", [1 << 23, 300])
def test_matches_brute_force(spark, monkeypatch, block_bytes, clash):
    monkeypatch.setattr(decontamination, "PIECE", 4)
    monkeypatch.setattr(decontamination, "STRETCH", 50)
    monkeypatch.setattr(decontamination, "LONG", 20)
    texts = cases()
    got = decontamination.digests(docs(spark, texts, clash), benchmark(spark, ITEMS), block_bytes=block_bytes).collect()
    want = brute(texts, ITEMS)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == dict(enumerate(want)) and len(got) == len(texts)


def test_blocks_are_bounded_and_whole(spark):
    items = [(i, prose(i, 40)) for i in range(60)]
    found = list(decontamination.blocks(benchmark(spark, items), block_bytes=2000))
    assert len(found) > 3
    assert sorted(i for b in found for i in b.items) == sorted(str(i) for i in range(60))


def test_a_collision_is_no_hit(monkeypatch):
    monkeypatch.setattr(decontamination.Windows, "_hash", staticmethod(lambda rows: rows[:, 0].astype("uint64") * 0))
    known = decontamination.Windows([("a", b"p q r"), ("b", b"q r p"), ("c", b"r r r")], 3)
    n, runs, items = known.find(b"x p q r p, r r x")
    assert (n, runs.tolist(), items) == (8, [[1, 5]], ["a", "b"])


def test_spans_and_documents(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [f"Before, {item.title()}. After", "clean text", None, item, f"ü {item[:-7]}... zß {item}"]
    df, bench = docs(spark, texts, True), benchmark(spark, [(1, item)])
    cut = decontamination.without_spans(df, bench)
    assert cut.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {
        0: "Before, . After", 1: "clean text", 2: None, 3: "", 4: "ü ... zß "}
    kept = decontamination.without_documents(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert sorted(r["doc_id"] for r in decontamination.without_documents(df, bench, 0.9).collect()) == [0, 1, 2]


def test_empty_sides(spark):
    df, none = docs(spark, ["a b c", None]), benchmark(spark, ITEMS).limit(0)
    assert [tuple(r)[1:4] for r in decontamination.digests(df, none).orderBy("doc_id").collect()] == [(3, 0, 0), (0, 0, 0)]
    assert decontamination.digests(df.limit(0), benchmark(spark, ITEMS)).count() == 0


def test_repeated_rows(spark):
    df = docs(spark, ["short item"]).union(docs(spark, ["short item"]))
    assert [r["n_hit"] for r in decontamination.digests(df, benchmark(spark, ITEMS), block_bytes=300).collect()] == [2, 2]
