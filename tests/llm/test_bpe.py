import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from larder.llm import bpe
from helpers import AWKWARD, docs, prose, stored

PATH = bpe.default_vocabulary()
THEIRS = Tokenizer.from_file(PATH)
VOCAB = bpe.vocabulary(PATH)


def ids(text):
    return THEIRS.encode(text or "", add_special_tokens=False).ids


NASTY = ["a" * 700, "1" * 333, "!" * 200 + "'s" * 40, " " * 90 + "x", "\n\n \n" * 40 + "y  ", "日本語" * 80, "🙂👩‍👩‍👧" * 40,
         "it's we'll '''re 'd" * 20, "<|endoftext|>" * 9, "x<|endoftext|>  <|endo" * 12, "ab   \u0085c" * 30, "é" * 99]


@pytest.mark.parametrize("leaf", [5, 16, 61])
def test_trees_equal_the_whole(leaf):
    rng = random.Random(leaf)
    mixed = ["".join(rng.choice(NASTY)[:rng.randrange(1, 30)] for _ in range(30)) for _ in range(60)]
    noise = ["".join(rng.choice(" \n'!as1é日🙂dt<|>") for _ in range(150)) for _ in range(100)]
    for text in NASTY + mixed + noise:
        parts = VOCAB.leaves(text.encode(), leaf)
        assert b"".join(parts) == text.encode()
        for window in (1, 8):
            got = bpe.tree(VOCAB, [VOCAB.encode(p) for p in parts], window)
            assert got.tolist() == ids(text), (text, leaf, window)
        assert VOCAB.decode(got).decode() == THEIRS.decode(ids(text), skip_special_tokens=False) == text


@pytest.mark.parametrize("leaf", [64, bpe.LEAF])
def test_digests(spark, tmp_path, leaf):
    texts = AWKWARD + NASTY + [prose(i, 100) for i in range(10)]
    got = bpe.digests(stored(docs(spark, texts, clash=True), tmp_path), leaf=leaf).collect()
    want = []
    for i, text in enumerate(texts):
        t = ids(text)
        back = THEIRS.decode(t, skip_special_tokens=False)
        want.append((i, len(t), hashlib.sha256(np.array(t, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, got)) == want


def test_repeats_nulls_and_empty(spark, tmp_path):
    df = stored(docs(spark, ["x y" * 50] * 2).selectExpr("cast(null as long) doc_id", "text"), tmp_path)
    assert bpe.digests(df, leaf=32).count() == 2
    assert bpe.digests(df.limit(0)).count() == 0


def test_incomplete_characters_are_replaced(spark):
    t = [i for i, b in enumerate(VOCAB.bytes) if b == "é".encode()[:1]][:1]
    df = spark.createDataFrame([(bytearray(np.array(t, "<u4").tobytes()),), (None,)], "ids binary")
    assert {r["decoded"] for r in bpe.decode(df).collect()} == {THEIRS.decode(t, skip_special_tokens=False), None}
