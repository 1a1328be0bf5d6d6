"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, extra columns."""

import itertools
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns named like those that operators make.
CLASH = SCHEMA + ", row long, fp string, size string, ids string, score string, kept string, _row int"


def docs(spark, texts, clash=False, source=None):
    rows = []
    for i, text in enumerate(texts):
        base = (i, text, "en" if i % 3 else None, source(i) if source else f"s{i % 2}", None)
        rows.append((*base, i, "x", "x", "x", "x", "x", 1) if clash else base)
    return spark.createDataFrame(rows, CLASH if clash else SCHEMA)


def stored(df, tmp_path, name="docs"):
    """Operators that number rows read stored tables."""
    path = str(tmp_path / name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


WORDS = ["ab", "cde", "Fgh", "ij", "éü", "klm,", "no", "pqr", "stuv", "w"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def edited(text, seed, n=1):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


AWKWARD = [None, "", "   \n\t", "one", "one two", prose(1, 40), prose(1, 40), prose(2, 9000), "ß" * 50, "<|endoftext|>", None]


def connected(n, pairs):
    """Smallest member per item of the classes that ``pairs`` connect."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def all_pairs(n):
    return itertools.combinations(range(n), 2)
