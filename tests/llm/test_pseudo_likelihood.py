import numpy as np

from larder.llm import pseudo_likelihood as lm
from larder.llm.common import table
from conftest import DATA
from helpers import AWKWARD, docs, edited, prose, stored


def brute(net, ids):
    """Sum over tokens of log p(token | both sides), one token at a time, normalised over all words."""
    f = {k: v.astype(np.float64) for k, v in net.items()}
    seq, total = [0, 0, *map(int, ids), 0, 0], 0.0
    for i in range(2, len(seq) - 2):
        x = np.concatenate([f["embed"][seq[j]] for j in (i - 2, i - 1, i + 1, i + 2)])
        h = np.tanh(x @ f["inner"] + f["inner_b"])
        p = h @ f["group"] + f["group_b"]
        p = np.exp(p) / np.exp(p).sum()
        every = []
        for g in range(lm.CLASSES):
            q = h @ f["member"][g] + f["member_b"][g]
            every.append(p[g] * np.exp(q) / np.exp(q).sum())
        every = np.concatenate(every)
        assert abs(every.sum() - 1) < 1e-9
        total += np.log(every[seq[i]])
    return total


def test_scores_are_those_of_the_definition(spark, tmp_path, monkeypatch):
    texts = [t for t in AWKWARD if len(t or "") < 2000] + [prose(i, 40) for i in range(30)]
    df = stored(docs(spark, texts, clash=True), tmp_path)
    ids = lm.vocabulary(df)
    coded = stored(lm.tokens(df, ids), tmp_path, "coded")
    net = lm.train(coded)
    for r in coded.collect():
        t = np.frombuffer(r["ids"], "<u2")
        assert t.tolist() == [ids.get(w, 1) for w in lm.words((texts[r["doc_id"]] or "").encode())]
        want = brute(net, t)
        monkeypatch.setattr(lm, "BLOCK", 7)
        got = lm.log_likelihood(net, [t])[0]
        monkeypatch.undo()
        assert abs(got - want) < 1e-3 * (1 + len(t))
    scored = {r["doc_id"]: r for r in lm.scores(df).collect()}
    assert len(scored) == len(texts)
    for i, text in enumerate(texts):
        n = len(lm.words((text or "").encode()))
        assert scored[i]["n_tokens"] == n
        assert (scored[i]["log_likelihood"] == 0 and scored[i]["mean_log_likelihood"] is None) if not n else scored[i]["log_likelihood"] < 0


def test_gradient():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in lm.initial().items()}
    flat, places = lm.padded([rng.integers(1, lm.SIZE, 30), rng.integers(1, lm.SIZE, 0), rng.integers(1, lm.SIZE, 5)])
    assert len(places) == 35 and (flat[places] > 0).all()
    grad = {}
    for k, (rows, values) in lm.gradient(net, flat, places).items():
        grad[k] = np.zeros(net[k].shape)
        grad[k][rows] = values
    for k in lm.SHAPES:
        at = np.unravel_index(np.argmax(np.abs(grad[k])), grad[k].shape)
        ends = []
        for step in (1e-5, -1e-5):
            moved = {n: v.copy() for n, v in net.items()}
            moved[k][at] += step
            ends.append(-lm.forward(moved, flat, places)[0].mean())
        assert abs(grad[k][at] - (ends[0] - ends[1]) / 2e-5) < 2e-2 * abs(grad[k][at])


def test_held_out_likelihood_beats_unigrams_and_shuffled_texts(spark, tmp_path):
    rows = table(spark, DATA, "documents").where("lang = 'en'").select("text").collect()
    tokens = [lm.words(r["text"].encode()) for r in rows]
    df = table(spark, DATA, "documents").where("doc_id % 5 <> 0")
    ids = lm.vocabulary(df)
    net = lm.train(stored(lm.tokens(df, ids), tmp_path), rounds=6, masked=0.5)
    out = [np.array([ids.get(w, 1) for w in lm.words(r["text"].encode())]) for r in
           table(spark, DATA, "documents").where("doc_id % 5 = 0").collect()]
    counts = np.ones(lm.SIZE)
    for r in df.collect():
        np.add.at(counts, [ids.get(w, 1) for w in lm.words(r["text"].encode())], 1)
    unigram = sum(np.log(counts / counts.sum())[t].sum() for t in out)
    assert lm.log_likelihood(net, out).sum() > unigram
    assert len(tokens) > 0


def test_vocabulary_counts_the_whole_corpus(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 3)
    texts = ["b b a", None, "", "a c B!", edited("d e f", 1)]
    ids = lm.vocabulary(stored(docs(spark, texts), tmp_path), size=5)
    assert ids == {b"b": 2, b"a": 3, b"c": 4}


def test_empty(spark, tmp_path):
    df = stored(docs(spark, ["a"]).limit(0), tmp_path)
    assert lm.scores(df).count() == 0
    assert [r["n_tokens"] for r in lm.scores(stored(docs(spark, [None, " "]), tmp_path, "blank")).collect()] == [0, 0]


def test_other_words_have_their_own_probability(spark, tmp_path):
    texts = ["the cat sat"] * 40 + ["the zebra sat", "the zqxjk sat", "the zebra's sat"]
    df = stored(docs(spark, texts), tmp_path)
    got = {r["doc_id"]: r["log_likelihood"] for r in lm.scores(df, size=5).collect()}
    assert got[40] > got[41] and len({got[40], got[41], got[42]}) == 3
    coded = stored(lm.tokens(df, lm.vocabulary(df, 5)), tmp_path, "coded")
    table = lm.spelling(coded).astype(np.float64)
    assert np.allclose(np.exp(table).reshape(-1, lm.SYMBOLS).sum(1), 1, atol=1e-5)
    p = np.exp(table).reshape([lm.SYMBOLS] * 3)
    a, b = lm._SYMBOL[ord("a")], lm._SYMBOL[ord("b")]
    want = np.log(p[0, 0, a] * p[0, a, b] * p[a, b, 0] * p[0, 0, b] * p[0, b, 0])
    assert abs(lm.spelled(table, b"ab b ") - want) < 1e-6 and lm.spelled(table, b"") == 0


def test_every_position_is_a_target_once():
    for n in (0, 1, 5000):
        text = np.arange(n, dtype="<u2")
        assert (sum(lm.masks(text, r, lm.MASKED).astype(int) for r in range(lm.ROUNDS)) == np.ones(n)).all()


def test_the_registered_training_beats_unigrams_and_shuffled_texts(spark, tmp_path):
    """Held-out texts, with ROUNDS and MASKED as the query has them."""
    rows = table(spark, DATA.replace("sf0.001", "sf0.01"), "documents")
    df = rows.where("doc_id % 5 <> 0")
    ids = lm.vocabulary(df)
    coded = stored(lm.tokens(df, ids), tmp_path)
    net = lm.train(coded)
    out = [np.frombuffer(r["ids"], "<u2") for r in lm.tokens(rows.where("doc_id % 5 = 0"), ids).collect()]
    counts = np.ones(lm.SIZE)
    for r in coded.collect():
        np.add.at(counts, np.frombuffer(r["ids"], "<u2"), 1)
    unigram = sum(np.log(counts / counts.sum())[t].sum() for t in out)
    rng = np.random.default_rng(3)
    shuffled = lm.log_likelihood(net, [rng.permutation(t) for t in out]).sum()
    ours, n = lm.log_likelihood(net, out).sum(), sum(map(len, out))
    print("held out, a token:", ours / n, "unigrams", unigram / n, "shuffled", shuffled / n)
    assert ours > unigram and ours > shuffled
