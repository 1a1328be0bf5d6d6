import numpy as np
import pytest

from larder.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string"


def table(spark, vectors, parts=5):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute(vectors):
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in enumerate(vectors)
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + 1000000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    centred = (x - s / n).astype(float)
    return [i for i, _ in kept], n, deviation, centred, centred.T @ centred / n


def check(got, vectors, components):
    ids, n, deviation, centred, v = brute(vectors)
    values, found = np.linalg.eigh(v)
    values, found = values[::-1][:components], found[:, ::-1][:, :components]
    rows = {(r["vec_id"], r["component"]): r for r in got}
    assert len(rows) == len(got) == len(ids) * components
    for c in range(components):
        mine = np.array([rows[i, c + 1]["whitened"] for i in ids])
        want = centred @ found[:, c] / np.sqrt(values[c])
        want *= np.sign(mine @ want)
        assert np.abs(mine - want).max() < 1e-8
        assert abs(rows[ids[0], c + 1]["explained"] - values[c] / np.trace(v)) < 1e-12
    for i, d in zip(ids, deviation):
        assert rows[i, 1]["n"] == n and rows[i, 1]["deviation"] == d
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def normal(n, size, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, size)) * rng.uniform(0.2, 3, size) + rng.uniform(-2, 2, size)).tolist()


def test_matches_dense_solver(spark):
    vectors = normal(400, 12)
    vectors[3], vectors[7], vectors[9] = None, [None] + vectors[7][1:], [float("nan")] + vectors[9][1:]
    vectors[11], vectors[12] = [float("-inf")] + vectors[11][1:], []
    vectors += vectors[20:22] * 100
    good = [v if v else None for v in vectors]
    check(whitening.whitened(table(spark, vectors)).collect(), good, 12)
    check(whitening.whitened(table(spark, vectors), components=3).collect(), good, 3)


def test_other_lengths_go(spark):
    vectors = normal(60, 5) + normal(20, 4) + normal(10, 7)
    got = whitening.whitened(table(spark, vectors)).collect()
    check(got, [v if len(v) == 5 else None for v in vectors], 5)


def test_few_vectors_have_few_components(spark):
    got = whitening.whitened(table(spark, normal(4, 9))).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and got[0]["identity_error"] < 1e-6
    assert abs(sum(r["explained"] for r in got if r["vec_id"] == 0) - 1) < 1e-9


def test_nothing_left(spark):
    for vectors in ([], [None, [None]], [[]], [[1.0, 2.0]] * 5):
        got = whitening.whitened(table(spark, vectors))
        assert got.columns[0] == "vec_id" and got.collect() == []


def test_large_entries_stay_exact(spark):
    vectors = [[3e7, 1.0], [-2e7, 5.0], [1.0, 9.0], [2.0, 1e9]]
    got = whitening.whitened(table(spark, vectors)).collect()
    _, _, deviation, _, _ = brute(vectors)
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: d if d < 2**63 else None for i, d in enumerate(deviation)}
    # Sums beyond a long and entries beyond its range do not fail.
    assert whitening.whitened(table(spark, [[1e17, 0.0], [9e16, 1.0], [3e38, 2.0]])).count() > 0


@pytest.mark.parametrize("kind", ["random", "equal", "close", "diagonal", "zeros", "low rank", "graded"])
@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_eigenpairs(kind, size):
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.standard_normal((size, size)))
    values = {"random": rng.uniform(1, 5, size), "equal": np.where(np.arange(size) < size // 2, 3.0, 1.0),
              "close": 1 + 1e-9 * np.arange(size), "diagonal": np.arange(size) % 3 + 1.0, "zeros": np.zeros(size),
              "low rank": np.where(np.arange(size) < 2, 4.0, 0.0), "graded": 10.0 ** -np.arange(size).clip(0, 12)}[kind]
    v = np.diag(values) if kind == "diagonal" else q * values @ q.T
    v = (v + v.T) / 2
    k = min(32, size)
    found, vectors = whitening.eigenpairs(v, k)
    norm = max(1e-300, np.abs(values).max())
    assert np.abs(found - np.linalg.eigvalsh(v)[::-1][:k]).max() <= 1e-13 * norm * max(4, size)
    assert np.abs(v @ vectors - vectors * found).max() <= 1e-12 * norm * max(1, size / 8)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-10


def test_sturm_counts():
    d, e = np.array([2.0, 0.0, 1.0, 5.0]), np.array([1.0, 0.0, 3.0])
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.array([-10.0, 0.1, 1.0, 2.3, 10.0])
    assert whitening.above(d, e, at).tolist() == [int((values > t).sum()) for t in at]
