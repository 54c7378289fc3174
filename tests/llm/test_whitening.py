from math import floor, inf, isfinite, nan

import numpy as np
import pytest

from loglark.llm import queries, spectrum, whitening


def symmetric(values, rng):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


RNG = np.random.default_rng(4)
MATRICES = {
    "spread": symmetric(np.linspace(0.1, 900, 40), RNG),
    "falling": symmetric(10.0 ** -np.arange(12), RNG),
    "repeated": symmetric([5, 5, 5, 4, 4 - 1e-13, 4 - 1e-9, 3, *[1e-3] * 20], RNG),
    "identity": np.eye(9),
    "one row": np.array([[3.0]]),
    "rank one": np.ones((6, 6)),
    "zero diagonal": np.array([[0.0, 2.0], [2.0, 0.0]]),
    "negative": symmetric([4, 1, -2, -7], RNG),
}


@pytest.mark.parametrize("name", MATRICES)
def test_eigenpairs(name):
    a = MATRICES[name]
    scale = np.abs(a).max()
    values, vectors = spectrum.leading(a, 16)
    want = np.linalg.eigvalsh(a)[::-1]
    want = want[want > 1e-11 * scale][: min(16, len(a))]
    assert len(values) == len(want) and np.abs(values - want).max() < 1e-12 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-11 * scale


def test_counts_are_those_of_the_eigenvalues():
    rng = np.random.default_rng(9)
    for n in (1, 2, 5, 30):
        a = rng.standard_normal((n, n))
        a += a.T
        for shift in (*rng.uniform(-8, 8, 6), 0.0):
            assert spectrum.positive_count(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    assert spectrum.positive_count(np.zeros((3, 3)), 0.0) == 0 == len(spectrum.leading(np.zeros((3, 3)), 2)[0])


def plain(rows):
    """{component: (explained, {row number: whitened})} and the exact columns, by a library's eigenvectors."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and isfinite(c) for c in v)]
    xs = [[floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    fit = sorted(set(map(tuple, xs)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    off = np.array([[n * c - s for c, s in zip(x, sums)] for x in xs], dtype=object)
    fit_off = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], dtype=object).astype(float) / n
    e, u = np.linalg.eigh(fit_off.T @ fit_off / n)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    keep = e > 1e-11 * e.sum()
    e, u = e[keep], u[:, keep]
    trace = float((fit_off**2).sum() / n)
    return kept, n, [int((o * o).sum()) for o in off], (off.astype(float) / n) @ u / np.sqrt(e), e / trace


def check(got, rows):
    kept, n, deviations, whitened, explained = plain(rows)
    assert len(got) == len(kept) * len(explained)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    want = {}
    for (i, _), d, w in zip(kept, deviations, whitened):
        want.setdefault(i, []).append((d, w))
    assert by_id.keys() == want.keys()
    signs = None
    for i, found in by_id.items():
        found = sorted(found, key=lambda r: r.component)
        k = len(want[i])
        assert {(r.n, r.deviation) for r in found} == {(n, d) for d, _ in want[i]}
        assert max(r.identity_error for r in found) < 1e-9
        if k == 1:
            w = np.array([r.whitened for r in found])
            own = np.sign(w * want[i][0][1])
            signs = own if signs is None else np.where(signs == 0, own, signs)
            assert np.abs(w * signs - want[i][0][1])[signs != 0].max() < 1e-6
            assert np.abs(np.array([r.explained for r in found]) / explained - 1).max() < 1e-8


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = queries.op12_whitening(spark, sf)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
                                "whitened": "double", "explained": "double", "identity_error": "double"}
    check(out.collect(), rows)


@pytest.fixture
def run(spark, tmp_path):
    def made(rows):
        table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, x string, id int")
        table.write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        return queries.op12_whitening(spark, str(tmp_path)).collect()

    return made


def test_rows_that_cannot_be_used_and_repeats(run):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(40)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [nan, 1.0, 1.0, 1.0, 1.0]), (103, [inf, 0.0, 0.0, 0.0, 0.0]),
             (104, [-0.0] * 5), (105, [0.0] * 5), (106, [0.0] * 5), (7, rows[7][1]), (None, rows[3][1])]
    check(run(rows), rows)
    assert len(run([*rows, (200, []), (201, [1.0, 2.0])])) == len(run(rows))  # other lengths are left out


def test_dimensions_that_do_not_vary(run):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), 5.0, float(a) * 2, 0.25, float(b)]) for i, (a, b) in enumerate(rng.integers(-9, 9, (60, 2)))]
    got = run(rows)
    assert {r.component for r in got} == {1, 2}
    check(got, rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(run, rows):
    assert run(rows) == []


def test_deviations_beyond_a_long_stay_exact(spark):
    sums = np.array([1, 2])
    rows = spark.createDataFrame([([10**9, -(10**9)],)], "x array<long>")
    (got,) = rows.select(whitening.deviation(rows.x, 5, sums)).first()
    assert int(got) == (5 * 10**9 - 1) ** 2 + (-5 * 10**9 - 2) ** 2
