"""Hard negatives and whitening against plain versions."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import l2ap, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, tag string, n bigint, score int, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, x, "t", 1, 2, "v") for i, v, x in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 24)) / 5
    out = []
    for i in range(700):
        c = int(rng.integers(6))
        out.append((i, (centres[c] + rng.normal(size=24) / 8).tolist(), int(rng.integers(4)) if i % 3 else c % 4))
    hot = out[100][1]
    out += [(1000 + i, hot, i % 4) for i in range(400)]  # many ties
    out += [(2000, [0.0] * 24, 1), (2100, [0.0] * 24, 2), (2101, out[3][1][:23] + [None], 1), (2102, None, 1), (2103, hot, None)]
    out += [(2200, [float("nan")] * 24, 1), (2201, [float("inf")] * 24, 0), (2202, [], 1), (2300, [1.0, 2.0], 1), (2301, [1.0, 2.5], 1)]
    out += [(2302, [0.9, 1.1], 2), (None, hot, 1), out[5], out[100]]
    return out


def fine(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def plain_mine(rows, every=100):
    use = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int), x) for i, v, x in rows if i is not None and x is not None and fine(v)]
    out = []
    for at, (i, x, label) in enumerate(use):
        if i % every:
            continue
        others = [(-int(x @ y), j, m) for k, (j, y, m) in enumerate(use) if k != at and len(y) == len(x)] if len(x) else []
        mine = sorted((s, j) for s, j, m in others if m == label)[:5]
        for s, j in mine:
            other = sorted((t, k) for t, k, m in others if m != label and 30 * -s <= 100 * -t <= 90 * -s)[:10]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(other)]
    return sorted(out)


@pytest.mark.parametrize("sample,chunk", [(4096, 1 << 26), (60, 1200), (1, 1 << 26)])
def test_negatives_equal_all_pairs(spark, rows, sample, chunk):
    df = frame(spark, rows).repartition(5)
    got = l2ap.mine(df, F.col("vec_id") % 100 == 0, sample_rows=sample, chunk_bytes=chunk)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_mine(rows)
    assert len(want) > 200
    assert sorted(tuple(r) for r in got.collect()) == want


def test_no_anchor_and_no_row(spark, rows):
    df = frame(spark, rows)
    assert l2ap.mine(df, F.lit(False)).collect() == []
    assert l2ap.mine(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("least", [-1e18, 0.0, 2000.0, 9000.0])
def test_threshold_pairs_are_complete(least):
    rng = np.random.default_rng(7)
    a, b = (np.floor(rng.normal(size=(n, 37)) * np.linspace(60, 2, 37)) for n in (30, 500))
    q, r, s = l2ap.threshold_pairs(l2ap.Queries(a), b, np.full(30, least))
    full = a @ b.T
    assert sorted(zip(q.tolist(), r.tolist(), s.tolist())) == sorted((i, j, int(full[i, j])) for i, j in zip(*np.nonzero(full >= least)))


@pytest.mark.parametrize("values", [
    list(range(1, 40)), [3.0] * 9, [5, 5, 5, 5 + 1e-9, 1, 1, 1e-3, 1e-3], [1, 1 - 1e-12, 1e-10, 1e-10, 0, 0], [1e300, 1e299, 1e299], [7.0], [0.0, 0.0],
])
def test_refined_eigenvectors(values):
    rng = np.random.default_rng(2)
    d = len(values)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    a = q @ np.diag(np.array(values, dtype=float)) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigen(a)
    size = max(np.abs(a).max(), 1e-300)
    assert np.abs(x.T @ x - np.eye(d)).max() < 4e-15
    assert np.abs((a / size) @ x - x * (found / size)).max() < 4e-15 * d
    assert (np.diff(found) <= 0).all()
    assert np.abs(np.sort(np.array(values, dtype=float))[::-1] - found).max() / size < 1e-14 * d


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_whitening_equals_exact_covariance(spark, rows, scale):
    given = [(i, None if v is None else [None if c is None else c * scale for c in v], x) for i, v, x in rows]
    got = whitening.whiten(frame(spark, given), components=32).toPandas()
    use = [(i, np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int) + 1_000_000) for i, v, _ in given if fine(v) and len(v) == 24]
    n, x = len(use), np.stack([v for _, v in use]).astype(object)
    total = x.sum(axis=0)
    assert len(got) == n * 24 and set(got.n) == {n} and set(got.component) == set(range(1, 25))
    deviation = {i: int(((n * v.astype(object) - total) ** 2).sum()) for i, v in use if i is not None}
    for i, w in got[got.component == 1].dropna(subset="vec_id").set_index("vec_id").deviation.items():
        assert (deviation[int(i)] == int(w)) if deviation[int(i)] < 1 << 63 else w is None or w != w
    centred = x * n - total
    gram = centred.T @ centred
    v = np.array([[float(Fraction(int(g), n ** 3)) for g in row] for row in gram])
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    plain = (centred / n).astype(float) @ axes / np.sqrt(e)
    mine = got.dropna(subset="vec_id").drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    at = {i: k for k, (i, _) in enumerate(use)}
    want = plain[[at[i] for i in mine.index]]
    assert np.abs(np.abs(mine.to_numpy()) - np.abs(want)).max() < 1e-8
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-12
    assert np.allclose(got.explained[got.component == 3], e[2] / e.sum(), rtol=1e-12)


def test_directions_without_variance(spark):
    same = frame(spark, [(i, [0.5, 0.25], 1) for i in range(5)])
    got = whitening.whiten(same).collect()
    assert len(got) == 10 and {r.whitened for r in got} == {None} and {r.deviation for r in got} == {0}
    flat = frame(spark, [(i, [float(i), 0.25, 2.0 * i], 1) for i in range(50)])
    got = whitening.whiten(flat).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got) and got[0].identity_error < 1e-12
    assert whitening.whiten(same.limit(0)).collect() == []
    assert whitening.whiten(frame(spark, [(1, None, 1), (2, [None], 1), (3, [], 1)])).collect() == []
