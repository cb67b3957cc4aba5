"""Similarity joins against all pairs."""

import random

import numpy as np
import pytest

from reviewlake.llm import chosen_path, epsilon_grid
from reviewlake.llm.components import components


def union(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i: i + k]) for i in range(max(1, len(words) - k + 1)))


def expected(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    pairs = [
        (a, b) for x, a in enumerate(ids) for b in ids[x + 1:]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    comp = union(ids, pairs)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    out = family(rng, [word() for _ in range(120)], 90, 6)  # many near the threshold
    for _ in range(15):
        out += family(rng, [word() for _ in range(rng.randrange(5, 60))], rng.randrange(1, 5), 2)
    common = " ".join(word() for _ in range(40))
    out += [common + " " + " ".join(word() for _ in range(60)) for _ in range(30)]
    out += ["Same Text here", "same text HERE", "same  text\there ", "two words", "", " \t\n", None, "x" * 200_000, "a b " * 30_000]
    out += [out[0]] * 8
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("limit,levels", [(1024, 6), (16, 2), (16, 3)])
def test_shingle_join_equals_all_pairs(docs_of, texts, limit, levels):
    docs = docs_of([(i, t, "en", "s") for i, t in texts])
    got = {r[0]: tuple(r)[1:] for r in chosen_path.join(docs, k=4, limit=limit, levels=levels).collect()}
    assert got == expected(texts, 4)


def test_kept_documents_keep_their_columns(docs_of, texts):
    docs = docs_of([(i, t, "en", "s") for i, t in texts])
    kept = chosen_path.deduplicate(docs, k=5)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in expected(texts, 5).items() if v[2]}


def test_shingle_join_of_nothing_and_of_repeated_rows(docs_of):
    assert chosen_path.join(docs_of([])).count() == 0
    rows = [(1, "a b c d e f", None, None)] * 3 + [(None, "a b c d e f", None, None), (None, None, None, None)]
    got = chosen_path.join(docs_of(rows)).collect()
    assert sorted((r.doc_id is None, r.n_shingles, r.component_id) for r in got if r.n_shingles) == [
        (False, 2, 1)] * 3 + [(True, 2, 1)]
    assert [tuple(r)[1:] for r in got if not r.n_shingles] == [(0, None, True)]


def test_one_row_of_each_group_stays_whatever_its_id(docs_of):
    same, other = "a b c d e f g h", "q r s t u v w x"
    rows = [(1, same), (1, same), (None, same), (5, other), (7, other), (7, "one two three four five six"), (None, "i j k l m n"),
            (None, "i j k l m n"), (9, None), (9, None), (2, "z y x w v u"), (3, "Z y x w v u"), (2, "z y x w v u")]
    docs = docs_of([(i, t, "en", "s") for i, t in rows])
    kept = chosen_path.deduplicate(docs, k=5)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(1, same), (5, other), (7, rows[5][1]), (None, "i j k l m n"), (9, None), (9, None), (2, rows[10][1])], key=repr)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, n int, block string")


def test_vector_join_equals_all_pairs(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(25):
            rows.append(centre + rng.normal(size=16) * rng.choice([0.02, 0.08, 0.3]))
    rows += [rows[0]] * 20 + [rows[1] * 7.5] * 3 + [rng.normal(size=16) for _ in range(60)]
    data = [(i, [float(np.float32(x)) for x in v], int(i % 3), 1, "z") for i, v in enumerate(rows)]
    odd = [
        (900, None, 1, 1, "z"), (901, [0.0] * 16, 1, 1, "z"), (902, data[0][1], None, 1, "z"), (903, [], 1, 1, "z"),
        (904, [float("nan")] + [1.0] * 15, 1, 1, "z"), (905, [float("inf")] + [1.0] * 15, 1, 1, "z"),
        (906, [None] + [1.0] * 15, 1, 1, "z"), (907, [1.0, 2.0], 1, 1, "z"), (908, [2.0, 4.0], 1, 1, "z"),
    ]
    ids = [d[0] for d in data]
    m = np.array([d[1] for d in data])
    u = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    labels = np.array([d[2] for d in data])
    near = (u @ u.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    comp = union(ids, [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    want = {i: (int(near[i].sum()), comp[i], comp[i] == i) for i in ids}
    want |= {i: (0, i, True) for i in range(900, 907)} | {907: (1, 907, True), 908: (1, 907, False)}
    assert sum(v[0] > 0 for v in want.values()) > 100
    for block in (8, 64):
        got = epsilon_grid.join(vectors_of(spark, data + odd), block_rows=block, sample_rows=64).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == want


def test_vector_join_of_nothing(spark):
    assert epsilon_grid.join(vectors_of(spark, [])).count() == 0
    got = epsilon_grid.join(vectors_of(spark, [(1, None, None, 1, "")] * 2)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, True)] * 2


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
