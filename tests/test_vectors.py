"""Text vectors and retrieval against plain formulas."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewlake import fixed_values as fv
from reviewlake.functions import vectors as vx
from reviewlake.operators import retrieval as rt

TEXTS = [
    "Concurrent withdrawal: race condition on the wallet balance!", "a an it", "", None,
    "duplicate webhook retry (idempotency) header; cache", "Ünïcode wörds and \u00a0spaces float precision 754",
    "word word word other",
]


def test_embedding_equals_its_sql(spark):
    """The SQL of the catalog is the plain form of the features."""
    import duckdb

    from reviewlake.catalog.vectors import embed_sql

    con = duckdb.connect()
    con.execute("CREATE TABLE d (id INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", [(i, t or "") for i, t in enumerate(TEXTS)])
    want = {}
    for i, dim, v in con.execute(f"WITH {embed_sql('d', 'id', 'text', 'e')} SELECT id, dim, v FROM e").fetchall():
        want.setdefault(int(i), np.zeros(fv.EMBEDDING_DIM))[dim] = v
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {r["id"]: r["embedding"] for r in rt.embed(df, id_col="id", text_col="text").collect()}
    assert set(got) == set(range(len(TEXTS))) and len(want) >= 4
    for i in got:
        assert np.allclose(got[i], want.get(i, np.zeros(fv.EMBEDDING_DIM)), atol=2e-6)


def test_task_keeps_at_most_k_rows_a_query():
    sims = np.array([[0.9, 0.8, 0.8, 0.7], [0.1, 0.2, 0.95, 0.3]])
    first = rt._best(sims, ["a", "b"], ["w", "z", "x", "y"], 2, 0.25)
    assert [tuple(r) for r in first.itertuples(index=False)] == [("a", "w", 0.9), ("a", "x", 0.8), ("b", "x", 0.95), ("b", "y", 0.3)]
    both = rt._keep_best(pd.concat([first, rt._best(sims + 0.01, ["a", "b"], ["p", "q", "r", "s"], 2, 0.25)]), 2)
    assert both.groupby("query_id").size().max() == 2


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-2.0, 0.0], -1.0),
            ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), ([], [], 0.0), (None, [1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    assert [r[0] for r in df.select(vx.cosine(F.col("a"), F.col("b"))).collect()] == [r[2] for r in rows]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    points = rng.standard_normal((400, 8))
    points[100:230] = points[100]  # a third of all rows are copies
    rows = [(f"{i:04d}", [float(x) for x in p]) for i, p in enumerate(points)]
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    sims = np.round(unit @ unit.T, 9)
    want = set()
    for i in range(len(rows)):
        order = sorted((j for j in range(len(rows)) if sims[i, j] >= 0.6), key=lambda j: (-sims[i, j], j))[:3]
        want |= {(rows[i][0], rows[j][0], r) for r, j in enumerate(order, 1)}
    return rows, want


def _sides(spark, rows):
    df = spark.createDataFrame(rows, "id string, vec array<double>").repartition(5)
    return df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "item_id")


@pytest.mark.parametrize("bound", ["corpus", "queries", "blocks"])
def test_topk_paths_agree(spark, cloud, monkeypatch, bound):
    rows, want = cloud
    q, c = _sides(spark, rows)
    if bound == "queries":
        calls = iter([None])
        fetch = rt._fetch_small
        monkeypatch.setattr(rt, "_fetch_small", lambda df, dim: next(calls, fetch(df, dim)))
    if bound == "blocks":
        monkeypatch.setattr(rt, "MAX_BROADCAST_NUMBERS", 800)
    got = rt.topk(q, c, dim=8, k=3, min_sim=0.6).collect()
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in got} == want


def test_seeded_incidents_are_found(spark):
    inc = rt.seed_incidents(spark)
    corpus = inc.join(rt.embed(inc, id_col="id", text_col="full_text"), "id").select(
        F.col("id").alias("item_id"), F.col("embedding").alias("vec"), "bug_category"
    )
    from reviewlake.catalog.vectors import OPENINGS

    q = spark.createDataFrame(list(enumerate(OPENINGS)), "query_id int, text string")
    got = rt.topk_text(q, corpus.drop("bug_category"), min_sim=0.75).where("rank = 1")
    assert {r["query_id"]: r["item_id"] for r in got.collect()} == {str(i): f"INC-{i + 1}" for i in range(4)}


def test_split_white_space_like_text(spark):
    text = "a\u2003b\u00a0c\x1cd \t e"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(F.split("t", vx.WHITE, -1)).first()[0]
    assert got == text.split() and not re.search(r"\s", "".join(got))


def test_products_stay_small(spark, cloud, monkeypatch):
    """Tiles of any size give the rows of the whole product, in memory that does not grow with it."""
    import tracemalloc

    rows, want = cloud
    items, vectors = rt._by_id([r[0] for r in rows], rt._unit([r[1] for r in rows], 8), 3)
    assert len(items) == 400 - 130 + 3  # of equal rows no more than a query can match
    asked = rt._unit([r[1] for r in rows], 8)
    for tiles in ((512, 8192), (7, 5), (64, 40)):
        monkeypatch.setattr(rt, "TILE_QUERIES", tiles[0])
        monkeypatch.setattr(rt, "TILE_ITEMS", tiles[1])
        got = rt._matches(asked, [r[0] for r in rows], vectors, items, 3, 0.6)
        rank = got.groupby("query_id").cumcount() + 1
        assert set(zip(got["query_id"], got["item_id"], rank)) == want
    monkeypatch.undo()
    many = rt._unit(list(np.random.default_rng(1).standard_normal((6000, 16))), 16)
    tracemalloc.start()
    got = rt._matches(many, np.arange(6000), many, np.arange(6000), 3, 0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 18_000 and peak < 150e6  # the whole product takes 288 MB, and as much for each copy
    assert not rt._unit([[np.nan] + [1.0] * 15, [np.inf] + [1.0] * 15], 16).any()


def test_features_leave_in_small_batches():
    """What a worker holds follows the rows of a slice and not those of a batch; a bound on words changes nothing."""
    import pyarrow as pa

    words = [[f"w{i % 700}", "same", f"x{i}"] for i in range(2000)]
    batch = pa.array(words, pa.list_(pa.string())), pa.array([[float(i % 3), 0.0, 1.0, 0.0] for i in range(2000)])
    whole = [x for total, there in vx._sums([batch]) for x in vx._as_cells(total, there).to_pylist()]
    sizes = [len(total) for total, _ in vx._sums([batch])]
    assert len(whole) == 2000 == sum(sizes) and max(sizes) <= vx._SLICE_ROWS
    for i in (0, 1, 699, 1999):
        want = {}
        for w in words[i]:
            for bucket, v in vx._word_hashes(w):
                want[bucket] = want.get(bucket, 0.0) + v
        for c, strength in enumerate((float(i % 3), 0.0, 1.0, 0.0)):
            if strength:
                want |= {fv.HASH_BUCKETS + c * fv.CLUSTER_WIDTH + j: strength for j in range(fv.CLUSTER_WIDTH)}
        assert [(c["dim"], c["v"]) for c in whole[i]] == sorted(want.items())


def test_vectors_are_worked_out_once(spark):
    """A filter drawn from a later explode must not repeat the Python step."""
    df = spark.createDataFrame([(1, "one two three")], "id int, text string")
    plan = rt.embed_sparse(df, id_col="id", text_col="text").select("id", F.explode("cells"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("unit_features(") == 1


def test_texts_go_to_workers_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(3).select("id", F.lit("some words here").alias("text"))
    try:
        spark.conf.set(key, "10000")
        rt.embed_sparse(docs, id_col="id", text_col="text")
        assert int(spark.conf.get(key)) <= 1000
        spark.conf.set(key, "5000")
        assert rt.embed(docs, id_col="id", text_col="text").count() == 3 and spark.conf.get(key) == "5000"
    finally:
        spark.conf.set(key, before)
