"""The stored cell index: recall, exact finish, appended rows, growth of the candidates."""

import math
import os

import duckdb
import numpy as np
import pytest
from compare import compare

from reviewlake.catalog import ORACLES, QUERIES
from reviewlake.operators import cells as cl

K, FLOOR = 3, 0.3


def frame(spark, points, first=0):
    rows = [(first + i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "item_id int, vec array<double>").repartition(6)


def exact(points, asked):
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    sims = np.round(unit[asked] @ unit.T, 9)
    out = {}
    for row, i in zip(sims, asked):
        order = sorted(np.flatnonzero(row >= FLOOR).tolist(), key=lambda j: (-row[j], str(j)))[:K]
        out[i] = [str(j) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(int(r.query_id), []).append(r.item_id)
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 24))
    return np.concatenate([centres[rng.integers(60, size=9000)] + rng.standard_normal((9000, 24)) * 0.35, np.tile(centres[0], (1000, 1))])


def test_exact_finish_and_appended_rows(spark, clustered, tmp_path):
    path = str(tmp_path / "index")
    cl.build(frame(spark, clustered[:6000]), path, dim=24, k=K, min_sim=FLOOR)
    stamp = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs}
    cl.append(frame(spark, clustered[6000:], 6000), path)
    assert cl.stored_rows(spark, path).count() == len(clustered)
    now = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/rows") for f in fs if f.endswith(".parquet")}
    assert all(stamp[f] == now[f] for f in now if f in stamp)
    asked = list(range(0, len(clustered), 50))
    queries = frame(spark, clustered).where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    want = exact(clustered, asked)
    assert found(cl.search(queries, path, k=K, min_sim=FLOOR, exact=True)) == want
    assert found(cl.search(queries, path, k=K, min_sim=FLOOR, exact=True, probes=1)) == want
    near = found(cl.search(queries, path, k=K, min_sim=FLOOR))
    hits = sum(len(set(near.get(i, [])) & set(want[i])) for i in asked)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_queries_in_chunks(spark, clustered, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    points = clustered[:2000]
    cl.build(frame(spark, points), path, dim=24, k=K, min_sim=FLOOR)
    monkeypatch.setattr(cl, "MAX_BROADCAST_NUMBERS", 2500)
    queries = frame(spark, points).where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    assert found(cl.search(queries, path, k=K, min_sim=FLOOR, exact=True)) == exact(points, list(range(0, 2000, 50)))


def test_every_row_asks_every_row(spark, tmp_path):
    """ann_join over a table of its own: all rows are queries, and rows that come twice count twice."""
    rng = np.random.default_rng(7)
    points = (rng.standard_normal((12, 64))[rng.integers(12, size=180)] + rng.standard_normal((180, 64)) * 0.6).astype(np.float32)
    rows = [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]
    rows += [rows[i] for i in (3, 50, 51)] + [(7, rows[90][1], 0), (500, None, 0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    problem, n, _, _ = compare(spark, con, "ann_join", QUERIES["ann_join"], ORACLES["ann_join"], str(tmp_path))
    assert problem is None
    got = QUERIES["ann_join"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == {str(i) for i in range(180)}
    assert len(got) == n > 400
    assert sorted(r.item_id for r in got if r.query_id == "50")[:2] == ["50", "50"]


def test_all_rows_in_chunks(spark, clustered, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    points = np.concatenate([clustered[:1400], clustered[-200:]])
    cl.build(frame(spark, points), path, dim=24, k=K, min_sim=FLOOR)
    monkeypatch.setattr(cl, "MAX_BROADCAST_NUMBERS", 20000)
    monkeypatch.setattr(cl, "LOOK_NUMBERS", 20000)
    want = exact(points, list(range(len(points))))
    queries = frame(spark, points).withColumnRenamed("item_id", "query_id")
    assert found(cl.search(queries, path, k=K, min_sim=FLOOR, exact=True, merge_ids=False)) == want
    assert found(cl.search(queries, path, k=K, min_sim=FLOOR, exact=True, merge_ids=False, probes=2)) == want


def test_reach_lies_in_a_gap():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 6))
    centres = np.concatenate([centres, centres[:5]])
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = rng.standard_normal((40, 6))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    for probes in (1, 4, 24, 25):
        near, reach = rows @ centres.T, cl._reach(rows, centres, probes)
        assert np.abs(near - reach[:, None]).min() > cl.GAP / 4
        n = (near >= reach[:, None]).sum(axis=1)
        assert ((n == probes) | (n == probes + 1)).all()
    assert (cl._reach(np.zeros((2, 6)), centres, 3) == -2).all()


@pytest.mark.parametrize("kind", ["clustered", "random"])
def test_recall_holds_and_candidates_grow_slower_than_pairs(spark, tmp_path, kind):
    rng = np.random.default_rng(11)
    shares, sizes = [], (1500, 15000)
    for n in sizes:
        points = rng.standard_normal((n, 24))
        if kind == "clustered":
            points = rng.standard_normal((n // 50, 24))[rng.integers(n // 50, size=n)] + 0.35 * points
        path = str(tmp_path / f"{n}")
        items = frame(spark, points)
        cl.build(items, path, dim=24, k=K, min_sim=FLOOR)
        queries = items.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
        near, want = found(cl.search(queries, path, k=K, min_sim=FLOOR)), exact(points, list(range(0, n, 50)))
        assert sum(len(set(near.get(i, [])) & set(want[i])) for i in want) >= 0.9 * sum(map(len, want.values())) > 0
        shares.append(cl.candidates(queries, path).agg({"n": "avg"}).first()[0] / n)
    growth = 2 + math.log(shares[1] / shares[0]) / math.log(sizes[1] / sizes[0])
    assert growth < (1.7 if kind == "clustered" else 1.95)


def test_odd_rows(spark, tmp_path):
    path = str(tmp_path / "odd")
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.1]), (4, [0.9, 0.0]), (None, [1.0, 0.0]), (5, [1.0])]
    df = spark.createDataFrame(rows, "item_id int, vec array<double>")
    cl.build(df, path, dim=2, k=K, min_sim=FLOOR)
    got = cl.search(df.withColumnRenamed("item_id", "query_id").where("query_id = 1"), path, k=5, min_sim=FLOOR, exact=True).collect()
    assert [(r.item_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.item_id] == [("1", 1.0), ("4", 1.0)]
    cl.build(df.limit(0), path + "0", dim=2, k=K, min_sim=FLOOR)
    assert cl.search(df.withColumnRenamed("item_id", "query_id"), path + "0", k=K, min_sim=FLOOR, exact=True).collect() == []


def test_sessions_without_arrow(spark, clustered, tmp_path):
    """Spark's own default; numbers of numpy are no numbers to it."""
    key, path = "spark.sql.execution.arrow.pyspark.enabled", str(tmp_path / "index")
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        cl.build(frame(spark, clustered[:500]), path, dim=24, k=K, min_sim=FLOOR)
        asked = frame(spark, clustered[:20]).withColumnRenamed("item_id", "query_id")
        assert found(cl.search(asked, path, k=K, min_sim=FLOOR, exact=True)) == exact(clustered[:500], list(range(20)))
    finally:
        spark.conf.set(key, before)
