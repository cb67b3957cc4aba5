"""A stored index of vectors by cells around fitted centres.

The centres are fitted on a bounded sample, every row is put into the cell of its
nearest centre, and the rows are stored by cells. A query looks into the cells of its
nearest centres; how many, is measured when the index is made, so that at least nine
tenths of the matches of sampled queries are found. New rows are appended to the cells
without fitting anew. A search can be finished exactly: every cell knows how far its
rows lie from its centre, which bounds the score of any of them for a query; cells that
could still hold a match are looked into as well, and no others.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.work import new_dir, written
from .retrieval import MATCH_SCHEMA, MAX_BROADCAST_NUMBERS, _by_id, _keep_best, _pairs, _unit, rank_matches, topk

RECALL = 0.9
AIMED = 0.95  # share of the matches of sampled queries; the queries of a search may be harder than the sample
PER_ROOT = 4  # cells for each root of the number of rows
MAX_CELLS = 1 << 14
SAMPLE_ROWS = 1 << 17  # rows that the centres are fitted on, at most, and 32 a cell
TEST_QUERIES = 500
ROUNDS = 5
PART_CELLS = 64  # cells of one folder
SLACK = 1e-6  # scores are rounded to nine digits; bounds have to be safe against that
GAP = 1e-9  # cosines in double precision that differ by more stand in the same order on every machine
LOOK_NUMBERS = 1 << 21  # cosines of queries to centres that are held at a time

FOUND = f"at int, {MATCH_SCHEMA}"  # at: the query's place in its chunk
ROWS = "id string, vec array<double>, cell int, near double, part int"


def fit_centres(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` unit centres of unit rows; spherical k-means from the first rows of the sample."""
    sample = sample.astype(np.float32)
    centres = sample[:n].copy()
    for _ in range(ROUNDS):
        own = _nearest(sample, centres, 1)[:, 0]
        order = np.argsort(own, kind="stable")
        there, starts = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(sample[order], starts, axis=0)
        size = np.linalg.norm(sums, axis=1)
        centres[there[size > 0]] = sums[size > 0] / size[size > 0, None]
    return centres.astype(np.float64)


def _nearest(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of every row, the nearest first."""
    out = np.empty((len(rows), n), dtype=np.int64)
    for at in range(0, len(rows), 4096):
        near = rows[at: at + 4096] @ centres.T
        if n == 1:
            out[at: at + 4096, 0] = near.argmax(axis=1)
        else:
            some = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < near.shape[1] else np.argsort(-near, axis=1)
            by = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
            out[at: at + 4096] = np.take_along_axis(some, by, axis=1)
    return out


def _assigned(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """Unit rows (id, vec) with their cell and the cosine to its centre; rows without direction drop out."""
    shared = items.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            c = shared.value
            rows = _unit(list(batch["vec"]), c.shape[1])
            real = np.abs(rows).sum(axis=1) > 0
            if not real.any():
                continue
            rows, ids = rows[real], batch["id"][real]
            cell = _nearest(rows, c, 1)[:, 0]
            near = (rows * c[cell]).sum(axis=1)
            yield pd.DataFrame({"id": ids, "vec": list(rows), "cell": cell.astype(np.int32), "near": near, "part": (cell // PART_CELLS).astype(np.int32)})

    return items.mapInPandas(assign, ROWS)


def build(items: DataFrame, path: str, *, dim: int, k: int, min_sim: float, item_id: str = "item_id", vec: str = "vec") -> None:
    """Fit the centres, store all rows, and measure how many cells a query has to look into.

    Centres are fitted on the rows of smallest hash, up to 32 a cell and 131,072 in all.
    The number of cells follows the root of the number of rows, up to 16,384: beyond about
    16 million rows cells get larger. Null or zero vectors match nothing and are not kept.
    """
    spark = items.sparkSession
    c = items.select(F.col(item_id).cast("string").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    n = c.count()
    cells = max(1, min(MAX_CELLS, math.ceil(PER_ROOT * math.sqrt(n)), n))
    wanted = min(SAMPLE_ROWS, 32 * cells, max(1, MAX_BROADCAST_NUMBERS // dim))
    share = min(1.0, 1.1 * wanted / max(n, 1))
    drawn = c.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = drawn.orderBy(F.xxhash64("id"), "id").limit(wanted).toPandas()
    rows = _unit(list(sample["vec"]), dim) if len(sample) else np.zeros((0, dim))
    rows = np.unique(rows[np.abs(rows).sum(axis=1) > 0], axis=0)
    rows = rows[np.random.default_rng(0).permutation(len(rows))]
    centres = fit_centres(rows, min(cells, len(rows))) if len(rows) else np.eye(1, dim)
    names = pd.DataFrame({"cell": np.arange(len(centres), dtype=np.int32), "centre": centres.tolist()})
    spark.createDataFrame(names, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    _store(_assigned(c, centres), path, "overwrite")
    probes, recall = _measure(spark, c, path, centres, dim, k, min_sim)
    meta = [(dim, len(centres), probes, recall)]
    spark.createDataFrame(meta, "dim int, cells int, probes int, recall double").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def _store(rows: DataFrame, path: str, mode: str) -> None:
    # a cell of many rows spreads over tasks by the hash of the id
    ordered = rows.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("part", "cell")
    ordered.write.mode(mode).partitionBy("part").parquet(f"{path}/rows")


def append(items: DataFrame, path: str, *, item_id: str = "item_id", vec: str = "vec") -> None:
    """Put further rows into the cells of a stored index; nothing that is there is read or moved."""
    c = items.select(F.col(item_id).cast("string").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    _store(_assigned(c, _centres(items.sparkSession, path)), path, "append")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()
    return np.array(rows["centre"].tolist(), dtype=float)


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{path}/rows")


def _measure(spark, c: DataFrame, path: str, centres: np.ndarray, dim, k, min_sim) -> tuple[int, float]:
    """How many cells find AIMED of the exact matches of sampled queries, and the share they find there.

    Equal vectors always share a cell and are left out; a sample has to be better by two
    standard errors. Without any match one cell is enough.
    """
    asked = c.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(TEST_QUERIES)
    query = spark.createDataFrame([(i, list(map(float, v))) for i, v in asked.collect()], "id string, vec array<double>")
    best = topk(query, c, dim=dim, k=k + 1, min_sim=min_sim, query_id="id", item_id="id").where("score < 1 AND query_id <> item_id")
    place = stored_rows(spark, path).groupBy(F.col("id").alias("item_id")).agg(F.min("cell").alias("cell"))
    pairs = best.join(place, "item_id").join(query.withColumnRenamed("id", "query_id"), "query_id").toPandas()
    if not len(pairs):
        return 1, 1.0
    order = np.argsort(-(_unit(list(pairs["vec"]), dim) @ centres.T), axis=1, kind="stable")
    ranks = np.sort((order == pairs["cell"].to_numpy()[:, None]).argmax(axis=1))
    share = AIMED + 2 * math.sqrt(AIMED * (1 - AIMED) / len(ranks))
    probes = int(ranks[min(len(ranks), math.ceil(share * len(ranks))) - 1]) + 1
    return probes, float((ranks < probes).mean())


def search(
    queries: DataFrame, path: str, *, k: int, min_sim: float, query_id: str = "query_id", vec: str = "vec",
    probes: int | None = None, exact: bool = False, merge_ids: bool = True,
) -> DataFrame:
    """Top-k of the stored rows: (query_id, item_id, score, rank); ties go to the smaller id.

    Scores are exact; with ``exact`` so are the matches. Queries are sent to the tasks in
    chunks of checked size, each with the cosine that its cells reach; of the rows only the
    folders of these cells are read, and a task gives back at most k rows a query. With
    ``merge_ids`` an item id counts once for a query id, by its best score; without, every row counts.
    """
    spark = queries.sparkSession
    about = spark.read.parquet(f"{path}/about").first()
    centres, dim = _centres(spark, path), about["dim"]
    probes = min(len(centres), probes or about["probes"])
    q = queries.select(F.col(query_id).cast("string").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    # a query costs its vector, the cosine its cells reach and its floor; four fifths of the bound, as hashes do not part rows quite evenly
    most = max(1, MAX_BROADCAST_NUMBERS * 4 // ((dim + 2) * 5))
    chunks = max(1, math.ceil(q.count() / most))
    radius = np.full(len(centres), 2.0)
    if exact:
        for cell, low in stored_rows(spark, path).groupBy("cell").agg(F.min("near")).collect():
            radius[cell] = low
    cells = spark.sparkContext.broadcast((centres, radius))
    every = None
    for i in range(chunks):
        part = q.where(F.pmod(F.xxhash64("id", "vec"), F.lit(chunks)) == i)
        ids, vectors, reach = _fetched_queries(part, cells, probes)
        if not ids:
            continue
        asked = spark.sparkContext.broadcast((ids, vectors, reach))
        least = np.full(len(ids), min_sim, dtype=float)
        parts = _folders(vectors, reach, least, centres, radius, finish=False)
        found = _scored(spark, path, parts, asked, cells, k, least, finish=False, merge_ids=merge_ids)
        if exact or chunks > 1:
            found = written(found, new_dir(spark, "found"))
        if exact:
            least = _floors(found, k, least, merge_ids)
            parts = _folders(vectors, reach, least, centres, radius, finish=True)
            rest = _scored(spark, path, parts, asked, cells, k, least, finish=True, merge_ids=merge_ids)
            found = found.unionByName(written(rest, new_dir(spark, "found")) if chunks > 1 else rest)
        if chunks > 1:
            asked.destroy()
        every = found if every is None else every.unionByName(found)
    if every is None:
        every = spark.createDataFrame([], FOUND)
    if merge_ids:
        every = every.groupBy("query_id", "item_id").agg(F.max("sim").alias("sim"))
    return rank_matches(every.select("query_id", "item_id", "sim"), k)


def _reach(rows: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """For every row a cosine that its ``probes`` nearest centres are above and all others below.

    It lies in a gap that no rounding closes, so that every task that compares with it
    finds the same cells; of centres without such a gap between them all or none are above.
    """
    out = np.full(len(rows), -2.0)
    step = max(1, LOOK_NUMBERS // len(centres))
    for at in range(0, len(rows) if probes < len(centres) else 0, step):
        near = np.partition(rows[at: at + step] @ centres.T, [-probes - 1, -probes], axis=1)
        low, high = near[:, -probes - 1], near[:, -probes]
        out[at: at + step] = np.where(high - low > GAP, (low + high) / 2, -2.0)
        for i in np.flatnonzero(high - low <= GAP):
            by = np.sort(near[i])[::-1][probes - 1:]
            wide = np.flatnonzero(by[:-1] - by[1:] > GAP)
            if len(wide):
                out[at + i] = (by[wide[0]] + by[wide[0] + 1]) / 2
    return out


def _fetched_queries(q: DataFrame, cells, probes: int) -> tuple[list, np.ndarray, np.ndarray]:
    """The ids of queries, their unit rows, and the cosines that their first cells reach."""

    def reach(batches):
        for batch in batches:
            centres = cells.value[0]
            rows = _unit(list(batch["vec"]), centres.shape[1])
            yield pd.DataFrame({"id": batch["id"], "vec": list(rows), "reach": _reach(rows, centres, probes)})

    found = q.mapInPandas(reach, "id string, vec array<double>, reach double").toArrow()
    rows = [part.flatten().to_numpy() for part in found.column("vec").chunks]
    vectors = np.concatenate(rows).reshape(found.num_rows, -1) if found.num_rows else np.zeros((0, 1))
    return found.column("id").to_pylist(), vectors, found.column("reach").to_numpy()


def _floors(found: DataFrame, k: int, least: np.ndarray, merge_ids: bool) -> np.ndarray:
    """The floor of every query once ``found`` is known: its k-th score, as far as there are k."""
    sims = found.groupBy("at", "item_id").agg(F.max("sim").alias("sim")) if merge_ids else found
    w = Window.partitionBy("at").orderBy(F.col("sim").desc())
    kth = sims.select("at", "sim", F.row_number().over(w).alias("rank")).where(F.col("rank") == k).toArrow()
    out = least.copy()
    out[kth.column("at").to_numpy()] = kth.column("sim").to_numpy() - SLACK
    return np.maximum(out, least)


def candidates(queries: DataFrame, path: str, *, query_id: str = "query_id", vec: str = "vec", probes: int | None = None) -> DataFrame:
    """(query_id, n): how many rows a search without exact finish compares with each query."""
    spark = queries.sparkSession
    about = spark.read.parquet(f"{path}/about").first()
    centres = _centres(spark, path)
    probes = min(len(centres), probes or about["probes"])
    sizes = np.zeros(len(centres), dtype=np.int64)
    for cell, n in stored_rows(spark, path).groupBy("cell").count().collect():
        sizes[cell] = n
    shared = spark.sparkContext.broadcast((centres, sizes))

    def count(batches):
        for batch in batches:
            c, n = shared.value
            near = _nearest(_unit(list(batch["vec"]), c.shape[1]), c, probes)
            yield pd.DataFrame({"query_id": batch["id"], "n": n[near].sum(axis=1)})

    q = queries.select(F.col(query_id).cast("string").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    return q.mapInPandas(count, "query_id string, n bigint")


def _could_match(near: np.ndarray, radius: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """For each query, by its cosines to the centres, the cells in which a row can reach its floor.

    Angles obey the triangle inequality: a row is at least as far from the query as
    the centre is, less the angle between the centre and the cell's farthest row.
    """
    gap = np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(radius, -1, 1))
    return (np.cos(np.maximum(gap, 0)) + SLACK >= floor[:, None]) & (radius <= 1 + SLACK)


def _looks(vectors: np.ndarray, reach: np.ndarray, least: np.ndarray, centres: np.ndarray, radius: np.ndarray, finish: bool):
    """(first query, whether it and the next ones look into a cell), some queries at a time.

    First into the cells that they reach; at the finish into those others that could match.
    """
    step = max(1, LOOK_NUMBERS // max(1, len(centres)))
    for a in range(0, len(vectors), step):
        s = slice(a, a + step)
        near = vectors[s] @ centres.T
        look = near >= reach[s, None]
        yield a, _could_match(near, radius, least[s]) & ~look if finish else look


def _folders(vectors: np.ndarray, reach: np.ndarray, least: np.ndarray, centres: np.ndarray, radius: np.ndarray, finish: bool) -> list[int]:
    """The folders of the cells that any query looks into."""
    seen = np.zeros(-(-len(centres) // PART_CELLS), dtype=bool)
    for _, look in _looks(vectors, reach, least, centres, radius, finish):
        seen[np.flatnonzero(look.any(axis=0)) // PART_CELLS] = True
        if seen.all():
            break
    return np.flatnonzero(seen).tolist()


def _scored(spark, path: str, parts: list[int], asked, cells, k: int, least: np.ndarray, *, finish: bool, merge_ids: bool) -> DataFrame:
    """The best k rows of each query and task in the cells it looks into.

    Where every row counts, the k-th score that a task has seen is the floor of what follows.
    """
    floors = spark.sparkContext.broadcast(least)
    rows = stored_rows(spark, path).where(F.col("part").isin(parts)).select("id", "vec", "cell")

    def score(batches):
        (names, matrix, reach), (centres, radius) = asked.value, cells.value
        floor = np.array(floors.value)
        top = np.full((len(floor), k), -2.0)
        best = pd.DataFrame({"query_id": np.zeros(0, np.int64), "item_id": np.zeros(0, object), "sim": np.zeros(0)})
        for batch in batches:
            batch = batch.sort_values("id", kind="stable")  # a null id stands last
            ids, cell, items = batch["id"].to_numpy(object), batch["cell"].to_numpy(), np.array(batch["vec"].tolist())
            there = np.unique(cell)
            stored = []
            for own in (np.flatnonzero(cell == c) for c in there):
                own, mine = _by_id(own, items[own], k)
                stored.append((np.array(own, dtype=np.int64), mine, mine.astype(np.float32)))
            found = []
            for a, look in _looks(matrix, reach, floor, centres[there], radius[there], finish):
                for (own, mine, light), asks in zip(stored, np.ascontiguousarray(look.T)):
                    who = a + np.flatnonzero(asks)
                    row, col, sim = _pairs(matrix[who], mine, k, floor[who], light)
                    if len(row):
                        found.append(pd.DataFrame({"query_id": who[row], "item_id": ids[own[col]], "sim": sim}))
                        if not merge_ids:
                            _raise(floor, top, who[row], sim)
            if found:
                best = pd.concat([best, *found] if len(best) else found)
                best = best[best["sim"].to_numpy() >= floor[best["query_id"].to_numpy()]]
                if merge_ids or len(best) > 2 * k * len(floor):
                    best = _keep_best(best, k)
        best = _keep_best(best, k)
        at = best["query_id"].to_numpy()
        yield pd.DataFrame({"at": at.astype(np.int32), "query_id": np.asarray(names, dtype=object)[at], "item_id": best["item_id"].to_numpy(), "sim": best["sim"].to_numpy()})

    return rows.mapInPandas(score, FOUND)


def _raise(floor: np.ndarray, top: np.ndarray, query: np.ndarray, sim: np.ndarray) -> None:
    """Put further scores, at most k a query and in the order of queries, into the k highest of each; floors rise to the k-th."""
    k = top.shape[1]
    some, start, inverse = np.unique(query, return_index=True, return_inverse=True)
    more = np.full((len(some), 2 * k), -2.0)
    more[:, :k] = top[some]
    more[inverse, k + np.arange(len(query)) - start[inverse]] = sim
    top[some] = np.sort(more, axis=1)[:, k:]
    floor[some] = np.maximum(floor[some], top[some, 0])
