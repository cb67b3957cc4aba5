"""Hard negatives by threshold joins with an inverted index that is cut by norms.

Scores are inner products of integer vectors. The rows of a block are indexed by
dimension, those of largest energy first. What a row has in the last dimensions is
left out of the index where, by its norm and those of the queries, it could not lift
a score to the threshold by itself. Partial scores are accumulated over the index; a
pair is dropped as soon as the norms of what remains cannot bring it to its threshold,
and pairs that are left are finished from the vectors. (L2AP's bounds, on blocks.)

Thresholds start high: at what a sample promises to fill a list. Rows below are
looked for in later rounds, by windows that are not full, down to the windows' floors;
so a list is complete whatever the sample said.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.work import new_dir, written

STEP = 8  # dimensions between two prunings
SPARSE = 0.1  # below this share of pairs they are finished one by one
FOUND = "query bigint, list bigint, tag bigint, id bigint, score bigint"


def _suffix_norms(rows: np.ndarray) -> np.ndarray:
    """Of each row the norms of what follows after 0, STEP, 2 STEP, ... dimensions."""
    squares = np.cumsum((rows * rows)[:, ::-1], axis=1)[:, ::-1]
    out = np.zeros((len(rows), -(-rows.shape[1] // STEP) + 1))
    out[:, :-1] = np.sqrt(squares[:, ::STEP])
    # rounding must not make a bound too small
    return out * (1 + 1e-9)


class Queries:
    """Query vectors with their suffix norms."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.norms = _suffix_norms(vectors)

    def some(self, which: np.ndarray) -> "Queries":
        out = object.__new__(Queries)
        out.vectors, out.norms = self.vectors[which], self.norms[which]
        return out


def threshold_pairs(queries: Queries, rows: np.ndarray, least: np.ndarray):
    """Pairs (query, row, score) with a score of at least the query's threshold, exact."""
    n, d = rows.shape
    groups = -(-d // STEP)
    norms = _suffix_norms(rows)
    # up to the cut a row is indexed: what follows cannot reach any query's threshold by itself
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(queries.norms > 0, least[:, None] / queries.norms, np.where(least[:, None] > 0, np.inf, -np.inf)).min(axis=0)
    cut = (norms >= bound).sum(axis=1) if len(least) else np.zeros(n, dtype=int)
    order = np.argsort(-cut, kind="stable")
    cut, rows, norms = cut[order], rows[order], norms[order]
    place, mine = order, np.arange(len(least))
    acc = np.zeros((len(least), n))
    alive = acc + queries.norms[:, :1] * norms[None, :, 0] >= least[:, None]
    at = 0
    while at < groups and alive.mean() > SPARSE if alive.size else False:
        # the list of a dimension: rows whose cut lies beyond it, the first ones in this order
        to = int(np.searchsorted(-cut, -at, side="left"))
        if not to:
            break
        dims = slice(at * STEP, (at + 1) * STEP)
        acc[:, :to] += queries.vectors[:, dims] @ rows[:to, dims].T
        at += 1
        # rows behind their cut have only accumulated up to it
        done = np.minimum(at, cut)
        rest = queries.norms[:, done] * norms[np.arange(len(rows)), done][None, :]
        alive &= acc + rest >= least[:, None]
        live_rows, live = alive.any(axis=0), alive.any(axis=1)
        if live_rows.mean() < 0.7 or live.mean() < 0.7:
            acc, alive = acc[np.ix_(live, live_rows)], alive[np.ix_(live, live_rows)]
            queries, least, mine = queries.some(live), least[live], mine[live]
            rows, norms, cut, place = rows[live_rows], norms[live_rows], cut[live_rows], place[live_rows]
    q, r = np.nonzero(alive)
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(queries.vectors).max(initial=0)) * d
    kinds = float if most < 1 << 53 else np.int64
    if len(q) > SPARSE * alive.size and kinds is float:
        score = (queries.vectors @ rows.T)[q, r]
    else:
        score = np.empty(len(q), dtype=kinds)
        for i in range(0, len(q), 1 << 16):
            s = slice(i, i + (1 << 16))
            score[s] = np.einsum("ij,ij->i", queries.vectors[q[s]].astype(kinds), rows[r[s]].astype(kinds))
    enough = score >= least[q]
    return mine[q[enough]], place[r[enough]], score[enough].astype(np.int64)


class Best:
    """The first ``k`` rows of many lists, by falling score, then id, then tag."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.kth = np.full(lists, np.iinfo(np.int64).min)  # score of the last of a full list
        self.rows = np.zeros((4, 0), dtype=np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, lists: np.ndarray, tags: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        new = scores >= self.kth[lists]
        if new.any():
            self.waiting.append(np.stack([lists[new], -scores[new], ids[new], tags[new]]))
            self.size += int(new.sum())
        if self.size > max(100_000, 2 * self.rows.shape[1]):
            self.settle()

    def settle(self) -> np.ndarray:
        rows = np.concatenate([self.rows, *self.waiting], axis=1)
        rows = rows[:, np.lexsort(rows[::-1])]
        starts = np.flatnonzero(np.diff(rows[0], prepend=-1))
        rank = np.arange(rows.shape[1]) - np.repeat(starts, np.diff(np.append(starts, rows.shape[1])))
        last = rank == self.k - 1
        self.kth[rows[0][last]] = -rows[1][last]
        self.rows, self.waiting, self.size = rows[:, rank < self.k], [], 0
        return self.rows


def _blocks(batches, order: np.ndarray):
    """Rows of a batch that have the queries' length: tags, ids, labels, vectors with their dimensions in order."""
    for batch in batches:
        x = batch.column("x")
        lengths = x.value_lengths().to_numpy(zero_copy_only=False)
        fits = pa.array(lengths == len(order))
        values = x.filter(fits).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(order))
        take = lambda c: batch.column(c).filter(fits).to_numpy(zero_copy_only=False)
        yield take("tag"), take("id"), take("label"), values[:, order].astype(float)


def _same_label(candidates: DataFrame, shared, k: int) -> DataFrame:
    """Lists of the best other rows of the same label, at least as good as the query's bound."""

    def run(batches):
        q = shared.value
        best = Best(len(q["tags"]), k)
        by_label = {label: np.flatnonzero(q["labels"] == label) for label in np.unique(q["labels"]).tolist()}
        for tags, ids, labels, rows in _blocks(batches, q["order"]):
            for label in np.unique(labels).tolist():
                of = by_label.get(label)
                if of is None:
                    continue
                mine = np.flatnonzero(labels == label)
                least = np.maximum(q["least"][of], best.kth[of])
                a, b, score = threshold_pairs(q["queries"].some(of), rows[mine], least.astype(float))
                a, b = of[a], mine[b]
                other = q["tags"][a] != tags[b]
                best.add(a[other], tags[b[other]], ids[b[other]], score[other])
        yield _found(best, lambda lists: lists)

    return candidates.mapInArrow(run, FOUND)


def _in_windows(candidates: DataFrame, shared, k: int) -> DataFrame:
    """Lists of the best rows of other labels whose score lies in a window."""

    def run(batches):
        q = shared.value
        owner, low, high = q["owner"], q["low"], q["high"]
        best = Best(len(owner), k)
        some = np.unique(owner)
        queries = q["queries"].some(some)
        starts = np.searchsorted(owner, some)
        counts = np.diff(np.append(starts, len(owner)))
        for tags, ids, labels, rows in _blocks(batches, q["order"]):
            lowest = np.minimum.reduceat(np.maximum(low, best.kth), starts) if len(some) else np.zeros(0)
            a, b, score = threshold_pairs(queries, rows, lowest.astype(float))
            other = q["labels"][some[a]] != labels[b]
            a, b, score = a[other], b[other], score[other]
            for i in range(counts.max(initial=0)):
                has = counts[a] > i
                window = starts[a[has]] + i
                s, of = score[has], b[has]
                inside = (s >= low[window]) & (s <= high[window])
                best.add(window[inside], tags[of[inside]], ids[of[inside]], s[inside])
        yield _found(best, lambda lists: owner[lists])

    return candidates.mapInArrow(run, FOUND)


def _found(best: Best, query_of) -> pa.RecordBatch:
    lists, scores, ids, tags = best.settle()
    return pa.RecordBatch.from_arrays(
        [pa.array(x.astype(np.int64)) for x in (query_of(lists), lists, tags, ids, -scores)],
        names=["query", "list", "tag", "id", "score"],
    )


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id", "tag"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """Of each line its k-th largest value; the smallest integer where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), np.iinfo(np.int64).min)
    out = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    return np.where(np.isfinite(out), out, np.iinfo(np.int64).min).astype(np.int64)


def _sample_bounds(q: dict, sample: dict, k: int) -> np.ndarray:
    """A score that at least k other rows of the query's label reach, from the sample."""
    out = []
    for at in range(0, len(q["tags"]), 1024):
        s = slice(at, at + 1024)
        scores = q["queries"].vectors[s] @ sample["rows"].T
        fits = (q["labels"][s, None] == sample["labels"]) & (q["tags"][s, None] != sample["tags"])
        out.append(_kth(np.where(fits, scores, -np.inf), k))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _first_thresholds(q: dict, windows: dict, sample: dict, wanted: int) -> np.ndarray:
    """For each window the sample's score below its top behind which the list should be full."""
    out = windows["floor"].copy()
    for at in range(0, len(out), 1024):
        s = slice(at, at + 1024)
        of = windows["owner"][s]
        scores = q["queries"].vectors[of] @ sample["rows"].T
        fits = (q["labels"][of, None] != sample["labels"]) & (scores <= windows["top"][s, None])
        out[s] = np.maximum(out[s], _kth(np.where(fits, scores, -np.inf), wanted))
    return out


def mine(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    sample_rows: int = 4096,
    chunk_bytes: int = 64 << 20,
) -> DataFrame:
    """For each anchor and positive the best rows of other labels in a window of scores.

    A component x counts as floor(scale * x). Positives are the anchor's best other rows of
    its label; negatives the first ``negatives`` rows of other labels with low * p <= 100 *
    score <= high * p, p the positive's score. Ties go to the smaller id. Returns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.

    Ids are integers. Rows with a null id or label, a null vector, or a null or non-finite
    component take no part; scores of vectors of different lengths are not taken. Rows that
    repeat an id are rows of their own (an anchor's copy can be its positive). Extra columns
    are left out; an empty table gives no row. Scores have to fit 63 bits.

    Of equal vectors with one label only as many as a list can hold are compared. Anchors are
    sent to the tasks in chunks of ``chunk_bytes``; the candidates stay where they are, and a
    task gives back no more than a full list a window. ``sample_rows`` rows, those of smallest
    hash, give the first thresholds: they change the time, not the rows.
    """
    spark = vectors.sparkSession
    fresh = lambda df, name: written(df, new_dir(spark, name))
    given = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"), anchor.alias("anchor"),
    )
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = fresh(
        given.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(~odd).select(
            F.monotonically_increasing_id().alias("tag"), "id", "label", F.coalesce("anchor", F.lit(False)).alias("anchor"),
            F.transform("v", lambda c: F.floor(c * scale).cast("bigint")).alias("x"),
        ),
        "rows",
    )
    # a list of k rows, the anchor itself left out, holds no more than k + 1 equal vectors
    copies = F.row_number().over(Window.partitionBy("label", "x").orderBy("id", "tag"))
    few = rows.withColumn("_copy", copies).where(F.col("_copy") <= max(positives + 1, negatives))
    candidates = fresh(few.select("tag", "id", "label", "x").repartitionByRange("label", F.xxhash64("tag")), "candidates")
    out = []
    for (d,) in rows.where("anchor").select(F.size("x")).distinct().collect():
        if d:
            out.append(_mine_length(rows, candidates, d, positives, negatives, low, high, sample_rows, chunk_bytes, fresh))
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    result = spark.createDataFrame([], schema)
    for df in out:
        result = result.unionByName(df)
    return result


def _mine_length(rows, candidates, d, positives, negatives, low, high, sample_rows, chunk_bytes, fresh) -> DataFrame:
    """``mine`` for vectors of one length."""
    spark = rows.sparkSession
    mine_ = candidates.where(F.size("x") == d)
    total = mine_.count()
    share = min(1.0, sample_rows / max(total, 1))
    drawn = mine_.where(F.pmod(F.xxhash64("tag"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * sample_rows).toArrow()
    sample = {"rows": _matrix(drawn, d), "labels": drawn.column("label").to_numpy(), "tags": drawn.column("tag").to_numpy()}
    order = np.argsort(-(sample["rows"] ** 2).sum(axis=0), kind="stable")
    sample["rows"] = sample["rows"][:, order]
    anchors = rows.where(F.col("anchor") & (F.size("x") == d)).select("tag", "id", "label", "x")
    n_anchors = anchors.count()
    chunks = max(1, math.ceil(n_anchors * (8 * d + 64) / chunk_bytes))
    results = None
    for chunk in range(chunks):
        part = anchors.where(F.pmod(F.xxhash64(F.lit(7), "tag"), F.lit(chunks)) == chunk).toArrow()
        found = _mine_chunk(spark, mine_, part, order, sample, total, positives, negatives, low, high, fresh)
        if found is not None:
            results = found if results is None else results.unionByName(found)
    return results if results is not None else spark.createDataFrame(
        [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    )


def _matrix(table: pa.Table, d: int) -> np.ndarray:
    return table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(float)


def _mine_chunk(spark, candidates, part, order, sample, total, positives, negatives, low, high, fresh) -> DataFrame | None:
    """Lists of one chunk of anchors; what is kept on the driver is bounded by the chunk."""
    send = spark.sparkContext.broadcast
    sent = []
    q = {
        "tags": part.column("tag").to_numpy(), "ids": part.column("id").to_numpy(), "labels": part.column("label").to_numpy(),
        "queries": Queries(_matrix(part, len(order))[:, order]), "order": order,
    }
    if not len(q["tags"]):
        return None
    sent.append(send(q | {"least": _sample_bounds(q, sample, positives)}))
    best = _first(_same_label(candidates, sent[-1], positives), positives).select("query", "rank", "id", "score").toArrow()
    best = best.sort_by([("query", "ascending"), ("rank", "ascending")])
    owner, score, positive = (best.column(c).to_numpy() for c in ("query", "score", "id"))
    top, floor = score * high // 100, -(-score * low // 100)
    real = floor <= top
    owner, score, positive, top, floor = owner[real], score[real], positive[real], top[real], floor[real]
    windows = {"owner": owner, "top": top, "floor": floor}
    # so many of the sample's rows stand for four full lists, at least one
    wanted = max(1, math.ceil(4 * negatives * len(sample["tags"]) / max(total, 1)))
    at, upper = _first_thresholds(q, windows, sample, wanted), top.copy()
    open_ = np.arange(len(owner))
    have = np.zeros(len(owner), dtype=np.int64)
    founds, last = [], 3
    for turn in range(last + 1):
        if not len(open_):
            break
        if turn == last:
            at[open_] = floor[open_]
        sent.append(send({
            "queries": q["queries"], "labels": q["labels"], "order": order,
            "owner": owner[open_], "low": at[open_], "high": upper[open_],
        }))
        found = fresh(_in_windows(candidates, sent[-1], negatives), "found")
        got = _first(found, negatives).groupBy("list").count().toArrow()
        # lists are numbered anew in each round; their own numbers come back by a small table
        numbers = spark.createDataFrame(pa.table({"list": np.arange(len(open_)), "window": open_.astype(np.int64)}))
        founds.append(found.join(F.broadcast(numbers), "list").select(F.col("window").alias("list"), "tag", "id", "score"))
        have[open_[got.column("list").to_numpy()]] += got.column("count").to_numpy()
        upper[open_] = at[open_] - 1
        open_ = open_[(have[open_] < negatives) & (at[open_] > floor[open_])]
        reach = 4 * (top[open_] - at[open_]) + 1
        at[open_] = np.maximum(floor[open_], top[open_] - reach)
    every = None
    for f in founds:
        every = f if every is None else every.unionByName(f)
    for s in sent:
        s.unpersist()
    if every is None:
        return None
    about = spark.createDataFrame(pa.table({
        "list": np.arange(len(owner)), "anchor_id": q["ids"][owner], "positive_id": positive, "positive_score": score,
    }))
    return _first(every, negatives).join(F.broadcast(about), "list").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
