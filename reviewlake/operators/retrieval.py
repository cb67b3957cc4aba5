"""Text vectors and top-k cosine retrieval.

Similarities are worked out block by block with matrix products inside tasks.
A task emits only the k best rows of each query it has seen, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import fixed
from ..functions.vectors import cluster_strength, dense, summed_features, tokens, unit_features
from ..plans.work import lean_batches, new_dir, written

# A side is sent to all tasks only up to this many numbers (64 MB of doubles).
MAX_BROADCAST_NUMBERS = 8_000_000
TILE_QUERIES, TILE_ITEMS = 512, 8192  # products of queries and items are made in tiles of so many
SIM_DIGITS = 9  # equal vectors must tie, whatever block they were multiplied in

MATCH_SCHEMA = "query_id string, item_id string, sim double"


def cluster_strengths(df: DataFrame, *, words_col: str) -> DataFrame:
    """Add ``_s0``, ``_s1``, ...: the strength of every keyword cluster."""
    joined = df.withColumn("_j", F.array_join(words_col, " "))
    names = {
        f"_s{i}": cluster_strength(F.col("_j"), kws) for i, (_, kws) in enumerate(fv.CLUSTERS)
    }
    return joined.withColumns(names).drop("_j")


def _words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, _w, _s): the words of every text and the strengths of its keyword clusters."""
    lean_batches(df.sparkSession)
    words = fixed(df.select(id_col, text_col), _w=tokens(F.coalesce(F.col(text_col), F.lit(""))))
    rated = cluster_strengths(words.select(id_col, "_w"), words_col="_w")
    return rated.select(id_col, "_w", F.array(*[f"_s{i}" for i in range(len(fv.CLUSTERS))]).alias("_s"))


def text_features(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, cells): summed (dim, v) features of every text before normalising.

    All of it happens within the row, so nothing is shuffled.
    """
    return fixed(_words(df, id_col, text_col), cells=summed_features("_w", "_s")).select(id_col, "cells")


def embed_sparse(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, cells): unit vectors as sorted (dim, v) structs, at most 768 of them.

    A text without words has no cells.
    """
    # settled, or a filter that Spark draws from a later explode works all vectors out twice
    return fixed(_words(df, id_col, text_col), cells=unit_features("_w", "_s")).select(id_col, "cells")


def embed(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, embedding): the full 768 numbers."""
    sparse = embed_sparse(df, id_col=id_col, text_col=text_col)
    return sparse.select(id_col, dense(F.col("cells")).alias("embedding"))


def _unit(vectors, dim: int) -> np.ndarray:
    """Rows of unit length; missing, misfit, zero and non-finite vectors become zero rows."""
    out = np.zeros((len(vectors), dim))
    fit = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
    if fit:
        out[fit] = np.stack([vectors[i] for i in fit])
    return _scaled(out)


def _scaled(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1))
    ok = (norms > 0) & np.isfinite(norms)
    rows[ok] /= norms[ok, None]
    rows[~ok] = 0.0
    return rows


def _best(sims: np.ndarray, qids, cids, k: int, floor) -> pd.DataFrame:
    """The k best items of every query row at or above the floor, which may be one for each row."""
    sims = np.clip(np.round(sims, SIM_DIGITS), -1.0, 1.0)
    cut = np.full(len(sims), floor, dtype=float)
    if sims.shape[1] > k:
        cut = np.maximum(cut, np.partition(sims, sims.shape[1] - k, axis=1)[:, -k])
    row, col = np.nonzero(sims >= cut[:, None])
    found = pd.DataFrame({
        "query_id": np.asarray(qids, dtype=object)[row], "item_id": np.asarray(cids, dtype=object)[col], "sim": sims[row, col],
    })
    return _keep_best(found, k)


def _matches(queries: np.ndarray, qids, items: np.ndarray, cids, k: int, floor, light=None) -> pd.DataFrame:
    """The k best items of every query row at or above its floor; the items stand in the order of their ids."""
    row, col, sim = _pairs(queries, items, k, floor, light)
    return pd.DataFrame({"query_id": np.asarray(qids, dtype=object)[row], "item_id": np.asarray(cids, dtype=object)[col], "sim": sim})


def _pairs(queries: np.ndarray, items: np.ndarray, k: int, floor, light=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows in ascending order, with the rows and scores of their k best items at or above their floor, the best first.

    Products are made in tiles of bounded size. A tile is looked through in single precision
    (``light``: the items so); the few pairs in it that may be among the best are multiplied
    again in double.
    """
    slack = (queries.shape[1] + 4) * float(np.finfo(np.float32).eps)
    floor = np.broadcast_to(np.asarray(floor, dtype=float), len(queries))
    light = items.astype(np.float32, copy=False) if light is None else light
    rows, cols, scores = [], [], []
    for a in range(0, len(queries), TILE_QUERIES):
        mine, cut = queries[a: a + TILE_QUERIES], floor[a: a + TILE_QUERIES].copy()
        row, col, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in range(0, len(items), TILE_ITEMS):
            hits = mine.astype(np.float32) @ light[b: b + TILE_ITEMS].T >= (cut - slack)[:, None]
            n = np.count_nonzero(hits)
            if n > 4 * k * len(mine):
                tile = items[b: b + TILE_ITEMS]
                best = _best(mine @ tile.T, np.arange(len(mine)), np.arange(len(tile)), k, cut)
                r, c, s = (best[x].to_numpy(t) for x, t in (("query_id", np.int64), ("item_id", np.int64), ("sim", float)))
            elif n:
                r, c = np.nonzero(hits)
                s = np.clip(np.round(np.einsum("ij,ij->i", mine[r], items[b + c]), SIM_DIGITS), -1.0, 1.0)
            else:
                continue
            some = s >= cut[r]
            row, col, sim = np.append(row, r[some]), np.append(col, b + c[some]), np.append(sim, s[some])
            by = np.lexsort((col, -sim, row))
            row, col, sim = row[by], col[by], sim[by]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            cut[row[nth == k - 1]] = sim[nth == k - 1]
            row, col, sim = row[nth < k], col[nth < k], sim[nth < k]
        rows.append(a + row)
        cols.append(col)
        scores.append(sim)
    row, col, sim = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols, scores))
    return row, col, sim.astype(float)


def _keep_best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = found.sort_values(["query_id", "sim", "item_id"], ascending=[True, False, True])
    return ordered[ordered.groupby("query_id").cumcount() < k]


def _by_id(ids, rows: np.ndarray, k: int) -> tuple[list, np.ndarray]:
    """Ids and rows in the order of ids; of equal rows the first k, as no query can match more of them."""
    ids = np.asarray(ids, dtype=object)
    order = pd.Series(ids).sort_values(kind="stable").index.to_numpy()  # a null id stands last
    ids, rows = ids[order], np.ascontiguousarray(rows[order])
    if len(rows) > k and rows.shape[1]:
        same = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1]
        by = np.argsort(same, kind="stable")
        nth = np.empty(len(rows), dtype=np.int64)
        nth[by] = np.arange(len(rows)) - np.searchsorted(same[by], same[by])
        ids, rows = ids[nth < k], rows[nth < k]
    return list(ids), rows


def _fetched(df: DataFrame, dim: int) -> tuple[list, np.ndarray]:
    """The ids and unit rows of a side that has been counted."""
    found = df.select("id", F.col("vec").cast("array<double>").alias("vec")).toArrow()
    out, at = np.zeros((found.num_rows, dim)), 0
    for part in found.column("vec").chunks:
        sizes = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
        values = part.flatten().to_numpy(zero_copy_only=False)
        out[at: at + len(part)][sizes == dim] = values[np.repeat(sizes == dim, sizes)].reshape(-1, dim)
        at += len(part)
    return found.column("id").to_pylist(), _scaled(out)


def _fetch_small(df: DataFrame, dim: int) -> tuple[list, np.ndarray] | None:
    """The ids and unit rows when they fit the bound, else None."""
    return _fetched(df, dim) if df.count() <= max(1, MAX_BROADCAST_NUMBERS // dim) else None


def topk(
    queries: DataFrame, corpus: DataFrame, *, dim: int, k: int = fv.TOP_K,
    min_sim: float = fv.STORE_MIN_SIMILARITY, query_id: str = "query_id", item_id: str = "item_id",
    vec: str = "vec",
) -> DataFrame:
    """Exact top-k: (query_id, item_id, score, rank); ties go to the smaller id.

    A side of checked size is sent to the tasks of the other one, which stays
    where it is. When both sides are beyond the bound the smaller one is sent in
    chunks, one after the other; the larger one is read once a chunk and never
    shuffled or copied, and what a chunk finds is written before the next is fetched.
    """
    q = queries.select(F.col(query_id).cast("string").alias("id"), F.col(vec).alias("vec"))
    c = corpus.select(F.col(item_id).cast("string").alias("id"), F.col(vec).alias("vec"))
    for big, side, is_corpus in ((q, c, True), (c, q, False)):
        small = _fetch_small(side, dim)
        if small is not None:
            return rank_matches(_sweep(big, small, dim, k, min_sim, small_is_corpus=is_corpus)[0], k)
    n_q, n_c = q.count(), c.count()
    is_corpus = n_c <= n_q
    small, big, n = (c, q, n_c) if is_corpus else (q, c, n_q)
    # four fifths of the bound, as hashes do not part rows quite evenly
    n_chunks = -(-n * dim * 5 // (MAX_BROADCAST_NUMBERS * 4))
    spark, found = queries.sparkSession, None
    for i in range(n_chunks):
        chunk = _fetched(small.where(F.pmod(F.xxhash64("id"), F.lit(n_chunks)) == i), dim)
        part, shared = _sweep(big, chunk, dim, k, min_sim, small_is_corpus=is_corpus)
        part = written(part, new_dir(spark, "matches"))
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return rank_matches(found, k)


def rank_matches(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "item_id")
    return (
        found.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", "item_id", F.round("sim", 4).alias("score"), "rank")
    )


def _sweep(big: DataFrame, small: tuple[list, np.ndarray], dim, k, floor, small_is_corpus: bool):
    """The best rows that every task finds, and the broadcast it finds them with."""
    shared = big.sparkSession.sparkContext.broadcast(_by_id(*small, k) if small_is_corpus else small)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        light = matrix.astype(np.float32) if small_is_corpus else None
        best = pd.DataFrame({"query_id": [], "item_id": [], "sim": []})
        for batch in batches:
            if small_is_corpus:
                for at in range(0, len(batch), TILE_QUERIES):
                    part = batch[at: at + TILE_QUERIES]
                    yield _matches(_unit(list(part["vec"]), dim), list(part["id"]), matrix, ids, k, floor, light)
            else:  # one running result a task, at most k rows a query
                names, other = _by_id(batch["id"], _unit(list(batch["vec"]), dim), k)
                best = _keep_best(pd.concat([best, _matches(matrix, ids, other, names, k, floor)]), k)
        if not small_is_corpus:
            yield best

    return big.mapInPandas(score, MATCH_SCHEMA), shared


def topk_text(queries: DataFrame, corpus: DataFrame, *, query_text="text", item_vec="vec", **options) -> DataFrame:
    """Embed the query texts and retrieve."""
    qid = options.get("query_id", "query_id")
    q = embed(queries, id_col=qid, text_col=query_text).withColumnRenamed("embedding", options.get("vec", "vec"))
    if item_vec != options.get("vec", "vec"):
        corpus = corpus.withColumnRenamed(item_vec, options.get("vec", "vec"))
    return topk(q, corpus, dim=fv.EMBEDDING_DIM, **options)


def decode_embedding(df: DataFrame, *, json_col: str, out: str = "embedding") -> DataFrame:
    """JSON text to vector; rows that cannot be read are dropped."""
    return df.withColumn(out, F.from_json(F.col(json_col), "array<double>")).where(F.col(out).isNotNull())


def precedent_label(url: Column, fallback: Column) -> Column:
    return F.when(url.contains("/"), F.element_at(F.split(url, "/", -1), -1)).otherwise(fallback)


def elevated_rules(matches: DataFrame, *, category="bug_category", table=None) -> DataFrame:
    """(query_id, elevated_rules): rule ids of the matched categories, sorted.

    The lookup holds a handful of categories; the result list at most its rules.
    """
    rows = [(c, r) for c, rs in (fv.ELEVATED_RULES if table is None else table) for r in rs]
    lookup = matches.sparkSession.createDataFrame(rows, f"{category} string, rule_id string")
    return (
        matches.join(F.broadcast(lookup), category)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_set("rule_id")).alias("elevated_rules"))
    )


def evidence(findings: DataFrame, precedents: DataFrame, *, payload="payload_id", finding="finding_no") -> DataFrame:
    """First precedent by rank whose category equals the finding's or is part of its rule id.

    ``precedents`` holds the k matches of each payload, so a finding meets at most k rows.
    """
    cat, bug = F.col("category"), F.col("bug_category")
    pairs = findings.join(precedents, payload).where((bug == cat) | F.col("rule_id").contains(bug))
    fields = F.struct("item_id", "score", "bug_category", "rank")
    return pairs.groupBy(payload, finding).agg(F.min_by(fields, "rank").alias("_e")).select(
        payload, finding, "_e.item_id", "_e.bug_category", "_e.score", "_e.rank"
    )


def seed_incidents(spark: SparkSession) -> DataFrame:
    """The default incidents; the text to embed joins category and the three texts."""
    rows = [(f"INC-{i}", *r) for i, r in enumerate(fv.SEED_INCIDENTS, 1)]
    df = spark.createDataFrame(
        rows,
        "id string, pr_url string, bug_category string, description string, root_cause string, "
        "remediation string, fix_commit_sha string",
    )
    return df.withColumn(
        "full_text", F.concat_ws(" ", "bug_category", "description", "root_cause", "remediation")
    )


def session_query_text(repo: Column, sanitized: Column) -> Column:
    return F.concat(repo, F.lit(" "), F.substring(sanitized, 1, fv.SESSION_QUERY_CHARS))


def cache_report(payloads: DataFrame, *, id_col: str, hash_col: str, order: str) -> DataFrame:
    """Per payload hash the first review and how many later ones it answers."""
    return payloads.groupBy(hash_col).agg(
        F.min_by(id_col, order).alias("first_id"),
        F.count(F.lit(1)).alias("n_reviews"),
        (F.count(F.lit(1)) - 1).alias("cache_hits"),
    )
