"""Chosen-path set similarity join over word shingles.

Documents with one set are one class; classes get a signature of minwise tokens.
In each of several independent trees a node sends every member on to the branches
named by its tokens at a few positions that the node selects, so that similar
members meet again in most branches. A node of at most ``limit`` members is
compared exhaustively, by signatures first; larger nodes branch on. With b
branches and similarity s, a tree keeps a pair with the probability f that solves
f = 1 - (1 - s f)^b at any depth: 0.991 for 0.8 and three branches, and three
trees miss less than one such pair in a million.

What a node's signatures suggest is a candidate group. Equal groups of different
nodes are one. Their full shingle sets are read again from the texts and compared
exactly; a group yields a link of each member to the first of its component, so
the links grow with the members, not with the pairs.

Texts that merely share a passage part soon: their nodes shrink at every level. A
large node that keeps more than half of its parent holds many alike texts, which
branching would only repeat. Once the other nodes are done, its members that are
not yet in the node's main component are compared with all others, in blocks, so
no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.work import new_dir, written
from .base import small_side, utf8
from .components import components
from .shingles import digest, groups_of, labels_of, mix, shingle_set, signature

SIZE = 64


def _children(start: np.ndarray, tokens: np.ndarray, branches: int) -> np.ndarray:
    """For each row the nodes its branches lead to: positions are the node's, tokens the row's."""
    first, out = mix(start), []
    for b in range(branches):
        # an odd stride visits different positions
        at = (first + np.uint64(b) * (first >> np.uint64(32) | np.uint64(1))) % np.uint64(SIZE)
        token = tokens[np.arange(len(tokens)), at.astype(np.int64)].astype(np.uint64)
        out.append(mix(mix(start ^ (at << np.uint64(40))) + token))
    return np.stack(out, axis=1).view(np.int64)


def _sets(docs: DataFrame, k: int, trees: int, branches: int, id_col: str, text_col: str) -> DataFrame:
    """Size, digest, first nodes of all trees, and the last byte of each minwise token, of every text's set."""

    def read(batches):
        for batch in batches:
            n, names, roots, signs = [], [], [], []
            for text in batch.column("text").to_pylist():
                values = shingle_set(text, k)
                n.append(len(values))
                names.append(digest(values))
                sign = signature(values, SIZE)[None, :]
                signs.append((sign[0] & 0xFF).astype(np.uint8).tobytes())
                roots.append(np.concatenate([_children(np.array([t + 1], dtype=np.uint64), sign, branches)[0] for t in range(trees)]))
            flat = np.concatenate(roots) if roots else np.zeros(0, dtype=np.int64)
            ends = pa.array(np.arange(0, len(flat) + 1, trees * branches), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.binary()),
                 pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(signs, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "roots", "signature"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"doc_id {kind}, n_shingles bigint, digest binary, roots array<bigint>, signature binary")


def _branch(rows: DataFrame, branches: int) -> DataFrame:
    """Send every member of a node on to its branches; ``parent`` is the size of the node it comes from."""

    def send(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sign = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint8).reshape(-1, SIZE)
            nodes = _children(batch.column("node").to_numpy().view(np.uint64), sign, branches)
            again = np.repeat(np.arange(batch.num_rows), branches)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes.ravel()), batch.column("rec").take(again), batch.column("n").take(again)],
                names=["node", "rec", "parent"],
            )

    return rows.select("node", "rec", "n", "signature").mapInArrow(send, "node bigint, rec bigint, parent bigint")


def _compare(rows: DataFrame, enough: int) -> DataFrame:
    """Candidate groups (grp, rec) inside each node, by signatures."""

    def look(batches):
        recs, groups = [], []
        for part in groups_of(batches, "node"):
            if part.num_rows < 2:
                continue
            sign = np.frombuffer(b"".join(part.column("signature").to_pylist()), dtype=np.uint8).reshape(-1, SIZE)
            rec = part.column("rec").to_numpy()
            if len(rec) == 2:
                label = np.zeros(2, dtype=int) if (sign[0] == sign[1]).sum() >= enough else np.arange(2)
            else:
                same = np.zeros((len(rec), len(rec)), dtype=np.uint8)
                for column in np.ascontiguousarray(sign.T):
                    same += column[:, None] == column[None, :]
                label = labels_of(same >= enough)
            for first in np.flatnonzero(np.bincount(label, minlength=len(rec)) > 1):
                members = rec[label == first]
                name = mix(mix(members.view(np.uint64)).sum(dtype=np.uint64) + np.uint64(len(members)))
                groups.append(np.full(len(members), name))
                recs.append(members)
            if sum(map(len, recs)) > 50_000:
                yield _pairs(groups, recs)
                recs, groups = [], []
        if recs:
            yield _pairs(groups, recs)

    def _pairs(groups, recs):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(groups).view(np.int64)), pa.array(np.concatenate(recs))], names=["grp", "rec"]
        )

    together = rows.select("node", "rec", "signature").repartition("node").sortWithinPartitions("node")
    return together.mapInArrow(look, "grp bigint, rec bigint")


def _verify(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside each group, by full sets: a member and the first of its component."""

    def check(batches):
        left, right = [], []
        for part in groups_of(batches, "grp"):
            # rows that repeat an id may bring a set more than once
            rec, once = np.unique(part.column("rec").to_numpy(), return_index=True)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in part.column("values").take(pa.array(once)).to_pylist()]
            m = len(sets)
            sizes = np.array([len(s) for s in sets])
            if m < 2:
                continue
            near = np.zeros((m, m), dtype=bool)
            everything, at = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            flag = np.zeros(len(everything), dtype=np.int64)
            for i in range(m):
                own = at[starts[i]: starts[i] + sizes[i]]
                flag[own] = 1
                both = np.add.reduceat(flag[at], starts)
                flag[own] = 0
                near[i] = 100 * both >= percent * (sizes[i] + sizes - both)
            label = labels_of(near)
            tied = label != np.arange(m)
            left.append(rec[label[tied]])
            right.append(rec[tied])
            if len(left) > 1000:
                yield _links(left, right)
                left, right = [], []
        if left:
            yield _links(left, right)

    def _links(left, right):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"]
        )

    together = rows.select("grp", "rec", "values").repartition("grp").sortWithinPartitions("grp")
    return together.mapInArrow(check, "a bigint, b bigint")


def join(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    trees: int = 3,
    branches: int = 3,
    limit: int = 4096,
    levels: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Components of documents whose shingle sets are at least ``percent`` similar (Jaccard).

    Returns doc_id, n_shingles, component_id (smallest id reachable by links, itself
    included), kept (doc_id = component_id), one row for each given row. A text that
    is null or has no words has the empty set and links with nothing; equal texts
    always link. Rows that repeat an id are one document as far as their sets are equal;
    where an id has several sets, each row has the component of its own set. A null id is
    in no component but that of its copies. Extra columns are left out; an empty table
    stays empty.
    """
    spark = docs.sparkSession
    fresh = lambda df, name: written(df, new_dir(spark, name))
    read = fresh(_sets(docs, k, trees, branches, id_col, text_col), "sets")
    classes = fresh(
        read.where("digest IS NOT NULL").groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("roots").alias("roots"), F.first("signature").alias("signature"))
        .withColumn("rec", F.monotonically_increasing_id()),
        "classes",
    )
    signs = classes.select("rec", "signature")
    # the similarity less four standard deviations of its estimate
    s = percent / 100
    enough = int(np.floor(SIZE * (s - 4 * np.sqrt(s * (1 - s) / SIZE)) - 1))

    nodes = classes.select(F.explode("roots").alias("node"), "rec", F.lit(None).cast("bigint").alias("parent"))
    groups, alike = None, None
    for level in range(levels):
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("parent").alias("parent")).where("n > 1")
        met = fresh(nodes.select("node", "rec").join(sizes, "node").join(signs, "rec"), "met")
        here = _compare(met.where(F.col("n") <= limit), enough)
        groups = here if groups is None else groups.union(here)
        large = met.where(F.col("n") > limit)
        if level < levels - 1:
            stuck = F.col("parent").isNotNull() & (2 * F.col("n") > F.col("parent"))
        else:
            stuck = F.lit(True)
        alike = large.where(stuck) if alike is None else alike.union(large.where(stuck))
        large = large.where(~stuck)
        if large.isEmpty():
            break
        nodes = fresh(_branch(large, branches), "nodes")
    links = _exact(docs, fresh(groups.distinct(), "groups"), classes, k, percent, id_col, text_col)
    if not alike.isEmpty():
        more = _compare(_blocks(alike, links, limit // 2), enough).distinct()
        links = links.union(_exact(docs, fresh(more, "groups"), classes, k, percent, id_col, text_col))

    tied = classes.join(components(links), F.col("rec") == F.col("node"), "left")
    tied = tied.select("digest", "rep", F.coalesce("component", "rec").alias("component"))
    lowest = tied.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = tied.join(lowest, "component").select("digest", "component_id")
    out = read.select("doc_id", "n_shingles", "digest").join(of, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def _blocks(large: DataFrame, links: DataFrame, size: int) -> DataFrame:
    """Blocks of the members outside a node's main component, each with blocks of all members."""
    tied = large.join(components(links).withColumnRenamed("node", "rec"), "rec", "left")
    tied = tied.withColumn("component", F.coalesce("component", "rec"))
    each = tied.groupBy("node", "component").agg(F.count(F.lit(1)).alias("c"))
    main = each.groupBy("node").agg(
        F.max_by("component", F.struct("c", "component")).alias("main"),
        (F.sum("c") - F.max("c")).alias("others"),
    )
    rows = tied.join(main.where("others > 0"), "node")
    all_blocks = F.ceil(F.col("n") / size).cast("int")
    some_blocks = F.ceil(F.col("others") / size).cast("int")
    own = lambda blocks: F.pmod(F.xxhash64("rec"), blocks).cast("int")
    every = rows.select(
        "node", "rec", "signature", own(all_blocks).alias("i"),
        F.explode(F.sequence(F.lit(0), some_blocks - 1)).alias("j"),
    )
    some = rows.where("component <> main").select(
        "node", "rec", "signature", F.explode(F.sequence(F.lit(0), all_blocks - 1)).alias("i"),
        own(some_blocks).alias("j"),
    )
    both = every.union(some).select(F.xxhash64("node", "i", "j").alias("node"), "rec", "signature")
    return both.dropDuplicates(["node", "rec"])


def _exact(docs, groups, classes, k, percent, id_col, text_col) -> DataFrame:
    """Links of the candidate groups, by the sets of the texts themselves."""
    spark = docs.sparkSession
    wanted = groups.select("rec").distinct().join(classes.select("rec", "rep", "digest"), "rec")
    wanted = written(wanted, new_dir(spark, "wanted"))
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    ids = small_side(wanted.select("rep").distinct())
    rows = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")

    def read(batches):
        for batch in batches:
            sets = [shingle_set(t, k) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["digest", "values"],
            )

    sets = rows.mapInArrow(read, "digest binary, values binary")
    members = groups.join(wanted.select("digest", "rec"), "rec")
    return written(_verify(members.join(sets, "digest"), percent), new_dir(spark, "links"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, null ids last.

    Rows are told apart by a tag of their own, so ids may repeat or be null. Of rows
    with the same smallest id the first one stays. A text that is null or has no word
    resembles nothing and stays; very long texts are compared whole. All columns come
    back, whatever their names; an empty table stays empty.
    """
    spark = docs.sparkSession
    # the given columns stay packed, so none of their names can clash
    tagged = written(docs.select(F.struct("*").alias("given"), F.monotonically_increasing_id().alias("_row")), new_dir(spark, "tagged"))
    found = join(tagged, k, percent, id_col="_row", text_col=f"given.`{text_col}`")
    tied = found.where(~F.col("kept")).select(F.col("doc_id").alias("_row"), "component_id")
    tied = written(tied, new_dir(spark, "tied"))
    # the first row of a component is the one that is kept so far
    tied = tied.union(tied.select(F.col("component_id").alias("_row"), "component_id").distinct())
    own = F.col(f"given.`{id_col}`")
    ids = tagged.select("_row", F.struct(own.isNull().alias("none"), own.alias("id"), F.col("_row")).alias("_place"))
    tied = written(tied.join(ids, "_row"), new_dir(spark, "tied"))
    best = tied.groupBy("component_id").agg(F.min("_place").alias("_best"))
    gone = tied.join(best, "component_id").where("_place <> _best").select("_row")
    gone = written(gone, new_dir(spark, "gone"))
    return tagged.join(small_side(gone), "_row", "left_anti").select("given.*")
