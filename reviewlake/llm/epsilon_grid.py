"""Epsilon grid order join of vectors by cosine.

On unit vectors a cosine of at least c is a distance of at most epsilon =
sqrt(2 - 2c). Vectors are projected on their leading principal directions and
sorted by the grid cells (of width epsilon) they fall in: the epsilon grid order.
The sequence is cut into blocks; intervals of blocks, from the whole sequence
down to single blocks, are joined recursively, and a pair of intervals is skipped
when the boxes around their projections lie further apart than epsilon - a
projection never lengthens a distance, so nothing is lost. Block pairs that are
left are compared exactly in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.work import new_dir, written
from .components import components
from .running import running
from .shingles import labels_of

FAN = 3  # bits: an interval has eight children


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def principal(sample: list[list[float]], dims: int) -> dict[int, np.ndarray]:
    """For each length of vectors in the sample its leading principal directions."""
    out = {}
    for length in {len(v) for v in sample}:
        rows = unit(np.array([v for v in sample if len(v) == length]))
        _, axes = np.linalg.eigh(np.cov(rows.T, bias=True).reshape(length, length))
        out[length] = axes[:, ::-1][:, :dims]
    return out


def join(
    vectors: DataFrame,
    cosine: float = 0.98,
    dims: int = 6,
    block_rows: int = 512,
    sample_rows: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Links of vectors with equal labels and a cosine of at least ``cosine``.

    Returns id, n_links (other rows linked directly), component_id (smallest id
    reachable, itself included), kept (id = component_id), one row for each given
    row. Vectors that are null, empty, zero or hold a null or non-finite component,
    and rows without a label, link with nothing; vectors of different lengths do
    not either. Rows with equal vectors and labels count one by one but are compared
    once. The directions are fitted on about ``sample_rows`` rows; they decide how
    much is skipped, not what is found. A null id cannot be a component's name.
    Extra columns are left out; an empty table stays empty.
    """
    spark = vectors.sparkSession
    fresh = lambda df, name: written(df, new_dir(spark, name))
    v = F.col("vector")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & v.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.withColumns({
        "_ok": F.coalesce(usable, F.lit(False)),
        "_k1": F.xxhash64("vector"), "_k2": F.xxhash64(F.lit(1), F.reverse("vector")),
    })
    same = ["label", "_k1", "_k2"]
    classes = fresh(
        rows.where("_ok").groupBy(*same)
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
        .withColumns({"cls": F.monotonically_increasing_id(), "length": F.size("vector")}),
        "classes",
    )
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    # drawn by their hash; the limit only guards against equal hashes
    share = min(1.0, sample_rows / max(classes.count(), 1))
    drawn = classes.where(F.pmod(F.col("_k2"), F.lit(1 << 30)) < int(share * (1 << 30)))
    axes = principal([r[0] for r in drawn.limit(2 * sample_rows).select("vector").collect()], dims)
    # a length that the sample missed is projected on its first coordinates
    spots = _project(classes, axes, dims)
    cells = [F.floor(F.col("at")[i] / epsilon).alias(f"_c{i}") for i in range(dims)]
    spots = spots.select("label", "length", "cls", "at", *cells, F.lit(1).cast("bigint").alias("_one"))
    by = ["label", "length"]
    order = running(spots, by, [*[f"_c{i}" for i in range(dims)], "cls"], {"_pos": "_one"})
    placed = fresh(
        order.select(*by, "cls", "at", F.floor(F.col("_pos") / block_rows).cast("bigint").alias("block")), "placed"
    )
    pairs = _block_pairs(placed, by, dims, epsilon, fresh)
    packed = placed.join(classes.select("cls", "n", "vector"), "cls").groupBy(*by, "block").agg(
        F.collect_list(F.struct("cls", "n", "vector")).alias("rows")
    ).select(
        *by, "block", F.col("rows.cls").alias("cls"), F.col("rows.n").alias("n"), F.flatten("rows.vector").alias("values")
    )
    side = lambda name, p: packed.select(
        *by, F.col("block").alias(name), *[F.col(c).alias(f"{p}_{c}") for c in ("cls", "n", "values")]
    )
    both = pairs.join(side("x", "a"), [*by, "x"]).join(side("y", "b"), [*by, "y"])
    met = fresh(_compare(both, cosine), "met")

    comps = components(met.where("tied IS NOT NULL"), "cls", "tied")
    counts = met.groupBy("cls").agg(F.sum("links").alias("links"))
    tied = classes.select(*same, "rep", "n", "cls").join(counts, "cls", "left").join(
        comps.withColumnRenamed("node", "cls"), "cls", "left"
    ).withColumn("component", F.coalesce("component", "cls"))
    lowest = tied.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = tied.join(lowest, "component").select(
        *same, F.lit(True).alias("_ok"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )
    out = rows.select("id", *same, "_ok").join(of, [*same, "_ok"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )


def _project(classes: DataFrame, axes: dict[int, np.ndarray], dims: int) -> DataFrame:
    def project(batches):
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
            out = np.zeros((len(lengths), dims))
            for length in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == length)
                on = unit(values[starts[mine, None] + np.arange(length)])
                on = on @ axes.get(length, np.eye(length)[:, :dims])
                out[mine, : on.shape[1]] = on
            at = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dims), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("length"), batch.column("cls"), at],
                names=["label", "length", "cls", "at"],
            )

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "length", "cls", "vector").mapInArrow(
        project, f"label {kind}, length int, cls bigint, at array<double>"
    )


def _block_pairs(placed: DataFrame, by: list[str], dims: int, epsilon: float, fresh) -> DataFrame:
    """Pairs of blocks (x <= y) whose boxes are within epsilon, found from the root down."""
    boxes = fresh(
        placed.groupBy(*by, "block").agg(
            *[F.min(F.col("at")[i]).alias(f"lo{i}") for i in range(dims)],
            *[F.max(F.col("at")[i]).alias(f"hi{i}") for i in range(dims)],
        ),
        "boxes",
    )
    last = boxes.agg(F.max("block")).first()[0] or 0
    height = 0
    while last >> (FAN * height):
        height += 1
    pairs = boxes.select(*by, F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y")).distinct()
    for level in range(height - 1, -1, -1):
        own = boxes.withColumn("at", F.shiftright("block", FAN * level)).groupBy(*by, "at").agg(
            *[F.min(f"lo{i}").alias(f"lo{i}") for i in range(dims)],
            *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(dims)],
        )

        def child(name: str):
            return own.select(
                *by, F.shiftright("at", FAN).alias(name), F.col("at").alias(f"new_{name}"),
                *[F.col(f"{e}{i}").alias(f"{name}_{e}{i}") for e in ("lo", "hi") for i in range(dims)],
            )

        gap = lambda i: F.greatest(
            F.lit(0.0), F.col(f"x_lo{i}") - F.col(f"y_hi{i}"), F.col(f"y_lo{i}") - F.col(f"x_hi{i}")
        )
        apart = sum((gap(i) * gap(i) for i in range(1, dims)), gap(0) * gap(0))
        pairs = fresh(
            pairs.join(child("x"), [*by, "x"]).join(child("y"), [*by, "y"])
            .where((F.col("new_x") <= F.col("new_y")) & (apart <= epsilon * epsilon))
            .select(*by, F.col("new_x").alias("x"), F.col("new_y").alias("y")),
            "pairs",
        )
    return pairs


def _compare(pairs: DataFrame, cosine: float) -> DataFrame:
    """For each row of a block pair its links there, and the first row of its component there."""

    def compare(batches):
        for batch in batches:
            names = ("x", "y", "length", "a_cls", "a_n", "a_values", "b_cls", "b_n", "b_values")
            columns = {c: batch.column(c) for c in names}
            for i in range(batch.num_rows):
                take = lambda c: columns[c][i].values.to_numpy(zero_copy_only=False)
                length = columns["length"][i].as_py()
                a = unit(take("a_values").reshape(-1, length))
                a_cls, a_n = take("a_cls"), take("a_n")
                if columns["x"][i].as_py() == columns["y"][i].as_py():
                    cls, near = a_cls, a @ a.T >= cosine
                    np.fill_diagonal(near, False)
                    links = near @ a_n
                else:
                    b = unit(take("b_values").reshape(-1, length))
                    cross = a @ b.T >= cosine
                    cls = np.concatenate([a_cls, take("b_cls")])
                    links = np.concatenate([cross @ take("b_n"), cross.T @ a_n])
                    near = np.zeros((len(cls), len(cls)), dtype=bool)
                    near[: len(a), len(a):] = cross
                    near[len(a):, : len(a)] = cross.T
                rows = np.flatnonzero(links > 0)
                if not len(rows):
                    continue
                label = labels_of(near[np.ix_(rows, rows)])
                tied = cls[rows][label]
                alone = label == np.arange(len(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls[rows]), pa.array(links[rows].astype(np.int64)), pa.array(tied, mask=alone)],
                    names=["cls", "links", "tied"],
                )

    return pairs.mapInArrow(compare, "cls bigint, links bigint, tied bigint")
