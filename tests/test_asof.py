"""As-of join against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import asof

L, R = "rule string, t bigint, name string, _pos int", "rule string, at bigint, seq int, w double, note string"


def plain(left, right):
    out = []
    for rule, t, name, x in left:
        fits = [r for r in right if rule is not None and t is not None and r[0] == rule and r[1] is not None and r[1] <= t]
        best = max(fits, key=lambda r: (r[1], -1 if r[2] is None else r[2]), default=None)
        out.append((rule, t, name, x, *(best[3:] if best else (None, None))))
    return out


def run(spark, left, right, parts=7):
    a, b = spark.createDataFrame(left, L).repartition(parts), spark.createDataFrame(right, R).repartition(3)
    got = asof.asof_join(a, b, ["rule"], left_time="t", right_time="at", values=["w", "note"], order=["seq"])
    assert got.columns == ["rule", "t", "name", "_pos", "w", "note"]
    return [tuple(r) for r in got.collect()]


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_equals_a_plain_loop(spark, monkeypatch, bits):
    monkeypatch.setattr(asof, "BITS", bits)
    rng = random.Random(bits)
    rules = ["hot"] * 6 + ["a", "b", "c", None]
    left = [(rng.choice(rules), rng.choice([None, *range(-3, 60)]), f"n{i}", i % 3) for i in range(400)]
    left += [("hot", 30, "same", 1)] * 200 + [("never", 5, "x", 1)]
    right = [(rng.choice(rules), rng.choice([None, *range(60)]), i, float(i), None if i % 5 else "s") for i in range(150)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(run(spark, left, right), key=key) == sorted(plain(left, right), key=key)


def test_empty_sides(spark):
    left = [("a", 1, "n", 1)]
    assert run(spark, left, []) == [("a", 1, "n", 1, None, None)]
    assert run(spark, [], [("a", 1, 1, 1.0, "x")]) == []


def test_hot_key_spreads(spark):
    n = 60_000
    left = spark.range(n).select(F.lit("hot").alias("rule"), F.col("id").alias("t"), F.lit("n").alias("name"), F.lit(1).alias("_pos"))
    right = spark.range(n // 2).select(
        F.lit("hot").alias("rule"), (F.col("id") * 2).alias("at"), F.lit(1).alias("seq"), F.col("id").cast("double").alias("w"), F.lit("x").alias("note")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = asof.asof_join(left, right, ["rule"], left_time="t", right_time="at", values=["w"], order=["seq"])
        assert got.where(F.col("w") != F.floor(F.col("t") / 2)).count() == 0
        sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == n and max(sizes) < n / 2
