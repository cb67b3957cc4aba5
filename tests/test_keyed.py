"""Tables in folders by key: what a lookup opens, and what an upsert leaves alone."""

import os

import pytest
from pyspark.sql import functions as F

from reviewlake.sources import keyed, tables


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows_of(spark, n, name="old"):
    return spark.range(n).select(
        F.concat(F.lit("K"), F.col("id").cast("string")).alias("id"), F.lit(name).alias("description"), F.col("id").alias("embedding"), F.lit("c").alias("cause")
    )


def test_a_lookup_opens_few_files(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(rows_of(spark, 5000), path, "id", folders=32)
    wanted = {"K7", "K4999", "none"}
    folders = {r[0] for r in spark.createDataFrame([(w,) for w in wanted], "id string").select(keyed._folder(F.col("id"), 32)).collect()}
    for name in files_of(path):  # the values of all other folders become unreadable; the ends of their files stay
        if int(name.split("folder=")[1].split("/")[0]) not in folders:
            with open(name, "r+b") as f:
                f.seek(4)
                f.write(b"\xff" * 300)
    found = keyed.lookup(spark, path, "id", sorted(wanted), folders=32)
    assert {r.id for r in found.collect()} == {"K7", "K4999"}
    assert "PushedFilters: [In(id" in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception):
        keyed.stored(spark, path).select("id").collect()


def test_an_upsert_rewrites_touched_folders_only(spark, tmp_path):
    path = str(tmp_path / "t")
    target = rows_of(spark, 3000)
    keyed.create(target, path, "id", folders=32)
    before = files_of(path)
    updates = spark.createDataFrame([("K5", "new", 1, 1), ("K5", "newer", 2, 2), ("X1", "added", 3, 3)], "id string, description string, embedding bigint, n int").withColumn("cause", F.lit("z"))
    touched = keyed.upsert_stored(updates, path, "id", ["description", "embedding"], order="n", folders=32)
    assert len(touched) == 2
    after = files_of(path)
    kept = {f for f in before if after.get(f) == before[f]}
    assert {int(f.split("folder=")[1].split("/")[0]) for f in set(before) - kept} == set(touched)
    want = {tuple(r) for r in tables.upsert_incidents(target, updates, order="n").select("id", "description", "embedding", "cause").collect()}
    get = lambda: [tuple(r) for r in keyed.stored(spark, path).select("id", "description", "embedding", "cause").collect()]
    assert len(get()) == 3001 and set(get()) == want
    keyed.upsert_stored(updates, path, "id", ["description", "embedding"], order="n", folders=32)
    assert len(get()) == 3001 and set(get()) == want
    assert keyed.upsert_stored(updates.limit(0), path, "id", ["description"], order="n", folders=32) == []
    with pytest.raises(ValueError):
        keyed.upsert_stored(updates.withColumn("id", F.lit(None).cast("string")), path, "id", ["description"], order="n", folders=32)
    assert set(get()) == want
