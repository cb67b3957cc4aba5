"""Scores and developer growth on example rows."""

import datetime as dt

from pyspark.sql import functions as F

from reviewlake.operators import growth, scoring


def test_scores(spark):
    payloads = spark.createDataFrame([(i,) for i in range(5)], "payload_id long")
    rows = [(1, "CRITICAL"), *[(2, "critical")] * 5, (3, "HIGH"), (3, "MEDIUM"), (3, "LOW"), (4, None)]
    findings = spark.createDataFrame(rows, "payload_id long, severity string")
    got = {r["payload_id"]: (r["score"], r["grade"]) for r in scoring.rate(payloads, findings).collect()}
    assert got == {0: (10.0, "A+"), 1: (7.5, "B"), 2: (1.0, "F"), 3: (7.4, "C"), 4: (9.7, "A")}


def test_ranks(spark):
    names = ["CRITICAL", "high", "MEDIUM", "LOW", "AUDIT_NOTE", "?"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r[0] for r in df.select(scoring.severity_rank(F.col("s"))).collect()] == [4, 3, 2, 1, 0, 2]


def _sessions(spark, rows):
    base = dt.datetime(2024, 1, 1)
    data = [(i, "p", u, a, s, lang, base + dt.timedelta(hours=n), 1) for n, (i, u, a, s, lang) in enumerate(rows)]
    return spark.createDataFrame(
        data,
        "id string, pr_id string, user_id string, author_id string, quality_score double, language string, "
        "created_at timestamp, findings_count int",
    )


def test_growth(spark):
    s = _sessions(spark, [
        ("a", "u", "u", 4.5, "python"), ("b", "u", "x", 7.8, None), ("c", "y", "u", 9.5, "go"),
        ("d", "z", "z", 0.0, "go"), ("e", "z", "q", None, "go"),
    ])
    got = {r["user_id"]: r for r in growth.growth(s).collect()}
    u = got["u"]
    assert (u["total_reviews"], u["average_score"], u["initial_score"], u["latest_score"], u["improvement_delta"]) == (
        3, 7.3, 4.5, 9.5, 5.0)
    assert u["verdict"] == "Tracked 3 reviews. Trajectory delta: +5.0 points."
    assert (got["z"]["total_reviews"], got["z"]["average_score"]) == (2, 10.0)
    asked = spark.createDataFrame([("u",), ("nobody",)], "user_id string")
    new = {r["user_id"]: r for r in growth.growth_for(asked, s).collect()}["nobody"]
    assert (new["total_reviews"], new["average_score"], new["improvement_delta"]) == (0, 10.0, 0.0)
    langs = {r["user"]: r["language_distribution"] for r in growth.language_map(s).collect()}
    assert langs["u"] == {"python": 2, "go": 1}


def test_rolling_and_positions_of_a_hot_user(spark):
    n = 3000
    rows = [(f"s{i:05d}", "hot" if i % 3 else f"u{i % 50}", None, 1.0 + i % 90 / 10, "go") for i in range(n)]
    s = _sessions(spark, rows)
    want = {}
    for i, r in enumerate(rows):
        want.setdefault(r[1], []).append((r[0], round(r[3] * 10)))
    got = {(r["user"], r["seq"]): r for r in growth.rolling(s, 4).collect()}
    assert len(got) == n
    for user, items in want.items():
        for k, (sid, _) in enumerate(items, 1):
            part = [t for _, t in items[max(0, k - 4):k]]
            r = got[user, k]
            assert r["id"] == sid
            assert r["rolling_score"] == (2 * sum(part) + len(part)) // (2 * len(part)) / 10


def test_exact_median(spark):
    import random
    import statistics

    rng = random.Random(3)
    for values in ([5.0], [1.0, 2.0], [7.0] * 9, [rng.lognormvariate(3, 3) for _ in range(5000)], [0.0, 1e-9, 2e-9, 1e12, 3e12] * 3):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        assert growth.median(df, "v") == statistics.median(values)
    assert growth.median(spark.createDataFrame([], "v double"), "v") is None
