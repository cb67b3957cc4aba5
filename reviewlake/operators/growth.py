"""Developer progress over review sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..plans.ordered import positions
from ..plans.work import stable

# Scores are summed in tenths, so averages are exact until they are rounded.


def score_tenths(score: Column) -> Column:
    """NULL and 0 count as the full score."""
    value = F.coalesce(score, F.lit(0.0))
    return F.round(F.when(value == 0, fv.DEFAULT_SCORE).otherwise(value) * 10).cast("bigint")


def user_sessions(sessions: DataFrame) -> DataFrame:
    """One row per user and session, where the user is its user or its author."""
    base = sessions.withColumn("_t", score_tenths(F.col("quality_score"))).withColumn(
        "language", F.coalesce("language", F.lit(fv.DEFAULT_LANGUAGE))
    )
    both = F.array_distinct(F.array_compact(F.array("user_id", "author_id")))
    return base.withColumn("user", F.explode(both))


def tenth_rounded(total: Column, n: Column) -> Column:
    """total / n to one decimal, halves away from zero (both in tenths)."""
    return F.floor((total * 2 + n) / (n * 2)).cast("double") / 10


def growth(sessions: DataFrame) -> DataFrame:
    """Count, average, first, last and delta per user."""
    at = F.struct("created_at", "id")
    agg = user_sessions(sessions).groupBy("user").agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.sum("_t").alias("_sum"),
        F.min_by("_t", at).alias("_first"),
        F.max_by("_t", at).alias("_last"),
    )
    delta = (F.col("_last") - F.col("_first")).cast("double") / 10
    return agg.select(
        F.col("user").alias("user_id"),
        "total_reviews",
        tenth_rounded(F.col("_sum"), F.col("total_reviews")).alias("average_score"),
        (F.col("_first") / 10).cast("double").alias("initial_score"),
        (F.col("_last") / 10).cast("double").alias("latest_score"),
        delta.alias("improvement_delta"),
        F.format_string("Tracked %d reviews. Trajectory delta: %+.1f points.", "total_reviews", delta).alias("verdict"),
    )


def improvement(sessions: DataFrame) -> DataFrame:
    """Percent by which each user's latest score is above the first one (scores are at least 0.1)."""
    pct = F.col("improvement_delta") * 100 / F.greatest(F.col("initial_score"), F.lit(0.1))
    return growth(sessions).select("user_id", "initial_score", "latest_score", F.round(pct, 2).alias("improvement_pct"))


def growth_for(users: DataFrame, sessions: DataFrame) -> DataFrame:
    """Growth of the requested users; a user without sessions gets the default row."""
    return users.join(growth(sessions), "user_id", "left").select(
        "user_id",
        F.coalesce("total_reviews", F.lit(0).cast("bigint")).alias("total_reviews"),
        F.coalesce("average_score", F.lit(fv.DEFAULT_SCORE)).alias("average_score"),
        F.coalesce("improvement_delta", F.lit(0.0)).alias("improvement_delta"),
        F.coalesce("verdict", F.lit(fv.NEW_USER_VERDICT)).alias("verdict"),
    )


def trajectory(sessions: DataFrame) -> DataFrame:
    """Every session of a user with its place in time, first session = 1."""
    rows = user_sessions(sessions).select(
        "user", "created_at", "id", "pr_id", (F.col("_t") / 10).cast("double").alias("quality_score"),
        "findings_count", "language",
    )
    return positions(rows, ["user"], ["created_at", "id"])


def language_distribution(sessions: DataFrame) -> DataFrame:
    return user_sessions(sessions).groupBy("user", "language").agg(F.count(F.lit(1)).alias("n"))


def language_map(sessions: DataFrame) -> DataFrame:
    """user -> map of language to count; a user has as many entries as languages."""
    return language_distribution(sessions).groupBy("user").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("language_distribution")
    )


def recent(sessions: DataFrame, k: int = fv.RECENT_SESSIONS) -> DataFrame:
    """The last ``k`` sessions of a user, newest first.

    The rank filter lets Spark keep k rows per user in each task before the shuffle.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("user").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return user_sessions(sessions).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rolling(sessions: DataFrame, width: int = 5) -> DataFrame:
    """Average over a session and the ``width`` - 1 before it, and the change to the last one.

    Each numbered session is sent to the windows it belongs to, so the grouping
    key is (user, place) and never a whole user.
    """
    rows = trajectory(sessions).withColumn("_t", F.round(F.col("quality_score") * 10).cast("bigint"))
    sent = rows.withColumn("_ahead", F.explode(F.array(*[F.lit(i) for i in range(width)])))
    own = F.col("_ahead") == 0
    return (
        sent.groupBy("user", (F.col("seq") + F.col("_ahead")).alias("seq"))
        .agg(
            F.max(F.when(own, F.col("id"))).alias("id"),
            F.sum("_t").alias("_sum"),
            F.count(F.lit(1)).alias("_n"),
            F.max(F.when(own, F.col("_t"))).alias("_now"),
            F.max(F.when(F.col("_ahead") == 1, F.col("_t"))).alias("_prev"),
        )
        .where(F.col("id").isNotNull())
        .select(
            "user", "seq", "id",
            tenth_rounded(F.col("_sum"), F.col("_n")).alias("rolling_score"),
            ((F.col("_now") - F.col("_prev")) / 10).cast("double").alias("change"),
        )
    )


def defect_frequency(findings: DataFrame, *, user="user_id") -> DataFrame:
    return findings.groupBy(user, "category").agg(F.count(F.lit(1)).alias("n"))


def kpis(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Measured duration and revert rate next to the pilot targets."""
    both = sessions.select(F.lit(True).alias("_s"), "execution_duration_ms").unionByName(
        events.select(F.lit(False).alias("_s"), "event_type"), allowMissingColumns=True
    )
    reverts = F.count_if(F.col("event_type") == "POST_DEPLOY_REVERT")
    one = both.agg(
        F.count_if("_s").alias("n_sessions"),
        F.lit(median(sessions, "execution_duration_ms")).cast("double").alias("median_duration_ms"),
        F.round(reverts * 100.0 / F.count_if(~F.col("_s")), 4).alias("revert_rate_pct"),
    )
    return one.select("*", *[F.lit(v).alias(k) for k, v in fv.PILOT_TARGETS.items()])


MEDIAN_BINS = 1024


def median(df: DataFrame, column: str) -> float | None:
    """Exact median of a numeric column: the middle value, or the mean of the two middle ones.

    Values are counted first, which combines map-side. Each round then counts the
    values into bins of one width and goes on with the bin that holds the wanted
    place, so no task meets all values and the driver sees one row a bin.
    """
    value = F.col(column).cast("double")
    counted = df.where(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counted = stable(counted)
    total = counted.agg(F.sum("n")).first()[0]
    if not total:
        return None
    low, high = (_at_place(counted, place) for place in ((total + 1) // 2, total // 2 + 1))
    return (low + high) / 2


def _at_place(counted: DataFrame, place: int) -> float:
    """The value at a place, from 1, in the order of all values."""
    while True:
        low, high = counted.agg(F.min("v"), F.max("v")).first()
        if low == high:
            return low
        width = (high - low) / MEDIAN_BINS
        # bins are told apart by their least value, so one of a single value ends the search
        at = F.least(F.floor((F.col("v") - low) / width), F.lit(MEDIAN_BINS - 1))
        bins = counted.groupBy(at.alias("b")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for b in bins.orderBy("b").collect():
            if place <= b["n"]:
                break
            place -= b["n"]
        if b["lo"] == b["hi"]:
            return b["lo"]
        counted = counted.where(F.col("v").between(b["lo"], b["hi"]))
