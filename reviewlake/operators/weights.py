"""Feedback events and the rule weights they move.

A step adds a delta and clamps to [low, high]. Such a step is the map
``w -> min(hi, max(lo, w + shift))``, and two of these maps in a row are again
one, so the fold is associative: blocks of events become one map each, in
parallel, and a rule with a third of all events still spreads over all tasks.
Weights are counted in ten-thousandths, which makes every step exact.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..plans.ordered import block, number_rows, positions
from ..plans.work import stable
from .asof import asof_join

UNIT = 10_000
WIDE = 1 << 40


def deltas(alpha: float = fv.LEARNING_RATE) -> dict[str, int]:
    """Event type -> delta in units; the rate has to fall on the unit grid."""
    out = {}
    for kind, factor in fv.EVENT_FACTORS.items():
        exact = Decimal(str(alpha)) * Decimal(str(factor)) * UNIT
        if exact != exact.to_integral_value():
            raise ValueError(f"learning rate {alpha} gives steps finer than 1/{UNIT}")
        out[kind] = int(exact)
    return out


def delta_units(event_type: Column, alpha: float = fv.LEARNING_RATE) -> Column:
    chain = None
    for kind, units in deltas(alpha).items():
        step = F.lit(units).cast("bigint")
        chain = F.when(event_type == kind, step) if chain is None else chain.when(event_type == kind, step)
    return chain.otherwise(F.lit(0).cast("bigint"))


def to_units(weight: Column) -> Column:
    return F.round(weight * UNIT).cast("bigint")


def from_units(units: Column) -> Column:
    return units.cast("double") / UNIT


def _bounds(low, high):
    return int(Decimal(str(low)) * UNIT), int(Decimal(str(high)) * UNIT)


def clamp(value: Column, low, high) -> Column:
    low, high = (F.lit(x).cast("bigint") if isinstance(x, int) else x for x in (low, high))
    return F.least(high, F.greatest(low, value))


def apply_map(weight: Column, m: Column) -> Column:
    return clamp(weight + m["shift"], m["lo"], m["hi"])


def then(first: Column, second: Column) -> Column:
    """The map that does ``first`` and then ``second``."""
    return F.struct(
        (first["shift"] + second["shift"]).alias("shift"),
        apply_map(first["lo"], second).alias("lo"),
        apply_map(first["hi"], second).alias("hi"),
    )


def identity_map() -> Column:
    return F.struct(
        F.lit(0).cast("bigint").alias("shift"),
        F.lit(-WIDE).cast("bigint").alias("lo"),
        F.lit(WIDE).cast("bigint").alias("hi"),
    )


def event_deltas(events: DataFrame, *, alpha=fv.LEARNING_RATE) -> DataFrame:
    return events.withColumn("delta", from_units(delta_units(F.col("event_type"), alpha)))


# Blocks of 256 events, of 256 blocks, and of 256 of these.
BITS = 8
LEVELS = 3


def _blocks(events, alpha, low, high, order, carried=()):
    """One row per rule and block of events: ``_rows`` in order and their map."""
    low, high = (F.lit(x).cast("bigint") for x in _bounds(low, high))
    slim = events.select("rule_id", *order, *carried, delta_units(F.col("event_type"), alpha).alias("_d"))
    levels = [block(BITS * i).alias(f"_b{i}") for i in range(LEVELS, 0, -1)]

    def step(acc, x):
        return then(acc, F.struct(x["_d"].alias("shift"), low.alias("lo"), high.alias("hi")))

    kept = ["_pos", "_d", *([*order, *carried] if carried else [])]
    return (
        number_rows(slim, ["rule_id"], [*order, "_d"])
        .groupBy("rule_id", *levels)
        .agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("_rows"))
        .withColumn("_map", F.aggregate("_rows", identity_map(), step))
    )


def _levels(blocks: DataFrame) -> list[DataFrame]:
    """Maps of ever larger blocks; the last has one row per rule."""
    out = []
    below = blocks
    for i in range(1, LEVELS + 1):
        keys = ["rule_id", *[f"_b{j}" for j in range(LEVELS, i, -1)]]
        below = (
            below.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(f"_b{i}", "_map"))).alias("_maps"))
            .withColumn("_map", F.aggregate("_maps", identity_map(), lambda a, x: then(a, x["_map"])))
        )
        out.append(below)
    return out


def fold_maps(
    events: DataFrame, *, alpha=fv.LEARNING_RATE, low=fv.MIN_WEIGHT, high=fv.MAX_WEIGHT,
    order=("ts", "id"),
) -> DataFrame:
    """(rule_id, _map): what all events of a rule, in order, do to its weight."""
    blocks = _blocks(events, alpha, low, high, list(order))
    return _levels(blocks)[-1].select("rule_id", "_map")


def fold_weights(events: DataFrame, rules: DataFrame, *, alpha=fv.LEARNING_RATE, order=("ts", "id")) -> DataFrame:
    """New ``current_weight`` of every rule; rules without events keep theirs."""
    maps = fold_maps(events, alpha=alpha, order=order)
    start = to_units(F.col("current_weight"))
    return (
        rules.join(maps, "rule_id", "left")
        .withColumn("previous_weight", F.col("current_weight"))
        .withColumn(
            "current_weight",
            F.when(F.col("_map").isNull(), F.col("current_weight")).otherwise(
                from_units(apply_map(start, F.col("_map")))
            ),
        )
        .drop("_map")
    )


def weight_history(events: DataFrame, rules: DataFrame, *, alpha=fv.LEARNING_RATE, order=("ts", "id")) -> DataFrame:
    """One audit row per event of a known rule: weights before and after, delta.

    The blocks are written once; start weights run down from the rules to the
    super-blocks, the blocks and the events, in lists of bounded length.
    """
    order = list(order)
    carried = ["event_type", "repo_name", "commit_sha"]
    low, high = _bounds(fv.MIN_WEIGHT, fv.MAX_WEIGHT)
    blocks = stable(_blocks(events, alpha, fv.MIN_WEIGHT, fv.MAX_WEIGHT, order, carried))
    at = rules.select("rule_id", to_units(F.col("current_weight")).alias("_w"))
    levels = _levels(blocks)
    for i in range(LEVELS, 0, -1):
        above = [f"_b{j}" for j in range(LEVELS, i, -1)]
        at = levels[i - 1].join(at, ["rule_id", *above]).select(
            "rule_id", *above, F.inline(_starts("_maps", f"_b{i}"))
        ).withColumnRenamed("_start", "_w")
    rows = blocks.join(at, ["rule_id", *[f"_b{j}" for j in range(LEVELS, 0, -1)]]).select(
        "rule_id", F.inline(_weights("_rows", "_w", low, high, [*order, *carried]))
    )
    message = None
    for kind, text in fv.EVENT_MESSAGES.items():
        head, _, tail = text.partition("{repo}")
        value = F.concat(F.lit(head), F.col("repo_name"), F.lit(tail)) if "{repo}" in text else F.lit(text)
        cond = F.col("event_type") == kind
        message = F.when(cond, value) if message is None else message.when(cond, value)
    return rows.select(
        *[F.col(c) for c in order],
        "rule_id",
        "event_type",
        "repo_name",
        "commit_sha",
        from_units(F.col("_before")).alias("previous_weight"),
        from_units(F.col("_after")).alias("updated_weight"),
        from_units(F.col("_after") - F.col("_before")).alias("delta"),
        (F.col("event_type") == "POST_DEPLOY_REVERT").alias("revert_incremented"),
        message.alias("message"),
    )


def _starts(maps: str, key: str) -> Column:
    """Array of (key, _start): the weight each map of an ordered list begins with."""
    return F.aggregate(
        maps,
        F.struct(
            F.col("_w").alias("w"),
            F.array().cast(f"array<struct<{key}:bigint,_start:bigint>>").alias("out"),
        ),
        lambda acc, x: F.struct(
            apply_map(acc["w"], x["_map"]).alias("w"),
            F.concat(acc["out"], F.array(F.struct(x[key].alias(key), acc["w"].alias("_start")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _weights(rows: str, start: str, low: int, high: int, carried: list[str]) -> Column:
    """Array of the events of a block with the weights before and after each."""
    empty = "array<struct<_before:bigint,_after:bigint>>"

    def move(acc: Column, x: Column) -> Column:
        after = clamp(acc["w"] + x["_d"], low, high)
        step = F.struct(acc["w"].alias("_before"), after.alias("_after"))
        return F.struct(after.alias("w"), F.concat(acc["out"], F.array(step)).alias("out"))

    states = F.aggregate(
        rows,
        F.struct(F.col(start).alias("w"), F.array().cast(empty).alias("out")),
        move,
        lambda acc: acc["out"],
    )
    return F.zip_with(
        rows,
        states,
        lambda x, s: F.struct(
            *[x[c].alias(c) for c in carried], s["_before"].alias("_before"), s["_after"].alias("_after")
        ),
    )


def rule_counters(events: DataFrame, rules: DataFrame) -> DataFrame:
    """``ci_flakiness_correlation`` and ``revert_count`` after the events."""
    kind = F.col("event_type")
    n = events.groupBy("rule_id").agg(
        F.count_if(kind == "CI_BUILD_FLAKINESS").alias("_ci"),
        F.count_if(kind == "POST_DEPLOY_REVERT").alias("_rev"),
    )
    ci = F.coalesce("_ci", F.lit(0))
    return (
        rules.join(n, "rule_id", "left")
        .withColumn(
            "ci_flakiness_correlation",
            F.when(ci == 0, F.col("ci_flakiness_correlation")).otherwise(
                F.least(F.lit(1.0), F.round(F.col("ci_flakiness_correlation") + ci * fv.CI_STEP, 6))
            ),
        )
        .withColumn("revert_count", F.col("revert_count") + F.coalesce("_rev", F.lit(0)))
        .drop("_ci", "_rev")
    )


def unknown_rule_weights(events: DataFrame, rules: DataFrame, *, alpha=fv.LEARNING_RATE, order=("ts", "id")) -> DataFrame:
    """Ledger weight of rules without a row: each event starts at the default again."""
    low, high = _bounds(fv.MIN_WEIGHT, fv.MAX_WEIGHT)
    base = _bounds(fv.DEFAULT_WEIGHT, fv.DEFAULT_WEIGHT)[0]
    last = events.groupBy("rule_id").agg(F.max_by("event_type", F.struct(*order)).alias("event_type"))
    return last.join(rules.select("rule_id"), "rule_id", "left_anti").select(
        "rule_id",
        from_units(clamp(F.lit(base) + delta_units(F.col("event_type"), alpha), low, high)).alias("weight"),
    )


def ledger(events: DataFrame, rules: DataFrame, *, alpha=fv.LEARNING_RATE, order=("ts", "id")) -> DataFrame:
    """Latest weight of every rule that had an event, known or not."""
    maps = fold_maps(events, alpha=alpha, order=order)
    weight = from_units(apply_map(to_units(F.col("current_weight")), F.col("_map")))
    return rules.join(maps, "rule_id").select("rule_id", weight.alias("weight")).unionByName(
        unknown_rule_weights(events, rules, alpha=alpha, order=order)
    )


def weight_as_of(
    rows: DataFrame, events: DataFrame, rules: DataFrame, *, time: str = "ts", alpha=fv.LEARNING_RATE, order=("ts", "id")
) -> DataFrame:
    """``rows`` (``rule_id`` and a time) with the ``weight`` their rule had then.

    An event counts from its own time on. A rule of the table starts with its weight; one
    that is in no table, or a row without rule or time, has the default weight.
    """
    start = rules.select(
        "rule_id", F.lit("0001-01-01").cast("timestamp").alias("_at"), F.lit(None).cast(dict(events.dtypes)[order[1]]).alias("_id"),
        F.col("current_weight").cast("double").alias("weight"),
    )
    moved = weight_history(events, rules, alpha=alpha, order=order).select(
        "rule_id", F.col(order[0]).cast("timestamp").alias("_at"), F.col(order[1]).alias("_id"), F.col("updated_weight").alias("weight")
    )
    timed = rows.withColumn("_time", F.col(time).cast("timestamp"))
    found = asof_join(
        timed, start.unionByName(moved), ["rule_id"], left_time="_time", right_time="_at", values=["weight"], order=["_id"]
    ).drop("_time")
    return found.withColumn("weight", F.coalesce("weight", F.lit(float(fv.DEFAULT_WEIGHT))))


def retro_entries(history: DataFrame) -> DataFrame:
    """Retrospective entries for reverts; needs ``commit_sha`` and ``repo_name``."""
    sha = F.substring("commit_sha", 1, 8)
    return history.where(F.col("event_type") == "POST_DEPLOY_REVERT").select(
        F.concat(F.lit("REVERT-"), sha).alias("id"),
        F.concat(
            F.lit("Post-deploy revert on "), F.col("repo_name"), F.lit(" (commit "), sha,
            F.lit(") correlated with rule "), F.col("rule_id"), F.lit(". Weight elevated to "),
            F.col("updated_weight").cast("string"), F.lit("."),
        ).alias("summary"),
        F.array(
            F.concat(F.lit("Prioritize "), F.col("rule_id"), F.lit(" in future AST and prompt grounding passes")),
            F.lit("Synthesize sandboxed repro regression test"),
        ).alias("action_items"),
    )


def rank_rules(rules: DataFrame) -> DataFrame:
    """``rules`` with their ``place`` by weight, then id; it comes from block counts, not from one sorted task."""
    keyed = rules.withColumns({"_all": F.lit(0), "_down": -F.col("current_weight")})
    return positions(keyed, ["_all"], ["_down", "rule_id"], "place").drop("_all", "_down")


def seed_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, n, w, w, 0.0, 0) for i, n, w in fv.SEED_RULES],
        "rule_id string, rule_name string, base_weight double, current_weight double, "
        "ci_flakiness_correlation double, revert_count bigint",
    )
