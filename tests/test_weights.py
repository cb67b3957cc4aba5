"""Weight folds on example rows and against a plain loop."""

import datetime as dt
import random

import pytest

from reviewlake import fixed_values as fv
from reviewlake.operators import weights

T0 = dt.datetime(2024, 1, 1)


def _events(spark, rows):
    data = [(f"E{n:06d}", k, "org/x", "a1b2c3d4e5", r, T0 + dt.timedelta(seconds=n)) for n, (r, k) in enumerate(rows)]
    return spark.createDataFrame(
        data, "id string, event_type string, repo_name string, commit_sha string, rule_id string, ts timestamp"
    )


def _fold(weight, kinds):
    steps = []
    units = round(weight * 10_000)
    for k in kinds:
        after = min(50_000, max(2_000, units + weights.deltas()[k]))
        steps.append((units / 10_000, after / 10_000))
        units = after
    return units / 10_000, steps


def test_examples(spark):
    rows = (
        [("AST-FIN-001", "POST_DEPLOY_REVERT")] + [("AST-FIN-003", "CI_BUILD_FLAKINESS")]
        + [("AST-FIN-002", "DEV_ACCEPTED_PATCH")] + [("AST-FIN-004", "DEV_REJECTED_FINDING")] * 30
        + [("RULE-RACE-CONDITION", "POST_DEPLOY_REVERT")] * 30 + [("NEW", "POST_DEPLOY_REVERT"), ("NEW", "DEV_REJECTED_FINDING")]
    )
    ev, rules = _events(spark, rows), weights.seed_rules(spark)
    got = {r["rule_id"]: r["current_weight"] for r in weights.fold_weights(ev, rules).collect()}
    assert got == {
        "AST-FIN-001": 1.8, "AST-FIN-002": 2.075, "AST-FIN-003": 2.35, "AST-FIN-004": 0.2,
        "RULE-RACE-CONDITION": 5.0, "RULE-RETRY-IDEMPOTENCY": 2.5,
    }
    counters = {r["rule_id"]: r for r in weights.rule_counters(ev, rules).collect()}
    assert counters["AST-FIN-001"]["revert_count"] == 1
    assert counters["AST-FIN-003"]["ci_flakiness_correlation"] == 0.1
    assert [tuple(r) for r in weights.unknown_rule_weights(ev, rules).collect()] == [("NEW", 0.88)]
    retro = weights.retro_entries(weights.weight_history(ev, rules)).collect()
    assert {r["id"] for r in retro} == {"REVERT-a1b2c3d4"}
    assert any("Weight elevated to 1.8." in r["summary"] for r in retro)


@pytest.mark.parametrize("bits", [2, 8])
def test_hot_rule_against_a_loop(spark, monkeypatch, bits):
    """Small blocks force many blocks on every level."""
    monkeypatch.setattr(weights, "BITS", bits)
    rng = random.Random(3)
    kinds = list(fv.EVENT_FACTORS)
    rows = [("AST-FIN-001" if rng.random() < 0.7 else f"AST-FIN-00{rng.randint(2, 4)}", rng.choice(kinds)) for _ in range(900)]
    ev, rules = _events(spark, rows), weights.seed_rules(spark)
    start = {i: w for i, _, w in fv.SEED_RULES}
    folded = {r["rule_id"]: r["current_weight"] for r in weights.fold_weights(ev, rules).collect()}
    history = weights.weight_history(ev, rules).orderBy("rule_id", "ts").collect()
    for rule, weight in start.items():
        end, steps = _fold(weight, [k for r, k in rows if r == rule])
        assert folded[rule] == end
        assert [(h["previous_weight"], h["updated_weight"]) for h in history if h["rule_id"] == rule] == steps
    assert all(0.2 <= h["updated_weight"] <= 5.0 for h in history)


def test_rate_off_the_grid_is_refused():
    with pytest.raises(ValueError):
        weights.deltas(0.12345)
