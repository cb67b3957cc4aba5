"""Streams give what the batch jobs give, also in many batches and after a restart."""

import datetime as dt
import json

from reviewlake.operators import redact, weights
from reviewlake.sources import events
from reviewlake.streaming import jobs

KINDS = ["POST_DEPLOY_REVERT", "DEV_REJECTED_FINDING", "CI_BUILD_FLAKINESS", "DEV_ACCEPTED_PATCH"]


def _write_events(folder, n_files=3, per_file=40):
    folder.mkdir()
    for f in range(n_files):
        lines = []
        for i in range(per_file):
            k = f * per_file + i
            lines.append(json.dumps({
                "id": f"E{k:05d}", "event_type": KINDS[k * 7 % 4], "rule_id": f"AST-FIN-00{k % 3 + 1}",
                "timestamp": (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k)).isoformat(),
            }))
        (folder / f"{f}.json").write_text("\n".join(lines))


def test_weights_in_many_batches_and_after_restart(spark, tmp_path):
    _write_events(tmp_path / "in")
    rules = weights.seed_rules(spark)
    want = {
        r["rule_id"]: r["current_weight"]
        for r in weights.fold_weights(events.split_events(events.read_events(spark, str(tmp_path / "in")))[0], rules).collect()
    }

    def run():
        parsed = events.read_event_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
        good, _ = events.split_events(parsed)
        jobs.fold_weights(good, rules, str(tmp_path / "w"), str(tmp_path / "cp")).awaitTermination()
        return {r["rule_id"]: r["current_weight"] for r in jobs.latest_weights(spark, str(tmp_path / "w")).collect()}

    # Files may come in any order within the same second, so compare bounds and
    # the exact fold only when the order is the file order.
    first = run()
    assert set(first) == set(want) and all(0.2 <= w <= 5.0 for w in first.values())
    assert first == want
    assert run() == first


def test_keyed_states_over_batches_a_restart_and_idle_rules(spark, tmp_path):
    folder = tmp_path / "in"
    _write_events(folder)
    later = sorted(folder.iterdir())[2].rename(tmp_path / "later.json")
    rules = weights.seed_rules(spark).where("rule_id <> 'AST-FIN-003'")

    def folded():
        good = events.split_events(events.read_events(spark, str(folder)))[0]
        known = {r["rule_id"]: r["current_weight"] for r in weights.fold_weights(good, rules).join(good, "rule_id", "left_semi").collect()}
        return known | {r["rule_id"]: r["weight"] for r in weights.unknown_rule_weights(good, rules).collect()}

    def run():
        good, _ = events.split_events(events.read_event_stream(spark, str(folder), files_per_trigger=1))
        states = jobs.weight_states(good, rules, idle="2 days")
        jobs.write_batches(states, str(tmp_path / "s"), str(tmp_path / "cp"), mode="update").awaitTermination()
        return {r["rule_id"]: r for r in jobs.latest_states(spark, str(tmp_path / "s")).collect()}

    got = run()
    assert {k: r["current_weight"] for k, r in got.items()} == folded() and sum(r["n_events"] for r in got.values()) == 80
    later.rename(folder / "2.json")
    got = run()
    assert {k: r["current_weight"] for k, r in got.items()} == folded() and sum(r["n_events"] for r in got.values()) == 120
    assert {k: r["known"] for k, r in got.items()} == {"AST-FIN-001": True, "AST-FIN-002": True, "AST-FIN-003": False}
    # an event of one rule long after shows that the others have been idle
    (folder / "3.json").write_text(json.dumps({"id": "Z", "event_type": KINDS[0], "rule_id": "AST-FIN-001", "timestamp": "2024-03-01T00:00:00"}))
    got = run()
    assert {k: r["idle"] for k, r in got.items()} == {"AST-FIN-001": False, "AST-FIN-002": True, "AST-FIN-003": True}
    assert {k: r["current_weight"] for k, r in got.items()} == folded()


def test_events_are_routed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"event_type": "DEV_ACCEPTED_PATCH", "rule_id": "R"}\n{"rule_id": 1}\n')

    def run():
        parsed = events.read_event_stream(spark, str(tmp_path / "in"))
        jobs.route_events(parsed, str(tmp_path / "v"), str(tmp_path / "r"), str(tmp_path / "cp")).awaitTermination()
        return jobs.read_batches(spark, str(tmp_path / "v")).count(), jobs.read_batches(spark, str(tmp_path / "r")).count()

    assert run() == (1, 1)
    assert run() == (1, 1)


def test_counts_drop_late_and_repeated_events(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = lambda i, t: json.dumps({"id": i, "event_type": KINDS[0], "ts": t})
    schema = "id string, event_type string, ts timestamp"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
        jobs.write_batches(jobs.event_counts(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()

    (src / "1.json").write_text("\n".join([row("a", "2024-01-01T01:00:00"), row("a", "2024-01-01T01:00:00"), row("b", "2024-01-01T02:00:00"), row("c", "2024-01-03T00:00:00")]))
    run()
    (src / "2.json").write_text("\n".join([row("late", "2024-01-01T03:00:00"), row("d", "2024-01-05T00:00:00")]))
    run()
    got = {r["window_start"].day: r["n"] for r in jobs.read_batches(spark, str(tmp_path / "out")).collect()}
    assert got == {1: 2, 3: 1}


def test_inspection_is_the_batch_inspection(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, "card 4532015112830366"), (2, "system override"), (3, "x")], "id int, text string")
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    jobs.write_batches(jobs.inspect_payloads(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(jobs.read_batches(spark, str(tmp_path / "out")).collect()) == sorted(redact.inspect(rows).collect())


def test_rules_of_later_batches_and_rules_in_no_table(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = lambda i, rule, kind=KINDS[0]: json.dumps({"id": i, "event_type": kind, "rule_id": rule, "timestamp": "2024-01-01T00:00:00"})
    table = lambda *names: spark.createDataFrame([(n, 2.0) for n in names], "rule_id string, current_weight double")

    def run(rules):
        good, _ = events.split_events(events.read_event_stream(spark, str(src)))
        jobs.fold_weights(good, rules, str(tmp_path / "w"), str(tmp_path / "cp")).awaitTermination()
        return {r["rule_id"]: (r["current_weight"], r["known"]) for r in jobs.latest_weights(spark, str(tmp_path / "w")).collect()}

    (src / "1.json").write_text("\n".join([row("a", "A"), row("b", "B"), row("c", "C")]))
    first = run(table("A"))
    assert first["A"][0] != 2.0 and first["A"][1] and not first["B"][1] and not first["C"][1]
    (src / "2.json").write_text(row("d", "B"))
    second = run(table("A", "B", "D"))
    assert second["A"] == first["A"] and second["C"] == first["C"]
    assert second["B"] == first["A"] and second["D"] == (2.0, True)  # B starts with its own weight


def test_open_windows_are_read_from_updates(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "id string, event_type string, ts timestamp"
    row = lambda i, t: json.dumps({"id": i, "event_type": KINDS[0], "ts": t})

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
        jobs.write_batches(jobs.event_counts(stream), str(tmp_path / "out"), str(tmp_path / "cp"), mode="update").awaitTermination()
        return {r["window_start"].day: r["n"] for r in jobs.latest_counts(spark, str(tmp_path / "out")).collect()}

    (src / "1.json").write_text("\n".join([row("a", "2024-01-01T01:00:00"), row("b", "2024-01-01T02:00:00")]))
    assert run() == {1: 2}
    (src / "2.json").write_text("\n".join([row("c", "2024-01-01T02:05:00"), row("d", "2024-01-02T00:00:00")]))
    assert run() == {1: 3, 2: 1}


def test_events_without_time_or_id_stay_apart(spark):
    import pyspark.sql.functions as F

    lines = spark.createDataFrame([('{"event_type": "DEV_ACCEPTED_PATCH", "rule_id": "R"}',)] * 2, "value string")
    got = events.parse_events(lines, arrived=F.lit("2024-05-01 00:00:00").cast("timestamp")).collect()
    assert len({r["id"] for r in got}) == 2 and all(r["ts"].month == 5 for r in got)


def test_streams_read_tables_in_folders(spark, sf_dir, tmp_path):
    """A larger table is a folder of files."""
    from __spark_entry__ import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["inspect_stream"](spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, queries()["inspect_stream"](spark, sf_dir).collect()))
