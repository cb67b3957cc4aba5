"""Sources, sinks and diffs on example rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import diffs
from reviewlake.sources import events, files, findings_json, history, tables


def test_history_lines(spark):
    lines = [
        "id,type,description", "1, Formatting, Avoid short names", '2,Security,"Never, ever"', '3, x, "a, b"', "4, only text",
        "5", "", "<ID>,a,b", '6,perf,"say ""hi"", ok" now', "7,x,",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r["rule_id"]: (r["rule_type"], r["description"]) for r in history.parse_history(df).collect()}
    assert got == {
        "CSV-HIST-1": ("formatting", "Avoid short names"), "CSV-HIST-2": ("security", "Never, ever"),
        "CSV-HIST-3": ("x", '"a, b"'), "CSV-HIST-4": ("general", "only text"), "CSV-HIST-6": ("perf", 'say "hi", ok now'),
    }


def test_history_reaches_both_tables(spark):
    df = spark.createDataFrame([("1, perf, Cache lookups",)], "value string")
    rec = history.parse_history(df)
    rule = history.history_rules(rec).first()
    assert (rule["rule_name"], rule["current_weight"]) == ("PerfGuard: Cache lookups...", 1.5)
    inc = history.history_incidents(rec).first()
    assert inc["pr_url"] == "csv://imported/CSV-HIST-1" and len(inc["embedding"]) == 768


def test_sources_with_two_encodings(spark, tmp_path):
    (tmp_path / "a.py").write_bytes("é = 1".encode("utf-8"))
    (tmp_path / "b.py").write_bytes("é = 1".encode("latin-1"))
    got = files.scan_sources(spark, str(tmp_path), glob="*.py").collect()
    assert sorted(r["source"] for r in got) == ["é = 1", "é = 1"]
    assert all(r["error"] is None for r in got)


@pytest.mark.parametrize("kept", [False, True])
def test_lost_files_become_error_rows(spark, tmp_path, kept):
    (tmp_path / "src" / "sub").mkdir(parents=True)
    folder = str(tmp_path / "src")
    spark.createDataFrame([("x = 1",)], "value string").coalesce(1).write.text(f"{folder}/broken.d")
    broken = next(p for p in (tmp_path / "src" / "broken.d").iterdir() if p.name.startswith("part-"))
    broken.write_bytes(b"y = 2\n")  # no longer what its checksum says
    (tmp_path / "src" / "sub" / "part-good").write_text("é")
    (tmp_path / "src" / "part-empty").write_text("")
    (tmp_path / "src" / "part-large").write_text("z" * 100)
    work = str(tmp_path / "work") if kept else None
    got = {r.path.rsplit("/", 1)[1]: tuple(r)[1:] for r in files.scan_sources(spark, folder, glob="part-*", max_bytes=50, work_path=work).collect()}
    assert got == {
        "part-good": (2, "é", None), "part-large": (100, None, "larger than 50 bytes"),
        broken.name: (6, None, "unreadable"),
    }


def test_events_from_files(spark, tmp_path):
    (tmp_path / "e.json").write_text(
        '{"event_type": "POST_DEPLOY_REVERT", "rule_id": "R"}\n{"event_type": "X", "rule_id": "R"}\n{"rule_id": "R"}\n{bad\n'
    )
    good, bad = events.split_events(events.read_events(spark, str(tmp_path)))
    row = good.first()
    assert (row["repo_name"], row["commit_sha"], row["details"]) == ("org/payments", "0" * 40, {})
    assert sorted(r["reject_reason"] for r in bad.collect()) == ["missing field", "unknown event type", "unreadable"]


def test_made_ids_stay_the_same(spark, tmp_path):
    line = '{"event_type": "POST_DEPLOY_REVERT", "rule_id": "R"}'
    (tmp_path / "e.json").write_text("\n".join([line] * 3 + ['{"id": "own", "event_type": "X"}']))
    (tmp_path / "f.json").write_text(line)
    rows = events.read_events(spark, str(tmp_path))
    first = sorted(r.id for r in rows.select("id").collect())
    assert len(set(first)) == 5 and "own" in first
    assert sorted(r.id for r in rows.select("id", "event_type").collect()) == first


def test_append_refuses_duplicates(spark, tmp_path):
    path = str(tmp_path / "sessions")
    rows = spark.createDataFrame([("a", "r"), ("b", "r")], "id string, repo_name string")
    tables.append_sessions(rows, path)
    with pytest.raises(ValueError):
        tables.append_sessions(rows.where("id = 'a'"), path)
    with pytest.raises(ValueError):
        tables.append_sessions(rows.unionByName(rows).withColumn("id", F.lit("z")), path)
    assert spark.read.parquet(path).count() == 2


def test_upsert_last_one_wins(spark):
    now = dt.datetime(2024, 1, 1)
    target = spark.createDataFrame(
        [("a", "old", 2.0, 2.0, 0.3, 4)],
        "rule_id string, rule_name string, base_weight double, current_weight double, ci_flakiness_correlation double, revert_count long",
    )
    up = spark.createDataFrame(
        [("a", "x", 1.5, now, 1), ("a", "y", 1.6, now, 2), ("n", "z", 1.5, now, 3)],
        "rule_id string, rule_name string, current_weight double, last_updated timestamp, n int",
    )
    got = {r["rule_id"]: r for r in tables.upsert_rules(target, up, order="n").collect()}
    a = got["a"]
    assert (a["rule_name"], a["base_weight"], a["current_weight"], a["ci_flakiness_correlation"], a["revert_count"]) == (
        "y", 2.0, 1.6, 0.3, 4)
    assert (got["n"]["base_weight"], got["n"]["revert_count"]) == (1.5, 0)


def test_bad_document_gives_no_findings(spark):
    df = spark.createDataFrame([("[{",), ("{}",), ("",), (None,)], "text string")
    assert findings_json.extract_findings(df).count() == 0


def test_diff_sections_and_sources(spark):
    text = (
        "lead\ndiff --git a/x.py b/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-rate = 1\n+rate = 2\n same\n"
        "diff --git a/y b/y\n-gone\n"
    )
    df = spark.createDataFrame([(1, text), (2, ""), (3, "  \n")], "id int, diff string")
    got = [(r["id"], r["file_no"], r["file_path"]) for r in diffs.split_by_file(df).collect()]
    assert got == [(1, 0, "git-diff"), (1, 1, "x.py"), (1, 2, "y")]
    src = {r["id"]: r for r in diffs.to_source(df).collect()}
    assert (src[1]["source"], src[1]["target"], src[1]["is_empty"]) == ("rate = 2\nsame", "x.py", False)
    assert src[3]["is_empty"]


def test_hunks_find_their_place(spark):
    body = "\n".join(f"line {i}" for i in range(1, 41)) + "\n"
    hunk = lambda at, line: f"@@ -{at},1 +{at},1 @@\n-{line}\n+new\n"
    cases = [
        (1, hunk(5, "line 5"), "MATCH", 5), (2, hunk(5, "line 8"), "MATCH", 8), (3, hunk(9, "line 6"), "MATCH", 6),
        (4, hunk(5, "line 20"), "SUBSTRING", 20), (5, hunk(50, "nowhere"), "CONFLICT", None), (6, hunk(2, "ine 3"), "SUBSTRING", 3),
    ]
    f = spark.createDataFrame([(i, body) for i, *_ in cases], "file_id int, text string")
    p = spark.createDataFrame([(i, h) for i, h, *_ in cases], "file_id int, patch string")
    got = {r["file_id"]: (r["status"], r["position"]) for r in diffs.match_hunks(f, p).collect()}
    assert got == {i: (s, at) for i, _, s, at in cases}


def test_repeated_history_ids_make_no_more_rows(spark):
    from reviewlake.sources import history

    lines = spark.createDataFrame([("7, race, first text",), ("7, race, second text",)], "value string")
    got = history.history_incidents(history.parse_history(lines)).collect()
    assert sorted(r["description"] for r in got) == ["first text", "second text"]
