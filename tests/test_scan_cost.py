"""Steps of the rule scan that must not be worked out more often than once."""

from pyspark.sql import functions as F

from reviewlake.functions.text import split_lines
from reviewlake.operators import diffs, rules
from reviewlake.operators.lines import pieces
from reviewlake.sources import history, records


def test_source_is_worked_out_once(spark):
    files = spark.range(3).select(F.col("id").alias("file_id"), F.concat(F.lit("fee = 0.5\n# marked "), F.col("id").cast("string")).alias("source"))
    found = rules.find(files)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("# marked ") == 1 and plan.count("lower(source") == 1
    assert found.count() == 3


def test_pieces_read_their_brackets_once(spark):
    code = "if a(b): f(1); g = [2;3]; h"
    df = spark.createDataFrame([(code,)], "code string").select(pieces(F.col("code")).alias("p"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [(p["code"], p["row"], p["col"]) for p in df.first()["p"]] == [(" f(1)", 0, 9), (" g = [2;3]", 0, 15), (" h", 0, 26)]


def test_every_line_break_ends_a_line(spark):
    texts = ["", "\n", "a\n", "a\r\n", "a\n\r", "a\r\n\r\nb", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h ", "\r\n\n", "a\nb", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", split_lines(F.col("t")).alias("l"))
    assert {r["i"]: r["l"] for r in rows.collect()} == {i: t if t is None else t.splitlines() for i, t in enumerate(texts)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan and plan.count("regexp_replace") == 1


def test_only_the_end_of_a_text_is_searched_for_its_last_break(spark):
    texts = ["x", "\n\n", "é\r\n", "a\u2028", "😀\n", "a\n😀", "\ra", "a\x85\n", "a\nb\n\r", "\r\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", split_lines(F.col("t")).alias("l"))
    assert {r["i"]: r["l"] for r in rows.collect()} == {i: t.splitlines() for i, t in enumerate(texts)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(t#" not in plan and "contains(t#" in plan.lower()


def test_diff_text_is_split_once(spark):
    rows = spark.range(4).select("id", F.concat(F.lit("    +a = 1\r\n     b\n\n    -c\n    +++ b/x "), F.col("id").cast("string")).alias("diff"))
    out = diffs.to_source(rows)
    assert {(r["source"], r["target"]) for r in out.collect()} == {("a = 1\nb", f"x {i}") for i in range(4)}
    added = rows.select(diffs.as_added(F.lit("x"), F.col("diff")).alias("d"))
    assert added._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert added.first()["d"].startswith("--- a/x\n+++ b/x\n@@ -0,0 +1,5 @@\n+    +a = 1\n+     b\n+\n")


def test_history_lines_are_worked_out_once(spark):
    value = F.concat(F.lit("  R"), F.col("id").cast("string"), F.lit(", Perf, marked  "))
    lines = spark.range(3).select(F.lit("f").alias("file"), F.col("id").alias("n"), value.alias("value"))
    rules_ = history.parse_history(lines)
    plan = rules_._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", Perf, marked") == 1 and plan.count("regexp_extract_all") == 1
    assert sorted((r["rule_type"], r["description"]) for r in rules_.collect()) == [("perf", "marked")] * 3
    slim = records.nonblank(lines, ["file"], ["n"], "value")
    assert slim._jdf.queryExecution().optimizedPlan().toString().count(", Perf, marked") == 1
    assert sorted(r["_line"] for r in slim.collect()) == [f"R{i}, Perf, marked" for i in range(3)]
