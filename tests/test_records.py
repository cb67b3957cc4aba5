"""Records over several lines against Python's CSV reader."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from reviewlake.sources import history, records


def plain(text):
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    return [[c.strip() for c in row] for row in csv.reader(lines) if row]


def rows_of(spark, files, monkeypatch=None, bits=None, **options):
    lines = [(f, n, x) for f, text in files.items() for n, x in enumerate(text.split("\n"))]
    random.Random(1).shuffle(lines)
    df = spark.createDataFrame(lines, "file string, n int, value string").repartition(6)
    out = {f: [] for f in files}
    for r in records.records(df, ["file"], ["n"], **options).orderBy("file", "at").collect():
        out[r.file].append(r.value)
    return out


def made(rng, n):
    out = []
    for i in range(n):
        cell = lambda: rng.choice(["a", "", ' "x', 'b "c" d', '"q"', '"q ""r"" s"', '"open', 'end"', 'end" tail', '""', '"""', '""""', "  ", 'x"', '"a,b"', "é"])
        out.append(rng.choice([",", ",", ", "]).join(cell() for _ in range(rng.randrange(1, 5))))
    return "\n".join(out)


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_equals_the_csv_reader(spark, monkeypatch, bits):
    monkeypatch.setattr(records, "BITS", bits)
    rng = random.Random(bits)
    files = {f"f{i}": made(rng, rng.randrange(1, 60)) for i in range(40)}
    got = rows_of(spark, files)
    fields = lambda r: [c.strip() for c in next(csv.reader([r]))]
    for name, text in files.items():
        assert [fields(r) for r in got[name]] == plain(text), text


def test_large_files_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    text = "".join(f'{i},Perf,"line one of {i}\n  and, line ""two"" {"x" * rng.randrange(60)}\n\nlast"\r\n{i},b,single\n' for i in range(6000))
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text('1,z,"never closed\n2,z,so one')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 10
        got = history.read_history(spark, str(tmp_path / "*.csv"))
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = sorted((f"CSV-HIST-{r[0]}", r[1].lower(), ", ".join(r[2:])) for r in plain(text))
    assert sorted((r.rule_id, r.rule_type, r.description) for r in rows if r.file.endswith("a.csv")) == want
    assert [(r.rule_id, r.description) for r in rows if r.file.endswith("b.csv")] == [("CSV-HIST-1", "never closed2,z,so one")]


def test_a_lost_quote_does_not_swallow_the_file(spark, monkeypatch):
    monkeypatch.setattr(records, "MOST_LINES", 50)
    files = {"lost": '1,a,"lost\n' + "\n".join(f"{i},b,c" for i in range(200)), "fine": '1,a,"' + "\n".join(["x"] * 40) + '"\n2,b,c'}
    got = rows_of(spark, files)
    assert len(got["lost"]) == 201 and len(got["fine"]) == 2
    assert rows_of(spark, {"none": "\n \n"}) == {"none": []}
