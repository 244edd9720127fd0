"""Quoted CSV by ranges against a reader that sees the whole file."""

import csv
import io
import random

import pytest

from brontide.sources import csv_ranges, files


def model_after(text, inside):
    """The state at the end of a line, by the csv module: does another line belong to the record?"""
    lead = '"' if inside else ""
    rows = list(csv.reader([lead + text + "\n", "zz\n"]))
    return len(rows) == 1


@pytest.mark.parametrize("seed", range(3))
def test_states_are_those_of_the_csv_module(seed):
    r = random.Random(seed)
    for _ in range(3000):
        line = "".join(r.choices('",ab ', k=r.randrange(12)))
        for inside in (False, True):
            assert csv_ranges.state_after(line.encode(), inside, b",") == model_after(line, inside), (line, inside)


def some_table(r, n):
    cell = lambda: r.choice(["", "plain", 'say "hi"', "a,b", "two\nlines", "many\n\n\nlines,\"x\"\n", "crlf\r\nin", "한글, 값", "x" * r.randrange(300)])
    return [["목록키", "이름", "설명"], *([str(15_000_000 + i), cell(), cell()] for i in range(n))]


def written_csv(table, encoding, end="\r\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(table)
    return out.getvalue().encode(encoding)


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "30"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize(("encoding", "end"), [("euc-kr", "\r\n"), ("utf-8-sig", "\n")])
def test_records_of_many_ranges_are_those_of_the_file(spark, tmp_path, small_ranges, encoding, end):
    table = some_table(random.Random(encoding), 40)
    table.insert(20, ["15999999", "a very\n" * 200, "long cell that fills ranges"])
    (tmp_path / "a.csv").write_bytes(written_csv(table, encoding, end))
    lines = csv_ranges._lines(spark, str(tmp_path / "a.csv"))
    assert lines.select("start").distinct().count() > 8  # as many tasks as ranges
    got = csv_ranges.read_records(spark, str(tmp_path / "a.csv")).orderBy("start", "ordinal").collect()
    want = [[c.replace("\r\n", "\n") if end == "\n" and "\r\n" not in c else c for c in row] for row in csv.reader(io.StringIO((tmp_path / "a.csv").read_bytes().decode(encoding), newline=""))]
    assert {r["encoding"] for r in got} <= {"euc-kr", "cp949", "utf-8-sig", "utf-8"}
    assert [[c.lstrip("﻿") for c in r["cells"]] for r in got] == want


def test_catalog_of_many_ranges_is_the_one_task_reader(spark, tmp_path, small_ranges):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, encoding in enumerate(("euc-kr", "utf-8-sig")):
        (folder / f"{k}.csv").write_bytes(written_csv(some_table(random.Random(k), 25), encoding))
    (folder / "none.csv").write_bytes(b"a,b\nx,y\n")
    (folder / "bad.csv").write_bytes(b"id,b\n1234567,\xff\xff\xfe\n")
    (folder / "empty.csv").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    got = csv_ranges.catalog_table(spark, str(folder)).collect()
    whole = spark.read.format("binaryFile").load(str(folder)).selectExpr("path", "content")
    want = files.catalog_rows(whole).collect()
    key = lambda rows: sorted((r["path"].rsplit("/", 1)[-1], r["encoding"], r["number"], sorted(r["row"].items())) for r in rows)
    assert key(got) == key(want) and len(got) == 50


def test_the_other_way_to_the_states_gives_the_same(spark, tmp_path, small_ranges, monkeypatch):
    table = some_table(random.Random(9), 20)
    (tmp_path / "a.csv").write_bytes(written_csv(table, "utf-8"))
    read = lambda: [r["cells"] for r in csv_ranges.read_records(spark, str(tmp_path / "a.csv")).orderBy("start", "ordinal").collect()]
    one = read()
    monkeypatch.setattr(csv_ranges, "MOST_SENT", 0)
    assert read() == one == table
