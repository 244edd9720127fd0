"""Streams with state and with line numbers, restarted on the way, against their batch forms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from brontide.operators import ledger
from brontide.streaming import lines, stateful
from brontide.streaming import ledger as streams


def fed(spark, schema, batches, make, tmp_path, restart=True):
    """The rows that a streaming form gives when its batches arrive one by one, the query started anew for each."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n == len(batches) - 1 or restart:
            made = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            q = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(180)
            if q.exception():
                raise q.exception()
            q.stop()
    return spark.read.parquet(str(tmp_path / "out"))


def test_illegal_steps_are_those_of_the_batch_form(spark, tmp_path):
    r = random.Random(1)
    schema = "run string, seq long, status string"
    rows = [(f"r{r.randrange(5)}", i, r.choice(list(ledger.TRANSITIONS))) for i in range(60)]
    got = fed(spark, schema, [rows[:25], rows[25:40], rows[40:]], lambda s: stateful.illegal_steps(s, "run", "status", "seq"), tmp_path)
    want = ledger.illegal_transitions(spark.createDataFrame(rows, schema), "run", "status", "seq").select("run", "seq", "previous", "status")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_a_second_hash_is_a_conflict(spark, tmp_path):
    schema = "key string, at long, hash string"
    rows = [("a", 1, "x"), ("b", 2, "y"), ("a", 3, "x"), ("a", 4, "z"), ("c", 5, "x"), ("b", 6, "x"), ("b", 7, "y")]
    got = fed(spark, schema, [rows[:2], rows[2:4], rows[4:]], lambda s: stateful.idempotent_requests(s, "key", "hash", "at"), tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted([("a", 1, "x", "created", 1), ("b", 2, "y", "created", 2), ("a", 3, "x", "existing", 1), ("a", 4, "z", "conflict", 1), ("c", 5, "x", "created", 5), ("b", 6, "x", "conflict", 2), ("b", 7, "y", "existing", 2)])
    batch = ledger.idempotency(spark.createDataFrame(rows, schema), "key", "hash", "at").collect()
    folded = got.groupBy("key").agg(F.count("*").alias("n"), F.min("first").alias("first"), F.bool_or(F.col("outcome") == "conflict").alias("c")).collect()
    assert {(b["key"], b["requests"], b["first_request"], b["conflict"]) for b in batch} == {tuple(f) for f in folded}


def test_numbers_and_a_bounded_tail(spark, tmp_path):
    schema = "run string, at long, said string"
    rows = [(f"r{i % 2}", i, f"e{i}") for i in range(21)]
    got = fed(spark, schema, [rows[:9], rows[9:12], rows[12:]], lambda s: stateful.numbered_tail(s, "run", "at", "said", 4), tmp_path)
    want = ledger.sequence(spark.createDataFrame(rows, schema), "run", "at")
    assert sorted((x["run"], x["at"], x["sequence"]) for x in got.collect()) == sorted((x["run"], x["at"], x["sequence"]) for x in want.collect())
    last = got.groupBy("run").agg(F.max("oldest").alias("oldest"), F.max("sequence").alias("n")).collect()
    assert all(x["oldest"] == x["n"] - 3 for x in last)


def drained(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).start()
    q.processAllAvailable()
    return q


@pytest.mark.parametrize("chunk", [1 << 20, 5])
def test_lines_are_replayed_after_any_number(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(lines, "_CHUNK", chunk)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_bytes(b"one\ntwo\r\n\nfour\nunfin")
    (folder / "b.log").write_text("한글\n")
    (folder / "c.txt").write_text("other\n")
    q = drained(spark, lines.read_lines(spark, str(folder), ".log"), f"lines{chunk}")
    rows = lambda: sorted(tuple(r) for r in spark.table(f"lines{chunk}").collect())
    assert rows() == [("a.log", 1, "one"), ("a.log", 2, "two"), ("a.log", 3, ""), ("a.log", 4, "four"), ("b.log", 1, "한글")]
    with (folder / "a.log").open("ab") as f:
        f.write(b"ished\nsix\n")
    q.processAllAvailable()
    q.stop()
    assert rows()[4:6] == [("a.log", 5, "unfinished"), ("a.log", 6, "six")]
    for after in (2, 5):
        q = drained(spark, lines.read_lines(spark, str(folder), "a.log", after), f"after{chunk}_{after}")
        q.stop()
        assert [r["line"] for r in spark.table(f"after{chunk}_{after}").orderBy("line").collect()] == list(range(after + 1, 7))


def test_errors_name_their_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    said = [json.dumps({"response": "Hel"}), "", json.dumps({"response": "lo", "done": False}), "oops", "[1]", json.dumps({"response": "!", "done": True})]
    (folder / "s.ndjson").write_text("\n".join(said) + "\n")
    q = drained(spark, lines.read_lines(spark, str(folder), ".ndjson"), "tokens")
    q.stop()
    got = streams.concat_tokens(spark.table("tokens"), "file", "line").collect()
    assert [(r["text"], [tuple(e) for e in r["errors"]]) for r in got] == [("Hello!", [(4, "no JSON"), (5, "no JSON object")])]
