"""Sinks that commit: what a failing task, an empty target or a lost driver leave behind."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brontide.sources import sinks


def held(path):
    """What a reader of the folder sees: all but what jobs have staged."""
    found = (p for p in Path(path).rglob("*") if p.is_file())
    return {str(p.relative_to(path)): p.read_text() for p in found if p.relative_to(path).parts[0] != sinks.STAGED}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([("1", "api", "eins", [1, 2]), ("2", "file", "zwei", None), ("3", None, "drei", [])], "api_id string, api_type string, name string, n array<int>").repartition(3)


def test_a_file_for_each_document(spark, docs, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_documents(docs, path)
    first = held(path)
    assert set(first) == {"api/1.json", "file/2.json", "_unknown/3.json"} and json.loads(first["api/1.json"]) == {"api_id": "1", "api_type": "api", "name": "eins", "n": [1, 2]}
    sinks.write_documents(docs.filter("api_id = '1'").withColumn("name", F.lit("neu")), path)
    again = held(path)
    assert json.loads(again.pop("api/1.json"))["name"] == "neu" and again == {k: v for k, v in first.items() if k != "api/1.json"}


def test_a_failing_task_leaves_the_old_files(spark, docs, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_documents(docs, path)
    before = held(path)
    broken = docs.withColumn("name", F.when(F.col("api_id") == "2", F.raise_error(F.lit("lost"))).otherwise(F.lit("neu")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_documents(broken, path)
    assert held(path) == before
    sinks.recover(path)  # a task that still ran when the job was taken back may have staged a file
    assert held(path) == before and not (Path(path) / sinks.STAGED).exists()
    for bad in ("a/b", "", ".x", None):
        with pytest.raises(Exception, match="can't name"):
            sinks.write_documents(docs.withColumn("api_id", F.lit(bad).cast("string")), path)
    assert held(path) == before


def test_split_replaces_targets_or_nothing(spark, docs, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_split(docs, path, "api_type", ["api", "file"])
    got = {k.split("/")[0]: [json.loads(x)["name"] for x in v.splitlines()] for k, v in held(path).items()}
    assert got == {"api": ["eins"], "file": ["zwei"]}
    before = held(path)
    with pytest.raises(Exception, match="no rows for link"):
        sinks.write_split(docs.withColumn("name", F.lit("neu")), path, "api_type", ["api", "link"])
    assert held(path) == before
    sinks.write_split(docs.withColumn("name", F.lit("neu")), path, "api_type", ["api"])
    after = held(path)
    assert [json.loads(v)["name"] for k, v in after.items() if k.startswith("api/")] == ["neu"]
    assert {k: v for k, v in after.items() if k.startswith("file/")} == {k: v for k, v in before.items() if k.startswith("file/")}


@pytest.mark.parametrize("moved", [0, 1, 3])
def test_a_lost_driver_is_recovered(spark, docs, tmp_path, monkeypatch, moved):
    """The driver dies after so many moves: what is ready is finished."""
    from pyarrow import fs

    path = str(tmp_path / "out")
    sinks.write_documents(docs.withColumn("name", F.lit("alt")), path)

    class Dying:
        def __init__(self, store):
            self.store, self.left = store, moved + 1  # the mark is moved too

        def __getattr__(self, name):
            return getattr(self.store, name)

        def move(self, a, b):
            if self.left == 0:
                raise KeyboardInterrupt("killed")
            self.left -= 1
            self.store.move(a, b)

    place = sinks._place
    writer = sinks.StagedWriter({"path": path})
    store, base = place(path)
    for name, text in (("api/1", "neu"), ("file/2", "neu"), ("_unknown/3", "neu"), ("api/1", "older attempt")):
        folder = f"{base}/{sinks.STAGED}/{writer.job}/{'0-9' if text == 'neu' else '0-8'}/{name.split('/')[0]}"
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/{name.split('/')[1]}.json") as f:
            f.write(json.dumps({"name": text}).encode())
    monkeypatch.setattr(sinks, "_place", lambda p: (Dying(store), base))
    if moved < 3:
        with pytest.raises(KeyboardInterrupt):
            writer.commit([sinks.Written({"api": 1, "file": 1, "_unknown": 1}, "0-9")])
    else:
        writer.commit([sinks.Written({"api": 1, "file": 1, "_unknown": 1}, "0-9")])
    monkeypatch.setattr(sinks, "_place", place)
    store.create_dir(f"{base}/{sinks.STAGED}/notready/1-1/api")
    assert sinks.recover(path) == (int(moved < 3), 1)
    assert {k: json.loads(v)["name"] for k, v in held(path).items()} == {"api/1.json": "neu", "file/2.json": "neu", "_unknown/3.json": "neu"}
    assert not (Path(path) / sinks.STAGED).exists() and sinks.recover(path) == (0, 0)
    assert isinstance(store, fs.FileSystem)
