"""Stored indexes against the searches that read everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brontide.operators import index, search
from tests.conftest import DATA


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choices(words, weights=[1000 / (k + 1) for k in range(60)], k=r.randrange(0, 60))), r.choice(["rare w1", "w2", None, "미세먼지 w3"])) for i in range(700)]
    return spark.createDataFrame([*rows, (700, None, None), (701, "w59 w58 w57 " * 3, "rare")], "doc_id long, text string, title string")


@pytest.mark.parametrize("block", [128, 4])
def test_bm25_over_the_index_is_bm25_over_the_texts(spark, texts, tmp_path, monkeypatch, block):
    monkeypatch.setattr(index, "BLOCK", block)
    weights = {"text": 1, "title": 3}
    said = index.build_lexical(texts, str(tmp_path / "i"), "doc_id", weights, "now", buckets=7)
    assert said["documents"] == 702 and index.manifest(spark, str(tmp_path / "i")) == said
    lexical = index.Lexical(spark, str(tmp_path / "i"))
    queries = {"a": "w0 w59", "b": "rare", "c": "w1 w2 w3 w40", "d": "미세먼지", "e": "nothing here", "f": "", "g": "w58 w0 w1 w57"}
    for k in (1, 10, 900):
        want, got = search.bm25_all(texts, queries, weights, k=k), lexical.bm25(queries, k)
        for name in queries:
            assert [tuple(r) for r in got[name].collect()] == [tuple(r) for r in want[name].collect()], (name, k)


def test_blocks_that_cannot_reach_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 8)
    rows = [(i, "common " + "filler " * (20 + i % 50)) for i in range(2000)] + [(5000 + i, "seldom seldom common") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index.build_lexical(docs, str(tmp_path / "i"), "doc_id", {"text": 1})
    lexical = index.Lexical(spark, str(tmp_path / "i"))
    held, read = lexical.blocks("seldom common", 5)
    assert read < held / 20
    want = search.bm25(docs, "seldom common", {"text": 1}, k=5).collect()
    assert lexical.bm25({"q": "seldom common"}, 5)["q"].collect() == want


def test_a_query_scans_its_buckets_and_no_text(spark, texts, tmp_path):
    index.build_lexical(texts, str(tmp_path / "i"), "doc_id", {"text": 1}, buckets=16)
    plan = index.Lexical(spark, str(tmp_path / "i")).bm25({"q": "w1"}, 5)["q"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "(bucket" in plan.split("PartitionFilters")[1][:60]
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0] and "PushedFilters" in plan


def test_counts_come_from_the_index(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    index.build_lexical(docs, str(tmp_path / "i"), "doc_id", {"text": 1})
    lexical = index.Lexical(spark, str(tmp_path / "i"))
    assert sorted(lexical.token_frequencies().collect()) == sorted(search.token_frequencies(docs).collect())
    assert sorted(lexical.term_frequencies().collect()) == sorted(search.term_frequencies(docs, "doc_id", {"text": 1}).collect())


def test_without_a_manifest_there_is_no_index(spark, texts, tmp_path):
    path = str(tmp_path / "i")
    with pytest.raises(index.NoIndex):
        index.Lexical(spark, path)
    index.build_lexical(texts, path, "doc_id", {"text": 1})
    broken = texts.select("doc_id", F.raise_error(F.lit("lost")).cast("string").alias("text"))
    with pytest.raises(Exception, match="lost"):
        index.build_lexical(broken, path, "doc_id", {"text": 1})
    with pytest.raises(index.NoIndex):  # the older manifest went first
        index.Lexical(spark, path)
    index.build_lexical(texts, path, "doc_id", {"text": 1})
    assert index.Lexical(spark, path).said["documents"] == 702


@pytest.mark.parametrize("piece", [4096, 2])
def test_vectors_of_the_index_are_those_of_the_whole_table(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(index, "PIECE", piece)
    monkeypatch.setattr(index, "ASKED", 3)
    r = np.random.default_rng(piece)
    x = np.concatenate([r.normal(c, 0.1, (60, 8)) for c in range(6)])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [None] * 8), (902, [1.0, 2.0]), (903, [0.5, 0.5])] + [(1000 + i, [float(v) for v in x[5]]) for i in range(80)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = table.filter("vec_id % 9 = 0").select(F.col("vec_id").alias("intent"), F.col("embedding").alias("query"))
    said = index.build_vectors(table, str(tmp_path / "v"), "vec_id", "embedding")
    assert said["vectors"] == len(rows) - 2
    held = index.Vectors(spark, str(tmp_path / "v"))
    for k in (1, 7):
        got = sorted(map(tuple, held.topk(queries, k, "vec_id").collect()))
        assert got == sorted(map(tuple, search.vector_topk(table, queries, k, "vec_id").select("intent", "vec_id", "similarity", "rank").collect()))
    done, every = held.compared(queries, 7)
    assert done < 0.6 * every or piece == 4096
    with pytest.raises(index.NoIndex):
        index.Vectors(spark, str(tmp_path / "w"))


def test_empty_indexes(spark, tmp_path):
    index.build_lexical(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "i"), "doc_id", {"text": 1})
    assert index.Lexical(spark, str(tmp_path / "i")).bm25({"q": "a"}, 5)["q"].count() == 0
    index.build_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>"), str(tmp_path / "v"), "vec_id", "embedding")
    queries = spark.createDataFrame([(1, [1.0])], "intent long, query array<double>")
    assert index.Vectors(spark, str(tmp_path / "v")).topk(queries, 3, "vec_id").count() == 0


def test_documents_are_counted_where_they_are_read(monkeypatch):
    """Counts and blocks of Arrow batches against plain dictionaries, across the ends of batches."""
    from collections import Counter

    import pyarrow as pa

    monkeypatch.setattr(index, "COUNTED", 3)
    monkeypatch.setattr(index, "BLOCK", 4)
    r = random.Random(3)
    docs = [(i, r.choices("abcdef", k=r.randrange(0, 9)), r.choices("cxyz", k=r.randrange(0, 3))) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array([d[k] for d in docs], t) for k, t in enumerate((pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())))], ["id", "a", "b"])
    got = [x for b in index._counts(pa.int64(), [1, 3])([batch.slice(0, 11), batch.slice(11, 0), batch.slice(11)]) for x in b.to_pylist()]
    want = {i: Counter(a) + Counter({t: 3 * n for t, n in Counter(b).items()}) for i, a, b in docs}
    assert [x["id"] for x in got] == list(range(20)) and all({t["token"]: t["tf"] for t in x["tokens"]} == want[x["id"]] and x["dl"] == want[x["id"]].total() for x in got)
    rows = sorted((t["token"], x["id"], t["tf"], x["dl"], float(t["tf"])) for x in got for t in x["tokens"])
    postings = pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int32()), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True))], ["bucket", "token", "id", "tf", "dl", "impact"])
    blocks = [x for b in index._blocks(pa.int64())([postings.slice(a, 7) for a in range(0, len(rows), 7)]) for x in b.to_pylist()]
    assert [(x["token"], *p) for x in blocks for p in zip(x["ids"], x["tfs"], x["dls"], strict=True)] == [p[:4] for p in rows]
    assert all(x["n"] == len(x["ids"]) and x["top"] == max(x["tfs"]) for x in blocks)
    df = Counter(p[0] for p in rows)
    assert Counter(x["token"] for x in blocks) == {t: -(-n // 4) for t, n in df.items()}
