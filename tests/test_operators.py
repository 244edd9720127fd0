"""Known facts and plain models of single operators."""

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brontide.functions import scalars, text
from brontide.operators import catalog, chunks, graph, html, ledger, payloads, profile, registry, relate, search
from brontide.plans import flow
from brontide.sources import files
from brontide.streaming import ledger as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, text.tokenize(F.lit("미세먼지"))) == ["미세", "세먼", "먼지"]
    assert one(spark, text.tokenize(F.lit("물 API-2 für"))) == ["api", "2", "f", "r", "물"]
    assert one(spark, text.tokenize(F.lit(None).cast("string"))) == []


def test_fusion_scores(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1), ("x", 2), ("", 3)], "id string, rank int")
    rows = search.fuse_ranks({"a": a, "b": b}, "id", 5).collect()
    assert [r["id"] for r in rows] == ["x", "y"]
    assert rows[0]["score"] == round(1 / 61 + 1 / 62, 6)


def test_overlap_confidence(spark):
    df = spark.createDataFrame([("a", "Sido"), ("b", "sido"), ("a", "pageNo"), ("b", "pageno"), ("c", "x")], "id string, p string")
    assert [tuple(r) for r in relate.parameter_overlap(df, "id", "p").collect()] == [("a", "b", 1, 0.5)]


def test_grounded(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    attacks = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    got = dict(map(tuple, graph.grounded(nodes, attacks).collect()))
    assert got == {"a": "undecided", "b": "undecided", "c": "accepted", "d": "rejected", "e": "accepted", "f": "accepted"}


def reach_of(edges, n):
    reach = {i: {i} for i in range(n)}
    for _ in range(n):
        for a, b in edges:
            for s in reach.values():
                if a in s:
                    s.add(b)
    return reach


def shortest_cycles(edges, component):
    """By breadth-first search in each component from its least node: a shortest cycle, the least of several."""
    out = {}
    for start in set(component.values()):
        paths, found = [[start]], None
        while paths and not found:
            closed = [p for p in paths if (p[-1], start) in edges]
            found = min(closed) if closed else None
            paths = [p + [b] for p in paths for a, b in edges if a == p[-1] and component.get(b) == start and b not in p]
        if found:
            out[start] = found
    return out


@pytest.mark.parametrize("seed", [5, 6, 7, 8])
def test_strong_components_and_cycles_of_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = sorted({(r.randrange(12), r.randrange(12)) for _ in range(18)})
    reach = reach_of(edges, 12)
    touched = {x for e in edges for x in e}
    want = {i: min(j for j in reach[i] if i in reach[j]) for i in touched}
    df = spark.createDataFrame(edges, "src int, dst int")
    got = graph.strong_components(df).collect()
    assert {x["node"]: x["component"] for x in got} == want
    assert all(x["size"] == list(want.values()).count(x["component"]) for x in got)
    assert {x["component"]: x["path"] for x in graph.cycles(df).collect()} == shortest_cycles(set(edges), want)
    assert graph.strong_components(df.limit(0)).count() == 0 and graph.cycles(df.limit(0)).count() == 0


def test_cycles_of_a_chain_of_diamonds(spark):
    """The shape whose paths are 2 to the power of 40: 121 nodes, no cycle; with an edge back, one of 81 nodes."""
    edges = [e for i in range(40) for e in ((3 * i, 3 * i + 1), (3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 3), (3 * i + 2, 3 * i + 3))]
    df = spark.createDataFrame(edges, "src int, dst int")
    assert graph.cycles(df).count() == 0
    back = df.unionByName(spark.createDataFrame([(120, 0)], "src int, dst int"))
    assert [(r["component"], r["size"], len(r["path"])) for r in graph.cycles(back).collect()] == [(0, 121, 81)]


def test_graphs_of_the_tables_like_brute_force(spark):
    from brontide import queries_catalog as q
    from tests.conftest import DATA

    edges = {tuple(r) for r in q._edges(spark, DATA).collect()}
    out, back = {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)

    def reached(start, near):
        seen, todo = {start}, [start]
        while todo:
            for x in near.get(todo.pop(), []):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    want = {}
    for n in sorted(set(out) | set(back)):
        if n not in want:
            want.update(dict.fromkeys(reached(n, out) & reached(n, back), n))
    assert {r["node"]: r["component"] for r in graph.strong_components(q._edges(spark, DATA)).collect()} == want
    nodes = [r["node"] for r in q._nodes(spark, DATA).collect()]
    label = {}
    while True:
        new = {n: "accepted" if all(label.get(a) == "rejected" for a in back.get(n, [])) else "rejected" if any(label.get(a) == "accepted" for a in back.get(n, [])) else None for n in nodes}
        new = {k: v for k, v in new.items() if v}
        if new == label:
            break
        label = new
    assert dict(map(tuple, q.grounded_labels(spark, DATA).collect())) == {n: label.get(n, "undecided") for n in nodes}


def test_quantiles_like_numpy(spark):
    r = np.random.default_rng(1)
    columns = {"a": r.normal(size=501), "b": r.integers(0, 5, 400).astype(float), "c": np.array([7.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in columns.items() for x in v], "column string, x double")
    for row in profile.quantiles(df.repartition(7), {"q1": 0.25, "m": 0.5, "p": 0.9}).collect():
        v = columns[row["column"]]
        assert row["n"] == len(v) and np.allclose([row["q1"], row["m"], row["p"]], np.quantile(v, [0.25, 0.5, 0.9]))


def test_pairs_in_blocks_are_the_pairs(spark):
    r = random.Random(2)
    rows = sorted({(i, r.choice("xxxxy")) for i in range(60)})
    df = spark.createDataFrame(rows, "id int, key string")
    want = sorted((k, a, b) for a, k in rows for b, j in rows if j == k)
    for block in (7, 4096):
        assert sorted(map(tuple, relate._pairs(df, df, block).collect())) == want


def test_vectors_in_blocks_of_queries(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=5).round(1).tolist() if i % 9 else None) for i in range(80)] + [(99, [1.0, 2.0]), (98, [None, 1.0, 1.0, 1.0, 1.0])]
    chunks = spark.createDataFrame(rows, "id int, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i}", r.normal(size=5).round(1).tolist()) for i in range(7)] + [("none", None)], "intent string, query array<double>")
    want = sorted((q["intent"], i, k) for q in asked.collect() if q["query"] for k, (_, i) in enumerate(sorted((-round(float(np.dot(v, q["query"])), 9), i) for i, v in rows if v and len(v) == 5 and None not in v)[:6], 1))
    for block in (2, 4096):
        assert sorted((x["intent"], x["id"], x["rank"]) for x in search.vector_topk(chunks, asked, 6, "id", block=block).collect()) == want


def test_hybrid_with_one_channel_or_none(spark):
    one = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2)], "id string, score double, rank int")
    none = one.limit(0)
    for v, x in ((one, none), (none, one)):
        assert [r["id"] for r in search.hybrid(v, x, "id", 5).collect()] == ["a", "b"]
    assert search.hybrid(one, one, "id", 5).first()["match_channels"] == ["vector", "lexical"]
    assert search.hybrid(none, none, "id", 5).count() == 0


def test_bm25_reads_and_tokenises_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = search.bm25(docs, "ering thst", {"text": 1})._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and plan.count("written-") > 0
    assert search.bm25(docs, "...", {"text": 1}).count() == 0


def test_levels_with_a_cycle(spark):
    nodes = spark.range(5).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (4, 3)], "src long, dst long")
    assert dict(map(tuple, graph.dag_levels(nodes, edges).collect())) == {0: 0, 1: 1, 2: 2, 3: None, 4: None}


def test_quality_facts(spark):
    rows = [(1, "kr", "1"), (2, "kr", "2"), (2, "kr", "2"), (3, "jp", "3"), (4, "", "4"), (5, "us", "200")]
    df = spark.createDataFrame(rows, "id int, region string, value string")
    assert tuple(profile.dataset_quality(df, ["id", "region", "value"]).first()) == (6, 1, 1)
    out = profile.iqr_outliers(profile.cells(df, ["value"], F.col("id")))
    assert [r["numeric_value"] for r in out.collect()] == [200.0]


def test_encodings():
    assert files.decode("지역".encode("cp949"))[1:] == ("euc-kr", True)
    assert files.headers(["a", "a", " "]) == ["a", "a_2", "column_3"]


def test_flow_order_and_errors(spark):
    nodes = [{"id": "a", "type": "apiDoc", "data": {"apiId": 1}}, {"id": "b", "type": "summaryNode"}, {"id": "c", "type": "mergeNode"}]
    docs = spark.createDataFrame([(1, "x")], "apiId int, name string")
    out = flow.compile_flow(docs, nodes, [{"source": "a", "target": "c"}])
    assert out["b"].status == "error" and out["c"].docs.count() == 1
    assert flow.order_nodes(nodes, [{"source": "c", "target": "a"}, {"source": "a", "target": "c"}]) == ["a", "b", "c"]
    with pytest.raises(flow.FlowError):
        flow.check_flow({"version": 1, "nodes": [{"id": "a", "type": "apiDoc"}, {"id": "a", "type": "apiDoc"}]})


def test_stream_to_ledger(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.select("event_id", "ts", "event_type").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz, event_type string").parquet(str(tmp_path / "in"))
    streams.append_only(streams.first_requests(stream, "event_type", "ts", "365 days"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_transitions_table_is_closed():
    assert {t for v in ledger.TRANSITIONS.values() for t in v} <= set(ledger.TRANSITIONS)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.,+-eEx ", max_size=8), min_size=1, max_size=20))
def test_numbers_like_python(spark, cells):
    got = [r["x"] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i").select(scalars.number(F.col("c")).alias("x")).collect()]
    for c, x in zip(cells, got, strict=True):
        try:
            want = float(c.replace(",", "").strip())
            want = want if math.isfinite(want) else None
        except ValueError:
            want = None
        assert x == want


def test_json_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, body in (("a/1_x.json", '{"api_id": "1"}'), ("a/1_y.json", '{"api_id": "1", "n": 2}'), ("2.json", "[1]"), ("3.json", '{"x": 1}'), ("4.json", "{oops")):
        (tmp_path / name).write_text(body)
    rows = files.read_json_documents(spark, str(tmp_path), T.StructType([T.StructField("api_id", T.StringType()), T.StructField("n", T.IntegerType())]))
    assert sorted((r["api_id"], r["n"] or 0) for r in rows.collect()) == [("1", 0), ("1", 2)]
    assert dict(map(tuple, files.skip_reasons(spark, str(tmp_path)).collect())) == {"ok": 3, "not_an_object": 1, "invalid_json": 1}
    assert {r["path"].rsplit("/", 1)[1] for r in files.newest_per_id(rows.select(F.col("file").alias("path"))).collect()} == {"1_y.json"}
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), T.StructType([T.StructField("a", T.StringType())])).count() == 0


def test_split_sink_refuses_an_empty_target(spark, tmp_path):
    df = spark.createDataFrame([("API",), ("FILE",), ("x",)], "kind string")
    for targets, fine in ((["API", "FILE"], True), (["API", "STD"], False)):
        counts = catalog.split_by_type(df, F.col("kind"), targets)
        out = str(tmp_path / "-".join(targets))
        if fine:
            files.write_split(df, F.col("kind"), targets, out, counts)
            assert spark.read.parquet(out).count() == 2
        else:
            with pytest.raises(ValueError):
                files.write_split(df, F.col("kind"), targets, out, counts)


def test_chunks_and_index(spark, tmp_path):
    assert chunks.pack(["a" * 10, "b" * 10, "c" * 25], 21) == ["a" * 10 + "\n" + "b" * 10, "c" * 21, "c" * 4]
    assert [k for k, _ in chunks.chunks_of("[제목] x", "d", ["- GET /a"], ["f : 뜻"])] == ["overview", "endpoints", "response_fields"]
    docs = spark.createDataFrame([("1", "x", "long " * 400, ["- GET /a"])], "id string, title string, note string, ends array<string>")
    none = F.array().cast("array<string>")
    made = chunks.build_index(docs, str(tmp_path / "index"), "2024-01-01", "id", identity=chunks.identity_header(F.col("title"), F.lit(""), F.lit(""), F.lit("")), description=F.col("note"), endpoints=F.col("ends"), fields=none)
    assert made.count() == 5
    assert spark.read.json(str(tmp_path / "index/manifest")).first()["chunks"] == 5


def test_files_that_can_not_be_read_fail_nothing(spark):
    bodies = {"a.json": b"{oops", "b.json": b"[1,2]", "c.csv": b"a,b\n1," + b"x" * 140_000, "d.json": b'{"a":1}', "e.csv": b"\xff\xfa,\n1", "f.csv": b"", "g.zip": b"PK", "h.json": b"[" * 100_000, "i.csv": None}
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in bodies.items()], "path string, content binary")
    got = {r["path"]: r for r in files.table_status(df).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a.json": "error", "b.json": "unsupported", "c.csv": "ok", "d.json": "ok", "e.csv": "unverified", "f.csv": "unsupported", "g.zip": "unsupported", "h.json": "error", "i.csv": "unsupported"}
    cells = [tuple(r)[:3] for r in files.read_cells(df).collect()]
    assert ("c.csv", 0, "b") in cells and ("d.json", 0, "a") in cells and not any(p in ("a.json", "h.json") for p, _, _ in cells)


def test_catalog_csv_encodings_in_order(spark):
    text = "목록키,이름\n15000001,대기질\nx,없음\n"
    bodies = {"kr.csv": text.encode("euc-kr"), "bom.csv": b"\xef\xbb\xbf" + "목록키,이름\n15000002,똠방각하\n".encode(), "none.csv": b"a,b\nx,y\n", "blank.csv": b""}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in bodies.items()], "path string, content binary")
    got = {r["path"]: (r["encoding"], r["number"]) for r in files.catalog_rows(df).collect()}
    assert got["kr.csv"] == ("euc-kr", 15000001) and got["bom.csv"][1] == 15000002 and set(got) == {"kr.csv", "bom.csv"}


def test_json_beyond_the_grammar():
    assert html.repaired_json('{"description": "he said "a", b and "c" d", "name": "n",}') == {"description": 'he said "a", b and "c" d', "name": "n"}
    assert html.repaired_json('<![CDATA[{"a": "one\ntwo", "k": ["x" y", "z"], "n": 1}]]>') == {"a": "one\ntwo", "k": ['x" y', "z"], "n": 1}
    assert html.repaired_json("{&quot;a&quot;: 1}") == {"a": 1} and html.repaired_json("{a}") is None and html.repaired_json("") is None
    page = "".join(f'<script type="application/ld+json">{{"@type": "{t}", "name": "{t}"}}</script>' for t in ("Dataset", "https://schema.org/Dataset/", "NotADataset", "DataCatalog"))
    assert [d["name"] for d in html.datasets(html.parse(page))] == ["Dataset", "https://schema.org/Dataset/"]


def test_pages_titles_and_texts(spark):
    page = "<html><head><title> A\n B </title><style>x</style></head><body><p>One <b>two</b></p><script>no</script> three</body></html>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string")
    rows = df.select("id", html.read_html(F.col("html"), "title").alias("t"), html.read_html(F.col("html"), "text").alias("x")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "A B", "A B One two three"), (2, "", ""), (3, "", "")]


def test_grid_in_its_place():
    page = "<table><tr><th>no</th></tr><tr><td>no</td></tr></table><div id='tab-layer-2'><table><tr><th>k</th></tr><tr><td><a href='/1'>a</a><a href='/2'></a></td><td>more</td></tr></table></div>"
    assert html.grid(html.parse(page)) == [{"k_link": "/2", "k": "a", "column_1": "more"}]
    assert html.grid(html.parse("<table><tr><td>x</td></tr></table>"), anywhere=False) == []


def test_intents_of_a_query(spark):
    for q, want in (("미세먼지 및 날씨", ["미세먼지 및 날씨", "미세먼지", "날씨"]), ("병원과 약국 위치, 주차장", ["병원과 약국 위치, 주차장", "병원", "약국 위치", "주차장"]), ("날씨", ["날씨"]), (" ", []), (None, [])):
        assert one(spark, text.intents(F.lit(q).cast("string"))) == want


def test_steps_of_a_law(spark):
    law = "제1조(협의) 사업자는 평가서를 30일 이내 협의기관에 제출하여야 한다. 협의기관은 보완을 요청할 수 있다. 제2조(공고) 승인기관은 그 내용을 지체 없이 공고하여야 한다."
    steps = one(spark, registry.law_steps(F.lit(law)))
    assert [(s["article"], s["action"], s["type"]) for s in steps] == [("제1조(협의)", "제출", "task"), ("제1조(협의)", "요청", "task"), ("제2조(공고)", "공고", "notice")]
    assert steps[0]["deadline"] == "30일이내" and all(0.35 <= s["confidence"] <= 0.95 for s in steps)
    assert one(spark, registry.law_steps(F.lit(None).cast("string"))) == []


def test_payloads_at_every_depth(spark):
    deep = json.dumps({"a": [{"b": {"c": ["ok", "rm -rf x; y"]}}]})
    rows = spark.createDataFrame([(deep,), ('{"a": "fine"}',), ("http://x",), ("fine",), (None,)], "p string").select(payloads.unsafe_json(F.col("p")).alias("u"), payloads.mask_json(F.col("p")).alias("m")).collect()
    assert [r["u"] for r in rows] == [True, False, True, False, None]
    assert [r["m"] is None for r in rows] == [False, False, True, True, True]


def test_exports_stand_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f'v,"{i}"', None) for i in range(50)], "id int, name string, note string").repartition(5)
    for fmt in ("csv", "html"):
        files.export_file(df, ["id", "name", "note"], "id", str(tmp_path / fmt), fmt)
        whole = b"".join(p.read_bytes() for p in sorted((tmp_path / fmt).glob("part-*"))).decode()
        if fmt == "csv":
            lines = whole.split("\r\n")
            assert lines[0] == "\ufeffid,name,note" and lines[1] == '0,"v,""0""",' and len(lines) == 52
        else:
            assert whole.startswith("<html>") and whole.endswith("</html>\n") and whole.count("<tr>") == 51 and whole.index(">v,&quot;3&quot;<") < whole.index(">v,&quot;4&quot;<")


def test_documents_of_one_type_leave_the_others(spark, tmp_path):
    path = str(tmp_path / "docs")
    files.write_documents(spark.createDataFrame([("a", 1), ("b", 2)], "api_type string, n int"), path)
    files.write_documents(spark.createDataFrame([("a", 3)], "api_type string, n int"), path)
    assert sorted(map(tuple, spark.read.json(path).select("api_type", "n").collect())) == [("a", 3), ("b", 2)]


def test_exported_flow_is_read_back(spark):
    selected = spark.createDataFrame([(1, 1, "s:10", "A"), (1, 2, "s:11", "B")], "run int, at int, id string, title string")
    rel = spark.createDataFrame([(1, "s:10", "s:11", "io-chain", "why"), (1, "s:10", "s:99", "io-chain", "lost")], "run int, source string, target string, type string, note string")
    runs = spark.createDataFrame([(1, "question", ["w"]), (2, "", [])], "run int, query string, warnings array<string>")
    got = {r["run"]: json.loads(r["flow"]) for r in flow.flow_json(selected, rel, runs, "flow", "2024-01-01T00:00:00Z").collect()}
    nodes, edges = flow.check_flow(got[1], "flow")
    assert [n["data"]["apiId"] for n in nodes] == ["10", "11"] and [e["id"] for e in edges] == ["rel:io-chain:s:10:s:11"]
    assert nodes[0]["data"]["relationNotes"] == ["why"] and "warnings: w" in nodes[0]["data"]["selectionNote"]
    assert (got[2]["nodes"], got[2]["edges"], got[2]["name"]) == ([], [], "untitled")


def test_ten_tables_and_documents_that_only_the_small_file_has(spark, tmp_path):
    for folder, name, lines in (("catalog", "services", ['{"service_id": "openapi_new:1", "name": "old"}', ""]), ("catalog", "documents", ['{"document_id": "d", "service_id": "openapi_new:1", "title": "t", "body": "b"}'])):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.jsonl").write_text("\n".join(lines))
    (tmp_path / "minimal.jsonl").write_text("\n".join(json.dumps({"api_id": i, "title": f"t{i}", "text": "x", "provider": "p"}) for i in ("1", "2", "2", None)))
    schemas = {t: T.StructType([T.StructField(c, T.StringType()) for c in {"services": ("service_id", "name", "provider"), "documents": ("document_id", "service_id", "title", "body")}.get(t, ("service_id",))]) for ts in files.CATALOG_TABLES.values() for t in ts}
    tables = files.load_catalog(spark, str(tmp_path), schemas, str(tmp_path / "minimal.jsonl"))
    assert len(tables) == 10 and tables["concepts"].count() == 0
    assert sorted((r["service_id"], r["name"]) for r in tables["services"].collect()) == [("openapi_new:1", "old"), ("openapi_new:2", "t2")]
    assert sorted(r["document_id"] for r in tables["documents"].collect()) == ["d", "doc:openapi_new:2:overview"]


def test_scan_sinks(spark, tmp_path):
    df = spark.createDataFrame([("success", "API", 1), ("success", "FILE", 2), ("error", "API", 3), (None, "API", 4)], "status string, kind string, number int")
    files.write_scan(df, str(tmp_path / "scan"))
    assert spark.read.json(str(tmp_path / "scan/failures")).count() == 2
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "scan/numbers")).select("kind", "number").collect())) == [("API", 1), ("FILE", 2)]
    assert {(r["status"], r["kind"], r["n"]) for r in spark.read.json(str(tmp_path / "scan/summary")).select("status", "kind", "n").collect()} == {("success", "API", 1), ("success", "FILE", 1), ("error", "API", 1), (None, "API", 1)}


def test_blocking_runs_down_the_plan(spark):
    steps = spark.createDataFrame([(c, "failed" if c == "b" else "succeeded") for c in "abcdefgh"], "node string, status string")
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d"), ("a", "e"), ("f", "g"), ("g", "f"), ("zz", "h")], "src string, dst string")
    got = {r["node"]: (r["level"], r["state"]) for r in graph.run_order(steps, edges).collect()}
    assert got == {"a": (0, "succeeded"), "b": (0, "failed"), "c": (1, "blocked"), "d": (2, "blocked"), "e": (1, "succeeded"), "f": (None, "blocked"), "g": (None, "blocked"), "h": (0, "blocked")}


def test_every_kind_of_node(spark):
    docs = spark.createDataFrame([(i, f"air {i}", "env" if i % 2 else "road", "env - air", "air", "", float(i)) for i in range(8)], "apiId int, name string, provider string, category string, keywords string, description string, searchScore double")
    nodes = [{"id": "s", "type": "apiSearch", "data": {"query": "air", "maxResults": 6}}, {"id": "c", "type": "categoryFilter", "data": {"category": "AIR"}}, {"id": "p", "type": "providerFilter", "data": {"provider": "env"}}, {"id": "t", "type": "scoreFilter", "data": {"topK": 2}}, {"id": "m", "type": "mergeNode"}, {"id": "r", "type": "ragChat"}, {"id": "h", "type": "chatOutput"}, {"id": "v", "type": "saveNode"}, {"id": "x", "type": "exportNode", "data": {"filename": "a b", "format": "csv"}}, {"id": "u", "type": "summaryNode"}]
    edges = [{"source": a, "target": b} for a, b in ("sc", "cp", "pt", "tm", "mr", "rh", "mv", "mx", "mu")]
    out = flow.compile_flow(docs, nodes, edges)
    assert [out[k].status for k in "scptmrhvxu"] == ["success"] * 9 + ["error"]
    assert out["x"].note == "a_b.csv" and out["p"].docs.count() == 3 and out["t"].docs.count() == 2 and {r["provider"] for r in out["m"].docs.collect()} == {"env"}
    assert set(flow.compile_flow(docs, nodes, edges, "p")) == {"s", "c", "p"} == flow.upstream("p", edges)
    stored = flow.serialised([{"id": "s", "type": "apiSearch", "position": {"x": 3, "y": float("nan")}, "data": {"query": "q", "result": [1], "f": print}}], [{"source": "s", "target": "gone"}], "", "f", "2024")
    assert flow.check_flow(json.loads(json.dumps(stored)), "f") == ([{"id": "s", "type": "apiSearch", "position": {"x": 3.0, "y": 0.0}, "data": {"query": "q"}}], [])


def test_prompt_of_a_selection(spark):
    doc = "named_struct('name', 'A', 'provider', 'p', 'category', 'c', 'keywords', array('k', 'l'), 'description', '', 'fields', transform(sequence(1, 20), i -> named_struct('key', concat('f', i), 'desc', 'd')), 'endpoints', cast(array() as array<struct<method:string,path:string,description:string>>))"
    p = one(spark, text.analysis_prompt(F.array(F.expr(doc)), F.lit("왜?")))
    lines = p.split("\n")
    assert lines[0] == text.PROMPT_HEAD and lines[1] == "사용자 질문: 왜?" and lines[3] == "API 1. A" and "- f12: d" in lines and "- f13: d" not in lines and "- 엔드포인트 정보 없음" in lines and "키워드: k, l" in lines and lines[-1] == text.PROMPT_TAIL[-1]


def test_small_tables_of_long_work_are_many_tasks(spark):
    """A page of each part and a law of each customer are made in tasks of a bounded number of rows, however few bytes the tables have."""
    from brontide.sources import stored

    df = spark.range(0, 10_000, 1, 1)
    assert stored.spread(df, "id").rdd.getNumPartitions() == 3 and stored.spread(df, "id").count() == 10_000
    assert stored.spread(df.limit(10), "id").rdd.getNumPartitions() == 1


def test_readings_of_one_parse(spark):
    page = F.lit("<title>a</title><meta name=k content=v>")
    assert one(spark, html.read_html(page, "title", "metadata")).asDict() == {"title": "a", "metadata": {"k": "v"}}


def test_products_are_held_a_part_at_a_time(spark, monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    r = np.random.default_rng(0)
    vectors, asked = r.normal(size=(50, 4)), r.normal(size=(30, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(vectors.tolist())], ["id", "vector"])
    rows = lambda: sorted(tuple(x.values()) for b in search._products(SimpleNamespace(value=list(enumerate(asked.tolist()))), 3)([batch]) for x in b.to_pylist())
    whole = rows()
    held = []
    part = np.partition
    monkeypatch.setattr(search, "MOST_PRODUCTS", 200)
    monkeypatch.setattr(np, "partition", lambda x, *a, **k: held.append(x.size) or part(x, *a, **k))
    assert rows() == whole and len(whole) == 90 and max(held) <= 200


def test_chunks_of_a_batch_are_made_a_part_at_a_time(spark, monkeypatch):
    docs = spark.range(0, 700, 1, 1).withColumn("t", F.lit("x" * 700))
    none = F.array().cast("array<string>")
    assert chunks.search_chunks(docs, "id", F.lit("i"), F.col("t"), none, none).groupBy("id").count().filter("count = 2").count() == 700
    assert chunks.DOCUMENTS < 700


def test_chunks_go_to_the_end_of_a_text(spark, monkeypatch):
    words = [f"w{i}" for i in range(5000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "short")], "id bigint, t string")
    none = F.array().cast("array<string>")
    monkeypatch.setattr(chunks, "CHUNKS", 7)
    got = sorted(map(tuple, chunks.search_chunks(docs, "id", F.lit(""), F.col("t"), F.array(F.lit("- GET /a")), none).collect()))
    assert [r[:3] for r in got if r[0] == 2] == [(2, 0, "overview"), (2, 1, "endpoints")]
    mine = [r for r in got if r[0] == 1]
    assert [r[1] for r in mine] == list(range(len(mine))) and len(mine) > 12
    assert "".join(r[3].removeprefix("[설명]\n") for r in mine if r[2] == "overview").replace(" ", "") == "".join(words)
    assert len(chunks.chunks_of("", None, ["e" * 600] * 20, ["f" * 600] * 30)) == 50
