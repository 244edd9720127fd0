"""Workflow graphs compiled to DataFrames: a node becomes a lazy plan over the plans of its inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brontide.functions.text import export_filename
from brontide.operators.catalog import first_per_key
from brontide.operators.search import tiered_search

#: The format's version and kinds of nodes.
VERSION = 1
KINDS = ("apiSearch", "apiDoc", "categoryFilter", "providerFilter", "scoreFilter", "mergeNode", "ragChat", "chatOutput", "saveNode", "exportNode", "summaryNode")
#: Fields that search weighs.
FIELDS = {"name": 5, "keywords": 4, "category": 3, "provider": 2, "description": 2}


@dataclass
class Result:
    status: str
    kind: str
    docs: DataFrame | None = None
    note: str = ""


class FlowError(ValueError):
    pass


def check_flow(flow: dict, name: str | None = None) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of a serialised flow; edges with an unknown end are dropped, everything else must be right.

    name: the format that the flow must declare, if any.
    """
    if name is not None and flow.get("format") != name:
        raise FlowError(f"unknown format: {flow.get('format')}")
    if flow.get("version") != VERSION:
        raise FlowError(f"version {flow.get('version')} is not supported")
    if not isinstance(flow.get("nodes"), list):
        raise FlowError("no list of nodes")
    seen: set[str] = set()
    for n in flow["nodes"]:
        id_, kind = str(n.get("id") or ""), n.get("type")
        if not id_ or id_ in seen:
            raise FlowError(f"node id {id_!r} is missing or repeated")
        if kind not in KINDS:
            raise FlowError(f"unknown kind of node: {kind}")
        seen.add(id_)
    return flow["nodes"], [e for e in flow.get("edges") or [] if e.get("source") in seen and e.get("target") in seen]


#: What a node's data holds only while it runs.
RUNTIME = ("status", "result", "error", "docs", "onChange", "onRun", "isRunning")


def serialised(nodes: list[dict], edges: list[dict], name: str, fmt: str, exported_at: str, runtime: tuple[str, ...] = RUNTIME) -> dict:
    """A flow as it is stored: positions that are numbers, no runtime data, no edge with an unknown end.  check_flow reads it."""
    ids = {n["id"] for n in nodes}
    at = lambda p, k: float(v) if isinstance(v := (p or {}).get(k), (int, float)) and v == v and abs(v) != float("inf") else 0.0
    kept = [{"id": str(n["id"]), "type": str(n["type"]), "position": {k: at(n.get("position"), k) for k in "xy"}, "data": {k: v for k, v in (n.get("data") or {}).items() if k not in runtime and not callable(v)}} for n in nodes]
    handles = lambda e: {k: e[k] for k in ("sourceHandle", "targetHandle") if e.get(k)}
    good = [{"id": str(e.get("id") or f"{e['source']}->{e['target']}"), "source": str(e["source"]), "target": str(e["target"]), **handles(e)} for e in edges if e.get("source") in ids and e.get("target") in ids]
    return {"format": fmt, "version": VERSION, "name": name or "untitled", "exported_at": exported_at, "nodes": kept, "edges": good}


def order_nodes(nodes: list[dict], edges: list[dict]) -> list[str]:
    """Ids so that inputs come first, ready nodes in the order they become ready; the given order if there is a cycle."""
    ids = [n["id"] for n in nodes]
    waits = {i: 0 for i in ids}
    feeds: dict[str, list[str]] = {i: [] for i in ids}
    for e in edges:
        if e["source"] in feeds and e["target"] in waits:
            waits[e["target"]] += 1
            feeds[e["source"]].append(e["target"])
    out = [i for i in ids if not waits[i]]
    for i in out:
        for t in feeds[i]:
            waits[t] -= 1
            if not waits[t]:
                out.append(t)
    return out if len(out) == len(ids) else ids


def upstream(target: str, edges: list[dict]) -> set[str]:
    """The nodes that target depends on, itself included."""
    seen, todo = set(), [target]
    while todo:
        if (i := todo.pop()) not in seen:
            seen.add(i)
            todo += [e["source"] for e in edges if e["target"] == i]
    return seen


def inputs_of(node: str, edges: list[dict], done: dict[str, Result]) -> DataFrame | None:
    """The documents of all inputs in the order of edges, the first of each id."""
    parts = [done[e["source"]].docs for e in edges if e["target"] == node and e["source"] in done and done[e["source"]].docs is not None]
    if not parts:
        return None
    tagged = [p.withColumn("ordinal", F.struct(F.lit(i).alias("part"), F.col("ordinal.at").alias("at"))) for i, p in enumerate(parts)]
    rows = first_per_key(reduce(DataFrame.unionByName, tagged), ["apiId"], "ordinal")
    return rows


def _numbered(df: DataFrame, at) -> DataFrame:
    return df.withColumn("ordinal", F.struct(F.lit(0).alias("part"), at.cast("double").alias("at")))


def _search(docs: DataFrame, node: dict, _: DataFrame | None) -> Result:
    data = node.get("data", {})
    hits = tiered_search(docs, data.get("query", ""), FIELDS, "apiId", "name", int(data.get("maxResults") or 10))
    found = docs.drop("searchScore").join(F.broadcast(hits), "apiId")
    return Result("success", "apiDocs", _numbered(found.withColumn("searchScore", F.col("score")), F.col("tier") * 1e6 - F.col("score")).drop("tier", "score"))


def _doc(docs: DataFrame, node: dict, _: DataFrame | None) -> Result:
    found = docs.filter(F.col("apiId") == node.get("data", {}).get("apiId"))
    return Result("success", "apiDocs", _numbered(found, F.lit(0)))


def filter_category(docs: DataFrame, category: str | None, strict: bool = False) -> DataFrame:
    """Documents of which one of five fields contains (or, strictly, is) the category; all for a blank one."""
    needle = (category or "").strip().lower()
    if not needle:
        return docs
    fields = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("topCategory", "category", "keywords", "name", "description") if c in docs.columns]
    return docs.filter(reduce(lambda a, b: a | b, ((f == needle) if strict else F.contains(f, F.lit(needle)) for f in fields)))


def filter_provider(docs: DataFrame, provider: str | None) -> DataFrame:
    needle = (provider or "").strip().lower()
    return docs.filter(F.contains(F.lower(F.coalesce("provider", F.lit(""))), F.lit(needle))) if needle else docs


def top_by_score(docs: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """The k documents of the highest score, at least `least` if given; ties by name, then by id."""
    score = F.coalesce("searchScore", F.lit(0.0))
    rows = docs if least is None else docs.filter(score >= least)
    return rows.orderBy(score.desc(), "name", "apiId").limit(max(1, int(k or 10)))


def _category(docs, node, inputs):
    return Result("success", "apiDocs", filter_category(inputs, node["data"].get("category"), bool(node["data"].get("strict"))))


def _provider(docs, node, inputs):
    return Result("success", "apiDocs", filter_provider(inputs, node["data"].get("provider")))


def _score(docs, node, inputs):
    top = top_by_score(inputs, node["data"].get("topK"), node["data"].get("minScore"))
    return Result("success", "apiDocs", _numbered(top, -F.coalesce("searchScore", F.lit(0.0))))


def _pass(kind: str) -> Callable:
    return lambda docs, node, inputs: Result("success", kind, inputs)


def _export(docs, node, inputs):
    data = node.get("data", {})
    name = inputs.sparkSession.range(1).select(export_filename(F.lit(data.get("filename")), data.get("format"))).first()[0]
    return Result("success", "export", inputs, name)


#: One function per kind of node; a kind without one runs to the status error.
EXECUTORS: dict[str, Callable[[DataFrame, dict, DataFrame | None], Result]] = {
    "apiSearch": _search,
    "apiDoc": _doc,
    "categoryFilter": _category,
    "providerFilter": _provider,
    "scoreFilter": _score,
    "mergeNode": _pass("mergedContext"),
    "ragChat": _pass("analysisPrompt"),
    "chatOutput": _pass("chatContext"),
    "saveNode": _pass("saveRequest"),
    "exportNode": _export,
}


def compile_flow(docs: DataFrame, nodes: list[dict], edges: list[dict], target: str | None = None, given: dict[str, DataFrame] | None = None) -> dict[str, Result]:
    """A lazy result for each node, or for those that target needs; nothing runs until a result is read.

    given: documents that nodes have from elsewhere, by node id; such a node isn't run.
    """
    need = upstream(target, edges) if target else {n["id"] for n in nodes}
    by_id = {n["id"]: n for n in nodes}
    done: dict[str, Result] = {}
    for i in order_nodes(nodes, edges):
        if i not in need:
            continue
        if i in (given or {}):
            done[i] = Result("success", "apiDocs", _numbered(given[i], F.lit(0)))
            continue
        node = {"data": {}, **by_id[i]}
        run = EXECUTORS.get(node["type"])
        source = node["type"] in ("apiSearch", "apiDoc")
        inputs = None if source else inputs_of(i, edges, done)
        if run is None:
            done[i] = Result("error", "unsupported", None, f"nodes of kind {node['type']} don't run")
        elif inputs is None and not source:
            done[i] = Result("error", node["type"], None, "no input")
        else:
            done[i] = run(docs, node, inputs)
    return done


def merged_field_keys(docs: DataFrame, fields: str, ordinal: str) -> DataFrame:
    """(at, pos, key): the distinct field keys over all documents and where each first appears; a row each, so no row holds them all."""
    keys = docs.select(F.col(ordinal).alias("at"), F.posexplode(fields).alias("pos", "key"))
    return keys.groupBy("key").agg(F.min(F.struct("at", "pos")).alias("first")).select("first.at", "first.pos", "key")


def layout(nodes: DataFrame, ordinal: str, columns: int = 3, width: int = 320, height: int = 220, origin: tuple[int, int] = (0, 0)) -> DataFrame:
    """nodes with x and y on a grid by ordinal."""
    return nodes.withColumn("x", origin[0] + (F.col(ordinal) % columns) * width).withColumn("y", origin[1] + F.floor(F.col(ordinal) / columns) * height)


#: Strokes of a suggested and of an approved relation on the canvas.
SUGGESTED, APPROVED = "#f59e0b", "#475569"


#: Relations that one task puts in order.
TASK_RELATIONS = 1 << 20


def within_selection(relations: DataFrame, selected: DataFrame, group: str = "run") -> DataFrame:
    """relations (run, source, target, ...) with both ends among selected (run, id).

    They are shuffled once, by run; what is grouped by run or by its ids afterwards
    needs no shuffle more.
    """
    ids = selected.select(group, F.col("id").alias("source"), F.col("id").alias("target"), F.lit(True).alias("_is_id")).distinct()
    rows = relations.withColumn("_is_id", F.lit(False)).unionByName(ids, allowMissingColumns=True).dropna(subset=[group, "source", "target"])
    tasks = max(int(relations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-relations.count() // TASK_RELATIONS))
    known = lambda end: F.max("_is_id").over(Window.partitionBy(group, end))
    rows = rows.repartition(tasks, group).withColumn("_from", known("source")).withColumn("_to", known("target"))
    return rows.filter("_from and _to and not _is_id").select(*relations.columns)


def flow_json(selected: DataFrame, relations: DataFrame, runs: DataFrame, fmt: str, exported_at: str, name_most: int = 60) -> DataFrame:
    """(run, flow): each run's result as a flow's JSON text, that check_flow reads back.

    selected: (run, at, id, title), in order of at; relations: (run, source,
    target, type, note); runs: (run, query, warnings).  A node stands on the grid
    and carries the run's note and the notes of its own relations; edges are the
    relations between selected documents.  Runs without a selection have empty
    lists.
    """
    rel = within_selection(relations, selected)
    ends = rel.select("run", F.explode(F.array("source", "target")).alias("id"), "source", "target", "note")
    notes = ends.groupBy("run", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("source", "target", "note"))), lambda x: x["note"]).alias("notes"))
    said = F.concat(F.lit("question: "), F.col("query"), F.when(F.size("warnings") > 0, F.concat(F.lit(" · warnings: "), F.array_join("warnings", " / "))).otherwise(""))
    placed = layout(selected.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy("at", "id")) - 1), "place", 3, 320, 220, (80, 80))
    j = placed.join(notes, ["run", "id"], "left").join(runs.select("run", said.alias("said")), "run")
    none = F.array().cast("array<string>")
    node = F.struct(F.col("id"), F.lit("apiDoc").alias("type"), F.struct("x", "y").alias("position"), F.struct(F.regexp_replace("id", "^[^:]*:", "").alias("apiId"), "title", F.col("said").alias("selectionNote"), F.coalesce("notes", none).alias("relationNotes")).alias("data"))
    nodes = j.groupBy("run").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", node.alias("node")))), lambda x: x["node"]).alias("nodes"))
    edges = rel.groupBy("run").agg(F.sort_array(F.collect_set(F.struct(F.concat_ws(":", F.lit("rel"), "type", "source", "target").alias("id"), "source", "target"))).alias("edges"))
    title = F.when(F.trim("query") != "", F.substring(F.trim("query"), 1, name_most)).otherwise("untitled")
    whole = runs.select("run", title.alias("name")).join(nodes, "run", "left").join(edges, "run", "left")
    text = F.to_json(F.struct(F.lit(fmt).alias("format"), F.lit(VERSION).alias("version"), "name", F.lit(exported_at).alias("exported_at"), F.coalesce("nodes", F.expr("array()").cast(nodes.schema["nodes"].dataType)).alias("nodes"), F.coalesce("edges", F.expr("array()").cast(edges.schema["edges"].dataType)).alias("edges")))
    return whole.select("run", text.alias("flow"))


def canvas_edges(nodes: DataFrame, relations: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """(id, source, target, label, status, animated, stroke): relations between nodes (node, service), as edges of the canvas.

    relations: (id, source, target, type) between services.  approved: (id) of
    edges that a person has approved; these stand still and change their stroke.
    """
    at = lambda end: nodes.select(F.col("service").alias(end), F.col("node").alias(f"{end}_node"))
    e = relations.join(at("source"), "source").join(at("target"), "target")
    e = e.select(F.concat(F.lit("rel-"), F.col("id")).alias("id"), F.col("source_node").alias("source"), F.col("target_node").alias("target"), F.col("type").alias("label"))
    yes = (e.select("id").limit(0) if approved is None else approved.select("id").distinct()).withColumn("yes", F.lit(True))
    ok = F.coalesce("yes", F.lit(False))
    return e.join(yes, "id", "left").select("id", "source", "target", "label", F.when(ok, "approved").otherwise("derived").alias("status"), (~ok).alias("animated"), F.when(ok, APPROVED).otherwise(SUGGESTED).alias("stroke"))
