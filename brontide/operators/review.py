"""Reviews of results: critics, argument graphs, process graphs, sources; one rule is one DataFrame of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brontide.operators import graph, relate
from brontide.operators.ledger import canonical_hash
from brontide.operators.registry import LAW_STOP, compact_law
from brontide.sources.stored import written

#: Stages of a run in order, and how many documents it may select.
STAGE_ORDER = ("search", "detail", "relations", "compose")
MOST_SELECTED = 3
#: What a law's name must have for an unresolved source of each reason.
MARKERS = {"local-scope": "조례|자치법규|회의규칙", "institution-scope": r"각\s*부처|해당|개별|업종별|기관별", "internal-rule": "내부규정|내규", "external-official-document": "지침|편람|계획|기준|통보|매뉴얼", "title-needs-confirmation": "고시|지침|규정|가이드라인"}


def findings(*parts: DataFrame) -> DataFrame:
    """(run, rule, subject) of all rules."""
    return reduce(DataFrame.unionByName, parts)


def _found(df: DataFrame, rule: str, subject: Column) -> DataFrame:
    return df.select("run", F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))


def critic(selected: DataFrame, details: DataFrame, known: DataFrame, stages: DataFrame, missing: DataFrame, warnings: DataFrame) -> DataFrame:
    """Violations of a run's contract.

    selected, details, known: (run, id); stages: (run, ord, name, status);
    missing: (run, item); warnings: (run, text).
    """
    some = selected.groupBy("run").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"))
    skipped = stages.filter("name = 'relations' and status = 'skipped'").join(some.filter("n >= 2"), "run", "left_semi")
    place = F.array_position(F.array(*map(F.lit, STAGE_ORDER)), F.col("name"))
    back = stages.withColumn("p", place).filter("p > 0").withColumn("q", F.lag("p").over(Window.partitionBy("run").orderBy("ord"))).filter("p < q")
    said = missing.join(warnings, "run", "left").groupBy("run", "item").agg(F.bool_or(F.coalesce(F.contains("text", F.col("item")), F.lit(False))).alias("told")).filter("not told")
    return findings(
        _found(selected.join(details, ["run", "id"], "left_anti"), "selected-subset-of-details", F.col("id")),
        _found(selected.join(known, ["run", "id"], "left_anti"), "selected-in-search", F.col("id")),
        _found(skipped, "relations-not-skipped", F.lit("relations")),
        _found(said, "plan-missing-reported", F.col("item")),
        _found(some.filter(F.col("n") > MOST_SELECTED), "contract-limits", F.lit("too many")),
        _found(some.filter("n <> d"), "contract-limits", F.lit("repeated")),
        _found(back.select("run").distinct(), "contract-limits", F.lit("stage order")),
    )


#: The critic's rules.
RULES = ("selection-observed-detail", "selected-subset-of-details", "selected-in-search", "relations-verified", "relations-not-skipped", "plan-missing-reported", "contract-limits")


def observed_details(selected: DataFrame, requested: DataFrame, tools: DataFrame, detail_tool: str = "get_api_detail") -> DataFrame:
    """Runs that selected documents, not all of them requested, without a call of the tool that reads details.

    selected, requested: (run, id); tools: (run, tool).
    """
    own = selected.join(requested, ["run", "id"], "left_anti").select("run").distinct()
    return _found(own.join(tools.filter(F.col("tool") == detail_tool), "run", "left_anti"), "selection-observed-detail", F.lit("selected_service_ids"))


def verified_relations(selected: DataFrame, claimed: DataFrame, rechecked: DataFrame) -> DataFrame:
    """Relations that a run of two documents and more claims and that a second look doesn't give: (run, rule, subject).

    claimed, rechecked: (run, source, target, type).
    """
    some = selected.groupBy("run").agg(F.countDistinct("id").alias("n")).filter("n >= 2")
    key = ["run", "source", "target", "type"]
    lost = claimed.join(some, "run", "left_semi").join(rechecked, key, "left_anti")
    return _found(lost, "relations-verified", F.concat_ws(":", "type", "source", "target"))


def with_severity(found: DataFrame, runs: DataFrame, unverified: DataFrame | None = None, rules: tuple[str, ...] = RULES) -> DataFrame:
    """(run, rule, severity, subject): violations, unverified rules, and info for each rule that a run keeps.

    found: (run, rule, subject) violations; runs: (run); unverified: (run, rule)
    that could not be looked at.
    """
    every = runs.select("run", F.explode(F.array(*map(F.lit, rules))).alias("rule"))
    bad = found.select("run", "rule", F.lit("violation").alias("severity"), "subject")
    open_ = (every.limit(0) if unverified is None else unverified.select("run", "rule")).join(found, ["run", "rule"], "left_anti")
    open_ = open_.select("run", "rule", F.lit("unverified").alias("severity"), F.lit("-").alias("subject"))
    said = bad.select("run", "rule").unionByName(open_.select("run", "rule"))
    kept = every.join(said, ["run", "rule"], "left_anti").select("run", "rule", F.lit("info").alias("severity"), F.lit("-").alias("subject"))
    return findings(bad, open_, kept)


def verdict(found: DataFrame, contradictions: tuple[str, ...]) -> DataFrame:
    """(run, verdict): contradiction, then evidence_gap, of runs with findings; a run without any passes."""
    bad = F.bool_or(F.col("rule").isin(*contradictions))
    return found.groupBy("run").agg(F.when(bad, "contradiction").otherwise("evidence_gap").alias("verdict"))


def judge_arguments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, subject) of an argument graph: dangling edges, support cycles, claims without support, unresolved conflicts.

    nodes: (node, kind); edges: (src, dst, kind) with kinds support and attack.
    """
    pair = lambda df: df.select("src", "dst")
    inside = graph.within(nodes, edges)
    support, attack = inside.filter("kind = 'support'"), inside.filter("kind = 'attack'")
    loops = graph.cycles(pair(support)).select(F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"))
    made = lambda df, code, subject: df.select(F.lit(code).alias("code"), subject.cast("string").alias("subject"))
    bare = nodes.filter("kind = 'claim'").join(support.select(F.col("dst").alias("node")), "node", "left_anti")
    open_ = graph.grounded(nodes, pair(attack)).filter("label = 'undecided'")
    return reduce(DataFrame.unionByName, (made(graph.dangling(nodes, pair(edges)), "dangling-edge", F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string"))), made(loops, "support-cycle", F.col("path")), made(bare, "unsupported-claim", F.col("node")), made(open_, "unresolved-conflict", F.col("node"))))


def connection_allowed(source_kind: Column, target_kind: Column, kind: Column) -> Column:
    """Whether two nodes may be joined: both there, no interpretation as source; a node may support itself."""
    return source_kind.isNotNull() & target_kind.isNotNull() & (source_kind != "interpretation") & kind.isin("support", "attack")


def audit_process(nodes: DataFrame, edges: DataFrame, lanes: DataFrame, stages: DataFrame) -> DataFrame:
    """(rule, subject) of a process: orphans, no terminal, unreachable nodes, backward edges, empty lanes and stages.

    nodes: (node, lane, stage); edges: (src, dst, type); lanes: (lane); stages: (stage, ord).
    """
    made = lambda df, rule, c: df.select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("subject"))
    good = graph.within(nodes, edges)
    seq = good.filter("type = 'sequence'")
    ids = nodes.select("node").distinct()
    starts = ids.join(seq.select(F.col("dst").alias("node")), "node", "left_anti")
    ends = ids.join(seq.select(F.col("src").alias("node")), "node", "left_anti")
    lone = graph.orphans(nodes, good)
    lost = ids.join(graph.reachable(good, starts), "node", "left_anti").join(lone, "node", "left_anti")
    at = nodes.join(stages, "stage").select("node", "ord")
    back = seq.join(at.select(F.col("node").alias("src"), F.col("ord").alias("a")), "src").join(at.select(F.col("node").alias("dst"), F.col("ord").alias("b")), "dst").filter("b < a")
    none = ends.agg(F.count("*").alias("n")).filter("n = 0").withColumn("graph", F.lit("graph"))
    return reduce(
        DataFrame.unionByName,
        (
            made(lone, "orphan-node", "node"),
            made(none, "no-terminal", "graph"),
            made(lost, "unreachable-node", "node"),
            made(back.withColumn("e", F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string"))), "backward-sequence", "e"),
            made(lanes.join(nodes, "lane", "left_anti"), "empty-lane", "lane"),
            made(stages.join(nodes, "stage", "left_anti"), "empty-stage", "stage"),
        ),
    )


def validate_registry(
    nodes: DataFrame,
    edges: DataFrame,
    allowed: dict[str, tuple[str, ...]],
    ranges: dict[str, tuple[float, float]],
    members: dict[str, DataFrame] | None = None,
    current: tuple[str, str] | None = None,
    declared: DataFrame | None = None,
) -> DataFrame:
    """(rule, subject): what is wrong with a registry's nodes and edges.

    repeated-id, unknown-end; `x-not-allowed` and `x-out-of-range` for values
    outside a list or a range; with members, `x-unknown` for nodes whose column x
    is none of that table's (lanes, stages); with current = (group, flag),
    no-current and several-current for groups in which not exactly one node has
    the flag; with declared (group, n), count-mismatch for groups that have
    another number of nodes than they say, groups without nodes included.
    """
    made = lambda df, rule, c: df.select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("subject"))
    twice = nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    loose = graph.dangling(nodes, edges).withColumn("e", F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")))
    parts = [made(twice, "repeated-id", "node"), made(loose, "unknown-end", "e")]
    parts += [made(nodes.filter(~F.coalesce(F.col(c).isin(*v), F.lit(False))), f"{c}-not-allowed", "node") for c, v in allowed.items()]
    parts += [made(nodes.filter(~F.coalesce(F.col(c).between(*v), F.lit(False))), f"{c}-out-of-range", "node") for c, v in ranges.items()]
    parts += [made(nodes.join(known.select(c).distinct(), c, "left_anti"), f"{c}-unknown", "node") for c, known in (members or {}).items()]
    if current:
        group, flag = current
        flagged = nodes.groupBy(group).agg(F.count_if(F.col(flag)).alias("n"))
        parts += [made(flagged.filter("n = 0"), "no-current", group), made(flagged.filter("n > 1"), "several-current", group)]
    if declared is not None:
        (group,) = (c for c in declared.columns if c != "n")
        counted = declared.join(nodes.groupBy(group).agg(F.count("*").alias("held")), group, "left")
        parts.append(made(counted.filter(F.col("n") != F.coalesce("held", F.lit(0))), "count-mismatch", group))
    return reduce(DataFrame.unionByName, parts)


def validate_plans(plans: DataFrame, now: Column) -> DataFrame:
    """(rule, subject): plans that have expired, never say when, or whose hash is not that of their content.

    plans: (plan, expires_at, content_hash, content map<string,string>); the hash
    is ledger.canonical_hash's, which leaves content_hash itself out.
    """
    made = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.col("plan").cast("string").alias("subject"))
    wrong = ~F.coalesce(F.col("content_hash") == canonical_hash(F.col("content")), F.lit(False))
    return reduce(DataFrame.unionByName, (made(plans.filter(F.col("expires_at") <= now), "expired"), made(plans.filter("expires_at is null"), "no-expiry"), made(plans.filter(wrong), "hash-mismatch")))


def validate_dag(steps: DataFrame, deps: DataFrame) -> DataFrame:
    """(rule, subject): repeated steps, unknown and own dependencies, steps on or behind a cycle."""
    made = lambda df, rule, c: df.select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("subject"))
    twice = steps.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    unknown = deps.join(steps.select(F.col("node").alias("src")), "src", "left_anti")
    own = deps.filter("src = dst")
    stuck = graph.dag_levels(steps, graph.within(steps, deps).filter("src <> dst")).filter("level is null")
    return reduce(DataFrame.unionByName, (made(twice, "repeated", "node"), made(unknown, "unknown", "src"), made(own, "own", "src"), made(stuck, "cycle", "node")))


#: How long two compacted names must be for one to stand for the other when it contains it.
LEAST_CONTAINED = 6


def unresolved_matches(laws: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(id, item): citations that an unresolved source may stand for, each pair once.

    laws: (id, law); unresolved: (item, name, reason).  A pair matches when the
    compacted names are equal; when one contains the other and the shorter has
    LEAST_CONTAINED characters or more; or when the law's name has the mark of the
    source's reason and the source is the only one of that reason or they share a
    word.  Rows that say the same are one class: classes are compared, by
    equi-joins, and only the result has a row for each pair of their members.
    """
    ids = written(relate.classes(laws.select("id", F.coalesce("law", F.lit("")).alias("law")), "id"))
    items = written(relate.classes(unresolved.select("item", F.coalesce("name", F.lit("")).alias("name"), "reason"), "item"))
    said = lambda df: df.select("key").distinct().select("key", F.inline("key"))
    k = written(said(ids).select(F.col("key").alias("a"), "law", compact_law(F.col("law")).alias("k")))
    u = written(said(items).select(F.col("key").alias("b"), "name", "reason", compact_law(F.col("name")).alias("u")))
    same = k.join(u, k["k"] == u["u"]).select("a", "b")
    names, others = k.select(F.col("k").alias("s")).distinct(), u.select(F.col("u").alias("s")).distinct()
    either = lambda df, hay, needle: df.withColumnsRenamed({hay: "k", needle: "u"}).join(k.select("a", "k"), "k").join(u.select("b", "u"), "u").select("a", "b")
    inside, around = either(contained(names, others), "hay", "needle"), either(contained(others, names), "needle", "hay")
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(c, "[()·ㆍ,;:/]", " "), r"\s+"), lambda t: (F.length(t) >= 2) & ~t.isin(*LAW_STOP)))
    marks = F.array_compact(F.array(*(F.when(F.col("law").rlike(mark), reason) for reason, mark in MARKERS.items())))
    marked = k.select("a", "law", F.explode(marks).alias("reason"))
    alone = unresolved.groupBy("reason").agg(F.count("*").alias("n")).filter("n = 1").select("reason")
    only = marked.join(u.join(alone, "reason").select("b", "reason"), "reason").select("a", "b")
    shared = marked.select("a", "reason", F.explode(tokens("law")).alias("t")).join(u.select("b", "reason", F.explode(tokens("name")).alias("t")), ["reason", "t"]).select("a", "b")
    pairs = reduce(DataFrame.unionByName, (same, inside, around, only, shared)).distinct()
    return relate.members(pairs, ids, items).select(F.col("x").alias("id"), F.col("y").alias("item"))


def contained(hays: DataFrame, needles: DataFrame, n: int = LEAST_CONTAINED) -> DataFrame:
    """(hay, needle): which of the distinct strings (s) of n characters or more stand in which, themselves included.

    A needle is looked for by the one of its pieces of n characters that the fewest
    hays have; a needle with a piece that no hay has is in none.
    """
    pieces = lambda df: df.filter(F.length("s") >= n).select("s", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s") - n + 1), lambda i: F.substring("s", i, F.lit(n))))).alias("g"))
    have = pieces(hays)
    often = have.groupBy("g").agg(F.count("*").alias("often"))
    rarest = pieces(needles).join(often, "g", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g")).alias("r")).filter("r.often > 0")
    return have.withColumnRenamed("s", "hay").join(rarest.select(F.col("s").alias("needle"), F.col("r.g").alias("g")), "g").filter(F.contains("hay", F.col("needle"))).select("hay", "needle")


def loop_edges(nodes: DataFrame, order: str, action: str, process: str = "process") -> DataFrame:
    """(src, dst): from each correction or rejection back to the last submission, review or consultation before it in its process."""
    prior = F.last(F.when(F.col(action).isin("제출", "검토", "협의"), F.col("node")), ignorenulls=True).over(Window.partitionBy(process).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return nodes.withColumn("dst", prior).filter(F.col(action).isin("보완", "반려") & F.col("dst").isNotNull()).select(F.col("node").alias("src"), "dst")


def warning_text(w: Column) -> Column:
    """A warning map as text: the first description it has, after its date if the text doesn't name it; else null."""
    pick = F.coalesce(*(F.when(F.trim(F.try_element_at(w, F.lit(k))) != "", F.trim(F.try_element_at(w, F.lit(k)))) for k in ("message", "detail", "content", "내용")))
    date = F.trim(F.coalesce(F.try_element_at(w, F.lit("date")), F.lit("")))
    return F.when((date != "") & ~F.contains(pick, date), F.concat(date, F.lit(" · "), pick)).otherwise(pick)


def verification_summary(nodes: DataFrame, state: str, confidence: str) -> DataFrame:
    """One row: nodes by verification state, and how many need a check in the field."""
    kinds = ("article-verified", "source-linked", "scope-limited", "needs-review")
    return nodes.agg(F.count("*").alias("total"), *(F.count_if(F.col(state) == k).alias(k.replace("-", "_")) for k in kinds), F.count_if(F.col(confidence) < 0.6).alias("field_check"))
