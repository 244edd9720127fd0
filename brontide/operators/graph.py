"""Graph operators.

Each round of a fixpoint is written to the shared folder and read back, so
neither lineage nor the loss of an executor grows with the rounds; the driver
sees only counts.  Fixpoints that settle nodes for good append what a round
settles to a log, so that all rounds together write no more than the graph has
nodes and edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brontide.operators.ordered import neighbour
from brontide.sources.stored import Log, discard, written, written_counting

#: Edges, or nodes, that one task sorts or groups.
TASK_EDGES = 1 << 20


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _tasks(*tables: DataFrame) -> int:
    """How many tasks the largest of some tables is dealt in."""
    return -(-max(t.count() for t in tables) // TASK_EDGES)


def _dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df dealt by its keys in so many tasks; a shuffle's own number stays where that is enough."""
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _distinct(edges: DataFrame) -> DataFrame:
    """The distinct edges, written."""
    edges = edges.select("src", "dst")
    return written(_dealt(edges, _tasks(edges), "src", "dst").distinct())


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node): what is reached from any start.  A round joins the nodes that the last one found."""
    edges = _distinct(edges)
    seen = _reached(edges, starts)
    discard(edges)
    return seen


def _reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """reachable, of edges that are distinct and written."""
    tasks = _tasks(edges)
    seen = Log(edges.sparkSession, f"node {_kind(starts, 'node')}")
    front = seen.append(starts.select("node").distinct())
    while not front.isEmpty():
        new = _dealt(edges, tasks, "src").join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = seen.append(_dealt(new, tasks, "node").join(seen.rows().select("node"), "node", "left_anti"))
    return seen.rows().select("node")


def strong_components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, component, size): nodes that reach each other; the component is named by its least node.

    Every node takes as its colours the least node, in an order drawn anew each
    time, that reaches it and the least that it reaches.  Where both are the same,
    that is the component's; other nodes stay with those of their own two colours,
    edges between colours go, and what is left is coloured again.  A random order
    splits even a long path in two again and again, so that takes a logarithm of
    repeats.  Edges are dealt by their number, so a task has no more of a larger graph.

    Colours spread along edges and along pointers: each node points to the
    neighbour with the best colour, and pointers are doubled until no colour
    moves, so a ring or chain of n nodes takes log2(n) rounds.  Both directions go
    in the same jobs.  Each round touches an edge once; no set of pairs is made.
    rounds: gets the number of rounds that were written.
    """
    edges = _distinct(edges)
    nodes = written(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    left = written(edges.filter("src <> dst"))
    discard(edges)
    found: list[DataFrame] = []
    turn = done = 0
    while not left.isEmpty():
        # A node without an edge in or out is a component of its own.
        tasks = _tasks(left)
        both = _dealt(left, tasks, "src").join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        both = _dealt(both, tasks, "dst").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        last, left = left, written(both.select("src", "dst"))
        discard(last)
        if left.isEmpty():
            break
        colours, n = _colours(left, turn)
        done += n + 1
        turn += 1
        found.append(colours.filter("ahead = back").select("node", F.col("ahead").alias("root")))
        open_ = colours.filter("ahead <> back")
        end = lambda name: open_.select(F.col("node").alias(name), F.struct("ahead", "back").alias(f"{name}_c"))  # noqa: E731, B023
        rest = _dealt(_dealt(left, tasks, "src").join(end("src"), "src"), tasks, "dst").join(end("dst"), "dst").filter("src_c = dst_c").select("src", "dst")
        last, left = left, written(rest)
        discard(last)
    if rounds is not None:
        rounds.append(done)
    named = reduce(DataFrame.unionByName, found) if found else nodes.select("node", F.col("node").alias("root")).limit(0)
    every = nodes.join(named, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    sizes = every.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    return every.join(sizes, "root").select("node", "component", "size")


def _colours(edges: DataFrame, turn: int) -> tuple[DataFrame, int]:
    """(node, ahead, back): the least node that each reaches, and that reaches it; and how many rounds that took.

    The order is drawn by turn.  A phase sets each node's pointer to the neighbour
    with the least colour and doubles pointers until no colour moves: a node then
    has the least colour on its pointer's path.  Phases go on until no edge moves
    a colour.
    """
    both = edges.select(F.lit(0).alias("way"), F.col("src").alias("of"), F.col("dst").alias("to")).unionByName(edges.select(F.lit(1).alias("way"), F.col("dst").alias("of"), F.col("src").alias("to")))
    tasks = _tasks(edges)
    colour = lambda of: F.struct(F.xxhash64(F.lit(turn), of).alias("h"), F.col(of).alias("n"))
    state = written(both.select("way", F.col("of").alias("node")).distinct().select("way", "node", colour("node").alias("c")))
    rounds = 0
    while True:
        seen = _dealt(both, 2 * tasks, "way", "to").join(state.select("way", F.col("node").alias("to"), "c"), ["way", "to"]).select("way", F.col("of").alias("node"), F.col("c.n").alias("colour"), "to")
        near = _dealt(seen, 2 * tasks, "way", "node").groupBy("way", "node").agg(F.min(F.struct(colour("colour").alias("c"), "to")).alias("best"))
        step = state.join(near, ["way", "node"], "left").select("way", "node", F.least("c", F.coalesce("best.c", "c")).alias("c"), F.coalesce("best.to", "node").alias("at"), F.coalesce(F.col("best.c") < F.col("c"), F.lit(False)).alias("moved"))
        last, (state, moving) = state, written_counting(step, "moved")
        discard(last)
        rounds += 1
        if not moving:
            break
        while moving:
            there = state.select("way", F.col("node").alias("at"), F.col("c").alias("far"), F.col("at").alias("next"))
            jump = _dealt(state.select("way", "node", "c", "at"), tasks, "way", "at").join(there, ["way", "at"]).select("way", "node", F.least("c", "far").alias("c"), F.col("next").alias("at"), (F.col("far") < F.col("c")).alias("moved"))
            last, (state, moving) = state, written_counting(jump, "moved")
            discard(last)
            rounds += 1
    way = lambda n, name: state.filter(F.col("way") == n).select("node", F.col("c.n").alias(name))
    out = written(way(0, "ahead").join(way(1, "back"), "node", "full").select("node", F.coalesce("ahead", "node").alias("ahead"), F.coalesce("back", "node").alias("back")))
    discard(state)
    return out, rounds


def cycles(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(component, size, path): of each set of nodes that reach each other, a shortest cycle through its least node.

    A node with an edge to itself is a cycle of one.  Of several shortest cycles
    the one whose node sequence is least is given.  Chains of nodes with one edge
    in and one out become one edge first, by doubled pointers; then paths grow
    from the least node, an edge of what is left a round, only where they got
    shorter.  rounds: gets the number of rounds that were written.
    """
    edges = written(edges.select("src", "dst").distinct())
    parts = written(strong_components(edges, rounds))
    loops = edges.filter("src = dst").select(F.col("src").alias("component")).distinct()
    sizes = written(parts.filter("node = component").join(loops.withColumn("loop", F.lit(True)), "component", "left").filter("size > 1 or loop").select("component", "size", F.coalesce("loop", F.lit(False)).alias("loop")))
    end = lambda name: parts.select(F.col("node").alias(name), F.col("component").alias(f"{name}_of"))
    inner = edges.filter("src <> dst").join(end("src"), "src").join(end("dst"), "dst").filter("src_of = dst_of")
    sought = written(sizes.filter("size > 1 and not loop").select("component"))
    inner = written(inner.select(F.col("src_of").alias("component"), "src", "dst").join(sought, "component", "left_semi"))
    short, done = _without_chains(inner)
    kind = _kind(edges, "src")
    held = Log(edges.sparkSession, f"component {kind}, node {kind}, best struct<len:int,path:array<{kind}>>")
    front = held.append(sought.select("component", F.col("component").alias("node"), F.struct(F.lit(0).alias("len"), F.array("component").alias("path")).alias("best")))
    while not front.isEmpty():
        path = F.concat("best.path", "via")
        there = F.when(F.col("dst") == F.col("component"), path).otherwise(F.concat(path, F.array("dst")))
        step = short.join(front.select("component", F.col("node").alias("src"), "best"), ["component", "src"])
        met = step.groupBy("component", F.col("dst").alias("node")).agg(F.min(F.struct((F.col("best.len") + F.col("steps")).cast("int").alias("len"), there.alias("path"))).alias("best"))
        # The start counts as reached when a path comes back to it, not at length 0.
        known = held.rows().filter("best.len > 0").groupBy("component", "node").agg(F.min("best").alias("known"))
        closed = known.filter("node = component").select("component", F.col("known.len").alias("most"))
        better = met.join(known, ["component", "node"], "left").join(closed, "component", "left")
        better = better.filter("known is null or best < known").filter("most is null or best.len < most or (node = component and best.len <= most)")
        new = held.append(better.select("component", "node", "best"))
        done += 1
        front = new.filter("node <> component")
    if rounds is not None:
        rounds.append(done)
    best = held.rows().filter("node = component and best.len > 0").groupBy("component").agg(F.min("best").alias("best")).select("component", F.col("best.path").alias("path"))
    every = best.unionByName(sizes.filter("loop").select("component", F.array("component").alias("path")))
    return every.join(sizes.select("component", "size"), "component").select("component", "size", "path")


def _without_chains(inner: DataFrame) -> tuple[DataFrame, int]:
    """(component, src, dst, via, steps) and the number of rounds: edges (component, src, dst) with chains of nodes in between as one edge.

    A chain's nodes have one edge in and one out and are not the component's name.
    Of several edges between two nodes the shortest stays, of equal ones the least.
    """
    ins = inner.groupBy("component", F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.min("src").alias("before"))
    outs = inner.groupBy("component", F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.min("dst").alias("after"))
    single = written(ins.join(outs, ["component", "node"]).filter("n_in = 1 and n_out = 1 and node <> component").select("component", "node", "before", "after"))
    mark = single.select("component", F.col("node").alias("after"), F.lit(1).alias("on"))
    start = single.join(mark, ["component", "after"], "left").select("component", "node", F.when(F.col("on") == 1, F.col("after")).otherwise(F.col("node")).alias("last"), F.coalesce("on", F.lit(0)).cast("bigint").alias("far"))
    state, rounds = written(start), 0
    while True:
        there = state.select("component", F.col("node").alias("last"), F.col("last").alias("next"), F.col("far").alias("more"))
        jump = state.join(there, ["component", "last"]).select("component", "node", F.col("next").alias("last"), (F.col("far") + F.col("more")).alias("far"), (F.col("more") > 0).alias("moved"))
        old, state = state, written(jump)
        discard(old)
        rounds += 1
        if state.filter("moved").isEmpty():
            break
    # A chain is as long as the path that it stands for.
    chains = state.join(single, ["component", "node"]).groupBy("component", "last").agg(F.sort_array(F.collect_list(F.struct((-F.col("far")).alias("far"), "node", "before", "after"))).alias("c"))
    joined = chains.select("component", F.get("c", 0)["before"].alias("src"), F.element_at("c", -1)["after"].alias("dst"), F.transform("c", lambda x: x["node"]).alias("via"))
    ends = single.select("component", "node")
    plain = inner.join(ends.withColumnRenamed("node", "src"), ["component", "src"], "left_anti").join(ends.withColumnRenamed("node", "dst"), ["component", "dst"], "left_anti")
    every = joined.unionByName(plain.select("component", "src", "dst", F.array().cast(joined.schema["via"].dataType).alias("via")))
    least = every.groupBy("component", "src", "dst").agg(F.min(F.struct((F.size("via") + 1).alias("steps"), "via")).alias("e"))
    return written(least.select("component", "src", "dst", "e.via", "e.steps")), rounds


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected graph, by hash-to-min rounds with pointer jumping."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = written(both)
    label = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("component")))
    total = lambda df: df.agg(F.sum(F.pmod(F.xxhash64("node", "component"), F.lit(1 << 40)))).first()[0]
    before = total(label)
    while True:
        near = both.join(label, both["dst"] == label["node"]).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("seen"))
        step = label.join(near, "node").select("node", F.least("component", "seen").alias("component"))
        jump = step.alias("a").join(step.alias("b"), F.col("a.component") == F.col("b.node"), "left")
        label = written(jump.select(F.col("a.node").alias("node"), F.least(F.col("a.component"), F.coalesce("b.component", "a.component")).alias("component")))
        after = total(label)
        if after == before:
            return label
        before = after


def grounded(nodes: DataFrame, attacks: DataFrame) -> DataFrame:
    """(node, label): accepted if every attacker is rejected, rejected if one is accepted, else undecided.

    attacks: (src, dst).  Attackers that are no nodes are never rejected.  A node
    waits for as many attackers as it has.  A round takes the nodes that were just
    accepted, rejects those that they attack, and takes these off the count of the
    nodes that they attack in turn; who waits for none is accepted next.  Each
    attack is counted once in all, and only what a round settles is written.
    """
    nodes, attacks = written(nodes.select("node").distinct()), _distinct(attacks)
    kind, tasks = _kind(nodes, "node"), _tasks(attacks)
    attacks = written(_dealt(attacks, tasks, "dst").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    waits = written(attacks.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")))
    settled, fallen = Log(nodes.sparkSession, f"node {kind}, label string"), Log(nodes.sparkSession, f"node {kind}, n bigint")
    front = settled.append(nodes.join(waits, "node", "left_anti").withColumn("label", F.lit("accepted")))
    by_source = _dealt(attacks, tasks, "src")
    while not front.isEmpty():
        hit = by_source.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        lost = settled.append(hit.join(settled.rows(), "node", "left_anti").withColumn("label", F.lit("rejected")))
        counted = fallen.append(by_source.join(lost.select(F.col("node").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")))
        free = _free(fallen, counted, waits).join(settled.rows(), "node", "left_anti")
        front = settled.append(free.withColumn("label", F.lit("accepted")))
    fallen.discard()
    return nodes.join(settled.rows().select("node", "label"), "node", "left").select("node", F.coalesce("label", F.lit("undecided")).alias("label"))


def _free(fallen: Log, counted: DataFrame, waits: DataFrame) -> DataFrame:
    """Of the nodes that a round counted down, those that wait for nothing any more: (node)."""
    touched = fallen.rows().join(counted.select("node"), "node", "left_semi").groupBy("node").agg(F.sum("n").alias("gone"))
    return touched.join(waits, "node").filter("gone = n").select("node")


def dag_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): the longest path from a source; nodes on or behind a cycle get null.

    A node waits for its edges in; a round counts down along the edges of the
    nodes that the last one settled, and writes those that it settles.
    """
    nodes, edges = written(nodes.select("node").distinct()), _distinct(edges)
    out = _levels(nodes, edges)
    discard(edges)
    return out


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """dag_levels, of nodes and edges that are distinct and written."""
    kind, tasks = _kind(nodes, "node"), _tasks(nodes, edges)
    known = lambda end: nodes.select(F.col("node").alias(end))
    edges = written(_dealt(_dealt(edges, tasks, "src").join(known("src"), "src", "left_semi"), tasks, "dst").join(known("dst"), "dst", "left_semi").select("src", "dst"))
    waits = written(edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")))
    settled, fallen = Log(nodes.sparkSession, f"node {kind}, level int"), Log(nodes.sparkSession, f"node {kind}, n bigint")
    front, level = settled.append(_dealt(nodes, tasks, "node").join(waits, "node", "left_anti").withColumn("level", F.lit(0))), 0
    by_source = _dealt(edges, tasks, "src")
    while not front.isEmpty():
        level += 1
        counted = fallen.append(by_source.join(front.select(F.col("node").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")))
        front = settled.append(_free(fallen, counted, waits).withColumn("level", F.lit(level)))
    fallen.discard()
    discard(edges, waits)
    return _dealt(nodes, tasks, "node").join(settled.rows().select("node", "level"), "node", "left")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    touched = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes.select("node").distinct().join(touched, "node", "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    known = nodes.select("node").distinct()
    good = edges.join(known.select(F.col("node").alias("src")), "src", "left_semi").join(known.select(F.col("node").alias("dst")), "dst", "left_semi")
    return edges.select("src", "dst").exceptAll(good.select("src", "dst"))


def within(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    known = nodes.select("node").distinct()
    return edges.join(known.select(F.col("node").alias("src")), "src", "left_semi").join(known.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)


def blocked_steps(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps with a dependency that has not succeeded: (node, blockers)."""
    bad = edges.join(steps.select(F.col("node").alias("src"), "status"), "src", "left").filter(F.coalesce(F.col("status") != "succeeded", F.lit(True)))
    return bad.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("blockers"))


def run_order(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, state) of a plan's steps: in order of level, what comes of each.

    steps: (node, status) with status the step's own outcome.  A step that depends
    on one that isn't succeeded, or on none that exists, is blocked whatever its
    own outcome, and blocks those that depend on it; steps on or behind a cycle have no
    level and are blocked.  Every round settles one level of the plan.
    """
    steps, edges = written(steps.select("node", "status")), _distinct(edges)
    tasks = _tasks(steps, edges)
    nodes = written(_dealt(steps.select("node"), tasks, "node").distinct())
    levels = _levels(nodes, edges)
    lost = _dealt(edges, tasks, "src").join(nodes.select(F.col("node").alias("src")), "src", "left_anti").select(F.col("dst").alias("node")).distinct().withColumn("lost", F.lit(True))
    base = _dealt(steps, tasks, "node").join(levels, "node").join(lost, "node", "left")
    bad = F.coalesce("lost", F.lit(False)) | F.col("level").isNull()
    start = written(base.select("node", "level", F.when(bad, "blocked").otherwise(F.col("status")).alias("state")))
    failed = start.filter("state <> 'succeeded'").select(F.col("node").alias("src"))
    hit = _reached(edges, _dealt(edges, tasks, "src").join(failed, "src", "left_semi").select(F.col("dst").alias("node")))
    return _dealt(start, tasks, "node").join(hit.withColumn("hit", F.lit(True)), "node", "left").select("node", "level", F.when(F.col("hit"), "blocked").otherwise(F.col("state")).alias("state"))


def sequence_edges(nodes: DataFrame, group: str, *order: str) -> DataFrame:
    """(src, dst): each node to the next of its group, which may be of any size."""
    return neighbour(nodes, group, F.col("node"), "dst", *order, ahead=True).filter("dst is not null").select(F.col("node").alias("src"), "dst")
