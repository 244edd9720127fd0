"""Graph fixpoints against brute force, and how many rounds they take."""

import random

import pytest

from brontide.operators import graph


def closure(nodes, edges):
    near = {n: {d for s, d in edges if s == n} for n in nodes}
    out = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for d in near[todo.pop()] - seen:
                seen.add(d)
                todo.append(d)
        out[n] = seen
    return out


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def model_components(edges):
    nodes = {n for e in edges for n in e}
    reach = closure(nodes, edges)
    of = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    sizes = {c: list(of.values()).count(c) for c in of.values()}
    return {(n, c, sizes[c]) for n, c in of.items()}


def model_cycles(edges):
    """Breadth first over whole paths, the least of the shortest."""
    out = set()
    near = {}
    for s, d in sorted(edges):
        near.setdefault(s, []).append(d)
    for c, size in {(c, n) for _, c, n in model_components(edges)}:
        of = {n for n, k, _ in model_components(edges) if k == c}
        if (c, c) in edges:
            out.add((c, size, (c,)))
            continue
        front, seen = [(c,)], {c}
        while front and size > 1:
            closed = [p for p in front if c in near.get(p[-1], ())]
            if closed:
                out.add((c, size, min(closed)))
                break
            new = {}
            for p in sorted(front):
                for d in near.get(p[-1], ()):
                    if d in of and d not in seen:
                        new.setdefault(d, p + (d,))
            seen |= set(new)
            front = list(new.values())
    return out


def some_edges(seed):
    r = random.Random(seed)
    n = r.choice([6, 20, 40])
    edges = {(r.randrange(n), r.randrange(n)) for _ in range(r.choice([n, 2 * n]))}
    chain = [100 + i for i in range(r.randrange(2, 9))]
    r.shuffle(chain)
    edges |= set(zip([r.randrange(n), *chain], [*chain, r.randrange(n)], strict=True))
    return sorted(edges)


@pytest.mark.parametrize("seed", range(3))
def test_components_and_cycles_are_the_model(spark, seed):
    edges = some_edges(seed)
    assert {tuple(r) for r in graph.strong_components(frame(spark, edges)).collect()} == model_components(edges)
    assert {(r["component"], r["size"], tuple(r["path"])) for r in graph.cycles(frame(spark, edges)).collect()} == model_cycles(edges)


def test_a_long_ring_takes_few_rounds(spark):
    order = list(range(10_000))
    random.Random(1).shuffle(order)
    ring = frame(spark, list(zip(order, [*order[1:], order[0]], strict=True)))
    rounds = []
    found = graph.cycles(ring, rounds).collect()
    at = order.index(0)
    assert [(r["component"], r["size"]) for r in found] == [(0, 10_000)] and found[0]["path"] == order[at:] + order[:at]
    assert sum(rounds) < 40


def test_a_path_splits_again_and_again(spark):
    order = random.Random(2).sample(range(400), 400)
    rounds = []
    assert graph.strong_components(frame(spark, list(zip(order, order[1:], strict=False))), rounds).filter("size <> 1").isEmpty()
    assert sum(rounds) < 100


def test_shortest_of_chains_of_unequal_length(spark):
    a, b, c = [0, 11, 12, 13, 5], [0, 21, 5], [5, 31, 32, 0]
    edges = [e for p in (a, b, c) for e in zip(p, p[1:], strict=False)] + [(0, 20), (20, 5), (5, 5), (40, 0), (0, 41)]
    got = {(r["component"], r["size"], tuple(r["path"])) for r in graph.cycles(frame(spark, edges)).collect()}
    assert got == model_cycles(edges) == {(0, 9, (0, 20, 5, 31, 32))}


def test_empty_graphs(spark):
    none = frame(spark, [])
    assert graph.strong_components(none).count() == graph.cycles(none).count() == 0
    assert graph.cycles(frame(spark, [(1, 2), (2, 3)])).count() == 0
    assert graph.reachable(none, spark.createDataFrame([(1,)], "node long")).count() == 1


def model_labels(nodes, attacks):
    label = {}
    while True:
        new = {}
        for n in nodes - set(label):
            by = [label.get(s) for s, d in attacks if d == n]
            if all(x == "rejected" for x in by):
                new[n] = "accepted"
            elif "accepted" in by:
                new[n] = "rejected"
        if not new:
            return {(n, label.get(n, "undecided")) for n in nodes}
        label |= new


@pytest.mark.parametrize("seed", range(2))
def test_labels_and_levels_are_the_model(spark, seed):
    r = random.Random(seed)
    n = 40
    edges = sorted({(r.randrange(n + 3), r.randrange(n)) for _ in range(50)} | {(i, i + 1) for i in range(20, 30)})
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    assert {tuple(x) for x in graph.grounded(nodes, frame(spark, edges)).collect()} == model_labels(set(range(n)), edges)
    inner = [(s, d) for s, d in edges if s < n]
    level = dict.fromkeys(range(n))
    for k in range(n):
        for node in [i for i in range(n) if level[i] is None and all(level[s] is not None and level[s] < k for s, d in inner if d == i)]:
            level[node] = k
    assert {tuple(x) for x in graph.dag_levels(nodes, frame(spark, edges)).collect()} == set(level.items())
    starts = nodes.filter("node in (1, 25)")
    reach = closure(set(range(n + 3)), edges)
    assert {x[0] for x in graph.reachable(frame(spark, edges), starts).collect()} == reach[1] | reach[25]


def test_rounds_write_no_more_than_the_graph(spark, monkeypatch):
    """A chain of attacks settles two nodes a round; all rounds together write each node once and each attack once."""
    from brontide.sources import stored

    logs = []
    monkeypatch.setattr(graph, "Log", lambda *a: logs.append(stored.Log(*a)) or logs[-1])
    kept = []
    monkeypatch.setattr(stored.Log, "discard", lambda self: kept.append(self.rows().selectExpr("sum(n)").first()[0]))
    nodes = spark.createDataFrame([(i,) for i in range(16)], "node long")
    got = {r["node"]: r["label"] for r in graph.grounded(nodes, frame(spark, [(i, i + 1) for i in range(15)])).collect()}
    assert got == {i: "accepted" if i % 2 == 0 else "rejected" for i in range(16)}
    assert logs[0].rows().count() == 16 and kept[0] <= 15


def test_tasks_follow_the_number_of_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 2)
    edges = some_edges(1)
    assert graph._dealt(frame(spark, edges), graph._tasks(frame(spark, edges)), "src").rdd.getNumPartitions() == -(-len(edges) // 2) > 4
    assert {tuple(r) for r in graph.strong_components(frame(spark, edges)).collect()} == model_components(edges)
    steps = spark.createDataFrame([(c, "failed" if c == "b" else "succeeded") for c in "abcdefgh"], "node string, status string")
    plan = spark.createDataFrame([tuple(e) for e in ["ac", "bc", "cd", "ae", "fg", "gf", "zh", "hz", *["ac"] * 20]], "src string, dst string")
    got = {r["node"]: (r["level"], r["state"]) for r in graph.run_order(steps, plan).collect()}
    assert got == {"a": (0, "succeeded"), "b": (0, "failed"), "c": (1, "blocked"), "d": (2, "blocked"), "e": (1, "succeeded"), "f": (None, "blocked"), "g": (None, "blocked"), "h": (0, "blocked")}
