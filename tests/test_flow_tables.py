"""Flows held as tables against the queue that orders one flow."""

import random

from brontide.plans import flow, tables


def test_all_flows_at_once(spark):
    r = random.Random(1)
    nodes, edges, want, needs = [], [], set(), set()
    for f in range(25):
        n = r.randrange(1, 9)
        ids = r.sample(range(100), n)
        mine = [(r.choice([*ids, 999]), r.choice(ids)) for _ in range(r.randrange(2 * n))] if f % 3 == 0 else [(ids[a], ids[b]) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(2 * n)) if a < b]
        nodes += [(f, i, k) for k, i in enumerate(ids)]
        edges += [(f, s, d, k) for k, (s, d) in enumerate(mine)]
        said = [{"source": s, "target": d} for s, d in mine]
        want |= {(f, i, k) for k, i in enumerate(flow.order_nodes([{"id": i} for i in ids], said))}
        needs |= {(f, ids[0], i) for i in flow.upstream(ids[0], said)}
    nodes_, edges_ = spark.createDataFrame(nodes, "flow long, node long, at int"), spark.createDataFrame(edges, "flow long, src long, dst long, at int")
    assert {tuple(x) for x in tables.order_flows(nodes_, edges_).collect()} == want
    firsts = nodes_.filter("at = 0").select("flow", "node")
    assert {tuple(x) for x in tables.upstream_of(edges_, firsts).collect()} == needs
    assert tables.order_flows(nodes_.limit(0), edges_).count() == 0


def test_relations_of_a_selection_take_one_shuffle(spark):
    from brontide.plans import flow

    selected = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, None), (None, "a")], "run long, id string")
    rows = [(1, "a", "b", "x"), (1, "a", "b", "x"), (1, "b", "b", None), (1, "a", "c", "x"), (2, "a", "b", "x"), (2, "a", "a", "y"), (2, "a", None, "x"), (2, None, "a", "x"), (None, "a", "a", "x"), (3, "a", "a", "x")]
    found = flow.within_selection(spark.createDataFrame(rows, "run long, source string, target string, note string"), selected)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [rows[0], rows[1], rows[2], rows[5]]))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
