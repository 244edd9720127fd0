"""Order within crowded groups against one window."""

import random

import pytest
from pyspark.sql import functions as F

from brontide.operators import graph, ledger, ordered


@pytest.fixture
def events(spark):
    r = random.Random(1)
    at = r.sample(range(2000), 600)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), t, i, r.choice([*ledger.TRANSITIONS, None])) for i, t in enumerate(at)]
    return spark.createDataFrame(rows, "run string, ts long, id long, status string").repartition(7)


def both(monkeypatch, make):
    plain = sorted(map(repr, make().collect()))
    monkeypatch.setattr(ordered, "GROUP_ROWS", 50)
    return plain, sorted(map(repr, make().collect()))


@pytest.mark.parametrize("make", ["sequence", "illegal", "edges", "replay"])
def test_crowded_groups_are_put_in_order_alike(events, monkeypatch, make):
    forms = {
        "sequence": lambda: ledger.sequence(events, "run", "ts", "id"),
        "illegal": lambda: ledger.illegal_transitions(events, "run", "status", "ts", "id"),
        "edges": lambda: graph.sequence_edges(events.withColumn("node", F.col("id")), "run", "ts", "id"),
        "replay": lambda: ledger.replay(events, "run", 40, "ts", "id"),
    }
    plain, ranged = both(monkeypatch, forms[make])
    assert plain == ranged and len(plain) > 50


def test_no_window_holds_a_crowded_group(events, monkeypatch):
    monkeypatch.setattr(ordered, "GROUP_ROWS", 50)
    spread = ordered._dealt(events, "run", ("ts", "id")).filter("run = 'hot'").groupBy("_part").count().collect()
    assert len(spread) > 1 and max(x["count"] for x in spread) < 300
    assert ordered.is_crowded(events, "run") and not ordered.is_crowded(events.limit(0), "run")
