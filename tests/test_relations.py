"""Set-overlap joins and source matching against brute force."""

import random

import pytest

from brontide.operators import registry, relate, review
from brontide.operators.registry import compact_law


def sets(r, n, keys, size):
    weights = [1000 / (k + 1) for k in range(keys)]
    return {i: set(r.choices([f"k{k}" for k in range(keys)], weights=weights, k=r.randrange(1, size))) for i in range(n)}


def frame(spark, held):
    return spark.createDataFrame([(i, k) for i, s in held.items() for k in s], "id long, key string")


@pytest.mark.parametrize(("least", "block"), [(1, 4096), (3, 4096), (3, 4), (6, 4)])
def test_shared_keys_are_the_model(spark, monkeypatch, least, block):
    monkeypatch.setattr(relate, "PAIR_BLOCK", block)
    monkeypatch.setattr(relate._met, "__kwdefaults__", {"block": block})
    r = random.Random(least)
    a, b = sets(r, 60, 40, 12), sets(r, 40, 40, 12)
    got = {tuple(x) for x in relate.shared_keys(frame(spark, a), None, least).collect()}
    assert got == {(i, j, len(a[i] & a[j])) for i in a for j in a if i < j and len(a[i] & a[j]) >= least}
    got = {tuple(x) for x in relate.shared_keys(frame(spark, a), frame(spark, b), least).collect()}
    assert got == {(i, j, len(a[i] & b[j])) for i in a for j in b if i != j and len(a[i] & b[j]) >= least}


def test_prefixes_leave_common_keys_out(spark, monkeypatch):
    """Keys that most services have make hardly any pair; both ways give the same rows."""
    r = random.Random(1)
    held = {i: {"year", "code", "name"} | set(r.sample([f"k{k}" for k in range(400)], 3)) for i in range(300)}
    rows = frame(spark, held)
    left, right = relate._sets(rows, None, 4)
    whole, pruned = relate.pair_counts(rows, None, left, right, 4)
    assert whole > 3 * 300 * 299 / 2 and pruned < whole / 50
    fast = {tuple(x) for x in relate.shared_keys(rows, None, 4).collect()}
    monkeypatch.setattr(relate, "pair_counts", lambda *a: (1, 1))
    assert fast == {tuple(x) for x in relate.shared_keys(rows, None, 4).collect()} == {(i, j, len(held[i] & held[j])) for i in held for j in held if i < j and len(held[i] & held[j]) >= 4}


def test_empty_sets(spark):
    none = spark.createDataFrame([], "id long, key string")
    assert relate.shared_keys(none, None, 2).count() == 0 and relate.shared_keys(none, none, 1).count() == 0


def test_sources_match_without_a_cross_join(spark):
    r = random.Random(3)
    part = ["시설", "안전", "관리", "환경", "오염", "주차장", "법", "조례", "지침"]
    laws = [(i, "".join(r.choices(part, k=r.randrange(1, 6)))) for i in range(80)]
    items = [(f"u{i}", "".join(r.choices(part, k=r.randrange(1, 6))), "none") for i in range(60)]
    ours = review.unresolved_matches(spark.createDataFrame(laws, "id long, law string"), spark.createDataFrame(items, "item string, name string, reason string"))
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    want = {(i, u) for i, a in laws for u, b, _ in items if a == b or (min(len(a), len(b)) >= 6 and (a in b or b in a))}
    assert {tuple(x) for x in ours.collect()} == want
    assert spark.range(1).select(compact_law(__import__("pyspark.sql.functions", fromlist=["lit"]).lit("「가 나」"))).first()[0] == "가나"


def test_each_pair_is_made_once_and_not_shuffled(spark):
    """Copies of a law and of a source are classes: the pairs of their members are made last, by tasks dealt by what they make."""
    laws = [(i, "도로 교통 조례") for i in range(50)] + [(3, "환경 편람")] + [(99, None)]
    items = [(f"u{i}", "지역 조례", "local-scope") for i in range(40)] + [("u1", "환경편람", "none"), ("u1", "환경편람", "none"), ("v", None, None)]
    ours = review.unresolved_matches(spark.createDataFrame(laws, "id long, law string"), spark.createDataFrame(items, "item string, name string, reason string"))
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan.split("Join")[0]
    rows = [tuple(x) for x in ours.collect()]
    assert len(rows) == len(set(rows)) == 50 * 40 + 1 and (99, "v") in rows


def test_few_rows_that_make_many_pairs_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(relate, "TASK_PAIRS", 1000)
    a = spark.createDataFrame([(i, "k") for i in range(100)], "id long, key string")
    met = relate._met(a, a)
    assert met.count() == 10_000 and met.rdd.getNumPartitions() == 10
    cited = spark.createDataFrame([(i, "법") for i in range(30)] * 2, "id long, law string")
    sources = spark.createDataFrame([(f"s{i}", "법", "법 령") for i in range(20)], "url string, name string, official string")
    none = spark.createDataFrame([], "alias string, official string")
    rows = [tuple(x) for x in registry.find_sources(cited, sources, none).collect()]
    assert len(rows) == len(set(rows)) == 600


def test_members_meet_whole_arrays(spark, monkeypatch):
    """The join makes a row for each id and array, not for each pair; ids that are null are members too."""
    left = {**{i: f"a{i % 3}" for i in range(40)}, None: "a0", 77: "unpaired"}
    right = {**{f"u{i}": f"b{i % 4}" for i in range(50)}, None: "b1"}
    pairs = [("a0", "b0"), ("a0", "b1"), ("a1", "b1"), ("a2", "b3"), ("nobody", "b2")]
    df = lambda rows, columns: relate.classes(spark.createDataFrame(list(rows.items()), columns), "id")
    struct = spark.createDataFrame(pairs, "a string, b string").selectExpr("array(struct(a as s)) as a", "array(struct(b as s)) as b")
    monkeypatch.setattr(relate, "TASK_PAIRS", 100)
    made = relate.members(struct, df(left, "id long, s string"), df(right, "id string, s string"), block=6)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "explode(ys" in plan.split("Join")[0]
    got = [tuple(r) for r in made.collect()]
    want = {(x, y) for x, a in left.items() for y, b in right.items() if (a, b) in pairs}
    assert len(got) == len(set(got)) and set(got) == want
    none = struct.limit(0)
    assert relate.members(none, df(left, "id long, s string"), df(right, "id string, s string")).count() == 0
