"""Sharding, the source divergence audit and vector codes against plain models."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brontide.llm import divergence, sharding, vector_codes
from brontide.llm.sharding import Shard
from tests.conftest import DATA


# Sharding


def model_shard(key, shards):
    """The leaf that a key descends to: the least weighted draw among the children of each node."""
    path, live = "", [s for s in shards if s.weight]
    for part in ("region", "rack", "shard"):
        weights = defaultdict(float)
        for s in sorted(live, key=lambda s: (s.region, s.rack, s.shard)):
            weights[str(getattr(s, part))] += s.weight
        names = {n: f"{path}/{n}".strip("/") for n in weights}
        u = lambda n: (int(hashlib.md5(f"{key}/{names[n]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52  # noqa: E731, B023
        best = min(weights, key=lambda n: -np.log(u(n)) / weights[n])  # noqa: B023
        path, live = names[best], [s for s in live if str(getattr(s, part)) == best]
    return live[0].shard


TREES = [
    sharding.tree(8),
    sharding.tree(9),
    sharding.tree(3),
    [Shard("a", "x", 5, 2.5), Shard("a", "y", 1, 0.0), Shard("b", "x", 0, 1.0), Shard("b", "x", 7, 4.0)],
]


@pytest.mark.parametrize("shards", TREES)
def test_descent_is_the_model(spark, shards):
    got = spark.range(200).select(F.concat(F.lit("k"), "id").alias("key")).select("key", sharding.assigned(F.col("key"), shards).alias("h")).select("key", "h.shard", "h.region", "h.rack").collect()
    assert [r["shard"] for r in got] == [model_shard(r["key"], shards) for r in got]
    at = {s.shard: (s.region, f"{s.region}/{s.rack}") for s in shards}
    assert all((r["region"], r["rack"]) == at[r["shard"]] for r in got)


def homes(spark, *trees, n=4000):
    cols = [sharding.assigned(F.concat(F.lit("k"), F.col("id").cast("string")), t)["shard"].alias(f"t{i}") for i, t in enumerate(trees)]
    return [tuple(r) for r in spark.range(n).select(*cols).collect()]


def test_one_more_shard_takes_rows_only_into_itself(spark):
    for n in (8, 9, 10, 15):
        moved = [(a, b) for a, b in homes(spark, sharding.tree(n), sharding.tree(n + 1)) if a != b]
        assert {b for _, b in moved} == {n} and abs(len(moved) / 4000 - 1 / (n + 1)) < 0.03
        assert len({a for a, _ in moved}) == n  # and takes from all


def test_a_changed_weight_moves_rows_only_at_its_path(spark):
    before = sharding.tree(8)
    after = [Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 2 else 1.0) for s in before]
    rack = {s.shard: (s.region, s.rack) for s in before}
    for a, b in homes(spark, before, after):
        if a != b:  # into the region; within it into the rack; within that into the shard
            assert rack[b][0] == "r0" and (rack[a][0] != "r0" or rack[b][1] == "k1") and (rack[a] != ("r0", "k1") or b == 2)
    share = Counter(b for _, b in homes(spark, before, after))
    assert abs(share[2] / 4000 - 0.3) < 0.03 and abs(share[6] / 4000 - 0.1) < 0.02


def test_weights_decide_shares(spark):
    got = Counter(x for (x,) in homes(spark, TREES[3]))
    assert got[1] == 0 and abs(got[5] / 4000 - 2.5 / 7.5) < 0.03 and abs(got[7] / 4000 - 4 / 7.5) < 0.03


@pytest.mark.parametrize("bad", [[], [Shard("a", "b", 0, 0.0)], [Shard("a", "b", 0, -1.0)], [Shard("a", "b", 0), Shard("a", "c", 0)], [Shard("a", "b", 0, float("nan"))]])
def test_bad_trees_raise(bad):
    with pytest.raises(ValueError):
        sharding.assigned(F.lit("k"), bad)


@pytest.mark.parametrize("span", [1 << 16, 8])
def test_slots_have_no_gap_and_follow_content(spark, monkeypatch, span):
    monkeypatch.setattr(sharding, "RANGE", span)
    r = random.Random(span)
    rows = [(r.randrange(300), "t" * r.randrange(4), i) for i in range(900)] + [(7, "copy", i) for i in range(500)] + [(None, None, 1)] * 40 + [(None, "x" * 300_000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5)
    out = sharding.shard_documents(docs, sharding.tree(8), sharding.tree(9)).collect()
    assert sorted(map(repr, ((x["doc_id"], x["text"], x["n"]) for x in out))) == sorted(map(repr, rows))
    by = defaultdict(list)
    for x in out:
        raw = (x["text"] or "").encode()
        assert (x["size"], x["text_crc32"], x["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        key = "" if x["doc_id"] is None else f"k{x['doc_id']}"
        assert x["shard"] == model_shard(key, sharding.tree(8)) and x["grown_shard"] in (x["shard"], 8)
        by[x["shard"]].append((x["slot"], int(hashlib.md5(f"{key}/{x['size']}/{x['text_crc32']}".encode()).hexdigest()[:13], 16), key, x["size"]))
    for held in by.values():
        held.sort()
        assert [s for s, *_ in held] == list(range(len(held)))
        assert [h[1:] for h in held] == sorted(h[1:] for h in held)
    twice = sharding.shard_documents(docs, sharding.tree(8), carry=False)
    assert twice.columns == ["doc_id", "size", "text_crc32", "law", "region", "rack", "shard", "slot", "grown_shard"]
    assert sorted((x["shard"], x["slot"], repr(x["doc_id"])) for x in twice.collect()) == sorted((x["shard"], x["slot"], repr(x["doc_id"])) for x in out)
    assert all(x["grown_shard"] is None for x in twice.collect())


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sharding.write_shards(sharding.shard_documents(docs, sharding.tree(8)), f"{tmp_path}/s", rows_per_file=10)
    back = spark.read.parquet(f"{tmp_path}/s").withColumn("file", F.input_file_name())
    assert back.count() == docs.count() and back.groupBy("file", F.floor(F.col("slot") / 10)).count().filter("count > 10").isEmpty()
    for held in ((r["slot"] for r in spark.read.parquet(str(f)).collect()) for f in (tmp_path / "s").rglob("*.parquet")):
        slots = list(held)
        assert slots == sorted(slots)


# Source divergence


def model_divergence(rows, least=3, ranks=200):
    word = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by, out = defaultdict(list), []
    for lang, source, text in rows:
        by[lang or ""].append((source or "", word.findall((text or "").translate(lower))))
    for lang, docs in by.items():
        df = Counter(t for _, ws in docs for t in set(ws))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = defaultdict(Counter)
        for source, ws in docs:
            counts[source].update(w for w in ws if df[w] >= least)
        total = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in p if o != s]
            term = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, ranks)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(items)[:most])]
    return sorted(out)


def audited(spark, rows, **named):
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    return sorted(tuple(r) for r in divergence.source_divergence(docs, **named).select("lang", "source", "part", "item", "value", "rank").collect())


WORDS = ["a", "B", "the", "Ünï", "漢字", "x😀", "zzz", "mid", "Rare", "once"]


def some_rows(seed, n=150, sources=6):
    r = random.Random(seed)
    return [(r.choice(["en", "de", None, ""]), r.choice([None, "", *(f"s{i}" for i in range(sources))]), r.choice([None, "", "12 34", " ".join(r.choices(WORDS, weights=range(10, 0, -1), k=r.randrange(30)))])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_is_the_model(spark, seed):
    rows = some_rows(seed)
    assert audited(spark, rows) == model_divergence(rows)
    assert audited(spark, rows, ranks=2, least=1) == model_divergence(rows, 1, 2)


def test_divergence_with_flushes_blocks_and_pieces(spark, monkeypatch):
    """Small bounds: counts are handed on often, sources come in blocks, columns in pieces."""
    for name, value in (("FLUSH", 5), ("CELLS", 16), ("PIECE", 2), ("_LONG", 3)):
        monkeypatch.setattr(divergence, name, value)
    rows = some_rows(3, 200, 7)
    assert audited(spark, rows) == model_divergence(rows)


def test_divergence_of_few_and_odd_rows(spark):
    for rows in ([("en", "a", "x x")], [("en", "a", "1 2"), ("en", "b", None), ("de", "a", "ein")], [("en", "a", "w " * 50_000)] * 3 + [("en", "b", "v w")] * 2, [(None, None, None)] * 3):
        assert audited(spark, rows) == model_divergence(rows)
    assert divergence.source_divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**14), st.integers(1, 10**14)), min_size=1, max_size=9))
def test_shares_are_exact(pairs):
    count, more = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    assert divergence.share(count, count + more).tolist() == [1 + 10**9 * (c + 1) // (c + m) for c, m in pairs]


def test_share_and_gain_as_expressions(spark):
    r = random.Random(5)
    rows = [(c := r.randrange(10 ** r.randrange(1, 16)), c + r.randrange(1, 10**15)) for _ in range(300)]
    rows = [(c, w, r.randrange(1, 10**9 + 2), r.randrange(1, 10**9 + 2)) for c, w in rows]
    got = spark.createDataFrame(rows, "c long, w long, p long, q long").select(divergence.share_of(F.col("c"), F.col("w")), divergence.gain_of(F.col("p"), F.col("q"))).collect()
    assert [tuple(x) for x in got] == [(1 + 10**9 * (c + 1) // w, (p - q) ** 2 // q) for c, w, p, q in rows]


# Vector codes


def model_codes(rows, parts=16, entries=64, rounds=2):
    """Rows (id, vector, label) to (id, code, error, label_error, digest), by looking at every entry."""
    kept = [(i, [int(np.floor(256 * np.float64(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for d in {len(v) for _, v, _ in kept}:
        mine = [k for k in kept if len(k[1]) == d]
        first = sorted(mine, key=lambda k: (k[0] is None, k[0] or 0, k[1]))[:entries]
        cut = vector_codes.cuts(d, parts)
        books = [[v[a:b] for _, v, _ in first] for a, b in cut]
        near = lambda x, book: min((sum((p - q) ** 2 for p, q in zip(x, e, strict=True)), k) for k, e in enumerate(book))
        for _ in range(rounds):
            for p, (a, b) in enumerate(cut):
                held = defaultdict(list)
                for _, v, _ in mine:
                    held[near(v[a:b], books[p])[1]].append(v[a:b])
                books[p] = [[sum(c) // len(c) for c in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])]
        digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
        for i, v, label in mine:
            got = [near(v[a:b], books[p]) for p, (a, b) in enumerate(cut)]
            out.append((i, "".join(f"{k:02x}" for _, k in got), sum(e for e, _ in got), label, digest))
    by = Counter()
    for _, _, e, label, _ in out:
        by[label] += e
    return sorted(((i, c, e, by[label], h) for i, c, e, label, h in out), key=repr)


def coded(spark, rows, kind="float", **named):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    return sorted((tuple(r) for r in vector_codes.encode_vectors(df, **named).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_codes_are_the_model(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 0.2, (120, 32)), np.round(r.normal(0, 0.01, (60, 32)), 2), np.zeros((5, 32))]).astype(np.float32)
    rows = [(int(i), [float(c) for c in v], None if i % 5 == 0 else int(i % 3)) for i, v in zip(r.permutation(len(x)), x, strict=True)]
    rows += [rows[3]] * 4 + [(1000, None, 1), (1001, [None] * 32, 1), (1002, [float("nan")] * 32, 1), (1003, [float("inf")] * 32, None), (None, rows[0][1], 2)]
    assert coded(spark, rows) == model_codes(rows)
    assert coded(spark, rows, entries=5, parts=4, rounds=3) == model_codes(rows, 4, 5, 3)


def test_codes_of_odd_vectors(spark):
    """Lengths that differ, that the parts don't divide, and none at all; fewer rows than entries."""
    rows = [(1, [0.5], 1), (2, [-0.5], 1), (3, [], 1), (4, [], None), (5, [1.0] * 17, 2), (5, [1.0] * 17, 2), (6, [-1.001, 2.0] * 9, None), (None, [0.25] * 17, 2)]
    assert coded(spark, rows, "double") == model_codes(rows)
    assert vector_codes.encode_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert coded(spark, [(1, None, 1)]) == []
    with pytest.raises(Exception, match="would not fit"):
        coded(spark, [(1, [1e12], 1)], "double")
    with pytest.raises(ValueError):
        coded(spark, [(1, [1.0], 1)], entries=257)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 90), st.integers(1, 6), st.sampled_from([1, 3, 40, 10**6]), st.sampled_from([1, 2, 8]))
def test_annulus_finds_the_nearest_entry(seed, entries, width, spread, near):
    r = np.random.default_rng(seed)
    book = r.integers(-spread, spread + 1, (entries, width))
    x = np.concatenate([r.integers(-spread, spread + 1, (200, width)), book[:10], np.zeros((1, width), np.int64)])
    held, vector_codes.NEAR = vector_codes.NEAR, near
    try:
        code, best, work = vector_codes.assign(x, book)
    finally:
        vector_codes.NEAR = held
    distance = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (code == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all() and work <= len(x) * entries


def test_annuli_are_small_where_norms_differ():
    r = np.random.default_rng(2)
    scale = np.exp(r.uniform(0, 8, 256))[:, None]
    book = (r.normal(0, 1, (256, 4)) * scale).astype(np.int64)
    x = book[r.integers(0, 256, 3000)] + r.integers(-2, 3, (3000, 4))
    work = vector_codes.assign(x, book)[2]
    assert work < 0.25 * len(x) * len(book)


def test_decoding_gives_the_entries(spark):
    rows = [(i, [0.1 * i, -0.1 * i, 0.5, 0.25], 0) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    numbers = df.select("vec_id", vector_codes.whole_numbers(F.col("embedding")).alias("v"))
    books = vector_codes.fit_codebooks(numbers, "vec_id", "v", parts=2, entries=64)
    back = vector_codes.decode_codes(vector_codes.encode_vectors(df, parts=2), books, 4).collect()
    assert all(abs(a - b) <= 0.5 / 256 + 1e-9 for r in back for a, b in zip(r["embedding"], r["decoded"], strict=True))
    assert {r["error"] for r in back} == {0}
