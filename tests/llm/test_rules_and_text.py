"""Quality rules, SimHash, mixing, byte-level BPE and license scans against plain models."""

import hashlib
import random
import re
import textwrap
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brontide.llm import bpe, licenses, mixing, quality_rules, simhash
from brontide.llm.components import components
from brontide.llm.queries import codec, oracle_sql, queries
from tests.conftest import DATA, same_rows

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "a b c d e a b c d e f a b c d e"), (6, "x\nx\n\nx y\n x"), (7, "#tag | <b> & $5 *% 😀 é"), (8, "w " * 30_000), (4, "one"), (None, "null id")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash."""
    return spark.createDataFrame([(i, t, "src", "old", 1.5) for i, t in ODD], "doc_id long, text string, source string, kept string, score double")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, duck, name):
    same_rows(queries()[name](spark, DATA), duck, oracle_sql()[name])


def model_rules(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_on_odd_texts(odd):
    rows = quality_rules.quality_rules(odd).collect()
    got = sorted((repr(r["text"]), (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in rows)
    assert got == sorted((repr(t), model_rules(t)) for _, t in ODD)
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert quality_rules.quality_rules(odd, prefix="q_").filter("kept = 'old'").count() == len(ODD)
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#", max_size=60), min_size=1, max_size=8))
def test_rules_like_the_model(spark, texts):
    rows = quality_rules.quality_rules(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows] == list(map(model_rules, texts))


def model_fingerprint(text):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def model_groups(prints):
    """Least index reachable by links of at most 3 bits."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints(spark):
    for _, t in ODD:
        assert simhash.fingerprint(t) == model_fingerprint(t)
    native = spark.range(1).select(F.xxhash64(F.lit("one two thrée"))).first()[0]
    assert native & (1 << 64) - 1 == xxhash.xxh64_intdigest("one two thrée", 42)


def clustered(r, n):
    out = []
    while len(out) < n:
        base = r.getrandbits(64)
        for _ in range(r.choice((1, 1, 2, 9))):
            x = base
            for _ in range(r.randrange(5)):
                x ^= 1 << r.randrange(64)
            out.append(x)
    return out[:n]


@pytest.mark.parametrize("tile", [4096, 3])
def test_links_connect_what_brute_force_does(spark, tile):
    prints = sorted(set(clustered(random.Random(tile), 300)) | {0, 1, (1 << 64) - 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.fingerprint_links(fps, tile=tile)).collect()}
    want = model_groups(prints)
    groups = {}
    for x, g in zip(signed, want, strict=True):
        groups.setdefault(g, set()).add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_every_anchor_pair_within_reach_shares_one(spark):
    """The covering: two halves that differ in one bit, or none, always share an anchor."""
    r = random.Random(1)
    pairs = [(x := r.getrandbits(32), x ^ (1 << b if b < 32 else 0)) for b in range(33)]
    rows = spark.createDataFrame(pairs, "a long, b long").select(F.size(F.array_intersect(simhash._replicas(F.col("a")), simhash._replicas(F.col("b")))).alias("n"), F.size(simhash._replicas(F.col("a"))).alias("m")).collect()
    assert all(x["n"] >= 1 and x["m"] in (1, 16) for x in rows)


def test_simhash_on_odd_texts(spark, odd):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == len(ODD)
    blank = {r["doc_id"]: r for r in rows if r["doc_id"] in (1, 2, 3)}
    assert {(r["fp"], r["component_id"]) for r in blank.values()} == {(0, 1)}
    kept = simhash.simhash_dedup(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect())[4] == 1
    assert simhash.simhash_groups(odd.limit(0)).count() == 0 and simhash.simhash_dedup(odd.limit(0)).count() == 0


def test_dedup_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    groups = {r["component_id"] for r in simhash.simhash_groups(docs).collect()}
    kept = [r["doc_id"] for r in simhash.simhash_dedup(docs).collect()]
    assert sorted(kept) == sorted(groups)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}


def test_targets_stop_at_twice_the_size():
    t = mixing.targets(np.array([10, 1000, 100, 0]), np.array([3, 1, 2, 3]))
    assert t[0] == 20 and t[2] == 200 and t[3] == 0 and abs(t.sum() - 1.5 * 1110) < 1e-9


def test_tree_keeps_quotas_and_evens_shards():
    tree = mixing.split_tree([100, 7, 0, 1000], 16, 3)
    assert tree.sum(axis=0).tolist() == [100, 7, 0, 1000]
    assert tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 1
    assert (mixing.split_tree([100, 7, 0, 1000], 16, 3) == tree).all()


@pytest.mark.parametrize("carry", [True, False])
def test_mix_meets_its_targets(spark, carry):
    rows = [(i, "w " * (i % 40), None if i % 7 == 0 else f"s{i % 7}") for i in range(700)] + [(5, "w w w w w", "s5")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(docs, blocks=16, shards=8, carry=carry).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(d["words"] for d in r["draws"])
        s = by.setdefault(r["doc_id"] % 7, [r["target"], 0])
        s[1] += r["taken"]
    assert all(abs(taken - target) <= 4 for target, taken in by.values())
    again = mixing.mix_sources(docs, blocks=16, shards=8, carry=carry).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_draws_are_dealt_by_the_tree(spark, monkeypatch):
    """Every shard gets what its leaf of the tree says, and another tree gives other rows."""
    rows = [(i, "w " * (1 + i % 9), f"s{i % 3}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    trees, plain = [], mixing.split_tree

    def kept(quotas, shards, seed):
        trees.append(plain(quotas, shards, seed))
        return trees[-1]

    monkeypatch.setattr(mixing, "split_tree", kept)
    out = mixing.mix_sources(docs, blocks=16, shards=8).collect()
    blocks = {}
    for r in out:
        block = int(hashlib.md5(f"block:{r['doc_id']}".encode()).hexdigest()[:8], 16) % 16
        for turn, d in enumerate(r["draws"]):
            blocks.setdefault((int(r["source"][1]), block, turn), set()).add(d["shard"])
    assert all(len(s) == 1 for s in blocks.values())  # a block goes to one shard each time it is drawn
    got = Counter((next(iter(s)), source) for (source, _, _), s in blocks.items())
    assert all(got[shard, source] <= n for (shard, source), n in np.ndenumerate(trees[0]))
    assert sum(got.values()) >= trees[0].sum() - 3  # of a boundary block, documents that give nothing may be all
    monkeypatch.setattr(mixing, "split_tree", lambda quotas, shards, seed: np.array([quotas] + [[0] * len(quotas)] * (shards - 1)))
    other = mixing.mix_sources(docs, blocks=16, shards=8).collect()
    assert {d["shard"] for r in other for d in r["draws"]} == {0} and sorted(map(repr, other)) != sorted(map(repr, out))


def test_splits_are_multivariate_hypergeometric():
    """Means and variances of the first shard's draw over many seeds."""
    have, n = np.array([40, 20, 4]), 64
    first = np.array([mixing.split_tree(have.tolist(), 2, seed)[0] for seed in range(3000)])
    take, p = n // 2, have / n
    assert np.abs(first.mean(axis=0) - take * p).max() < 0.15
    assert np.abs(first.var(axis=0) - take * p * (1 - p) * (n - take) / (n - 1)).max() < 0.4


def test_mix_of_odd_and_empty_tables(odd):
    out = mixing.mix_sources(odd).collect()
    assert len(out) == len(ODD) and sum(r["taken"] for r in out) == round(out[0]["target"])
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    whole = mixing.mixed_documents(odd)
    assert whole.columns == odd.columns and {r["text"] for r in whole.collect()} <= {t for _, t in ODD}


@pytest.fixture(scope="module")
def tokens():
    import tiktoken

    c = codec()
    return c, tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab '’\n\t\r\x1c  　éß12,.!漢🙂stredlvm", max_size=80))
def test_tree_encodes_as_the_library(tokens, text):
    c, library = tokens
    small = bpe.Codec(c.ranks, c.pattern, leaf=5, window=2)
    small._encoding = library
    ids = small.encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert small.decode(ids) == text.encode()


def test_one_endless_word(tokens):
    c, library = tokens
    text = "ab" * 20_000 + " " * 9_000 + "x" * 9_000
    assert c.encode(text).tolist() == library.encode_ordinary(text)


def test_encoded_table(spark, odd, tokens):
    c, library = tokens
    rows = bpe.encode_documents(odd, c, digest=True).collect()
    for r in rows:
        ids = np.array(library.encode_ordinary(r["text"] or ""), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    back = bpe.decode_documents(bpe.encode_documents(odd, c, verify=True), c)
    assert all(r["round_trip"] and r["decoded"].decode() == (r["text"] or "") for r in back.collect())
    assert bpe.encode_documents(odd.limit(0), c).count() == 0


def model_license(text, least=licenses.LEAST, span=licenses.SPAN):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    words = re.findall(pattern, low)
    at, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += found
        base |= {label} if found else set()
    lines, labels, best = [set(re.findall(pattern, x)) for x in low.split("\n")], set(base), 0.0
    whole = [set(re.findall(pattern, x)) for x in re.split(r"\n[ \t\r\x0b\f]*(?=\n)", low)]
    for name, t in licenses.TEMPLATES.items():
        want = set(re.findall(pattern, t.lower()))
        for i in range(len(lines)):
            for k in range(1, span + 1):
                share = len(want & set().union(*lines[i : i + k])) / len(want)
                if share >= least - 1e-9:
                    labels.add(name)
                    best = max(best, share)
        for block in whole:
            if (share := len(want & block) / len(want)) >= least - 1e-9:
                labels.add(name)
                best = max(best, share)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best


LICENSED = [None, "", "The MIT License. mit LICENSE", "x apache license\nLicensed under the Apache License,\nVersion 2.0.", "Licensed under CC BY-NC 4.0.", "licensed by cc 4 0 nc under", "GNU General\nPublic License, version 3 licensed under the", "mit\n\nlicense mit license", "Permission is hereby granted free of charge to any person obtaining copy of this software and associated documentation"]


def test_license_scan_like_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(LICENSED)], "doc_id int, text string, labels string")
    rows = licenses.license_scan(docs).orderBy("doc_id").collect()
    for r, t in zip(rows, LICENSED, strict=True):
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) == model_license(t), t
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_license_scan_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    for r in licenses.license_scan(docs).collect():
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) == model_license(r["text"])


def test_license_scan_however_lines_end(spark):
    bsd, mit = licenses.TEMPLATES["bsd"], licenses.TEMPLATES["mit-text"]
    wrapped = ["\n".join(textwrap.wrap(t, w, break_long_words=False)) for t in (bsd, mit) for w in (40, 16, 1)]
    texts = [*wrapped, *(t.replace("\n", "\n\n \n") for t in wrapped), *("x y z " * 99 + "\ndnl " + t.replace("\n", "\ndnl ") + " more\n" + "x y z " * 99 for t in wrapped)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in licenses.license_scan(docs).collect():
        assert (r["labels"], r["score"], r["base_labels"]) == ("bsd" if r["doc_id"] % 6 < 3 else "mit-text", 1.0, ""), r["text"]
    # Words that stand far from each other are one block in a paragraph or a comment, and none across blank lines.
    far = lambda gap: gap.join(f"{w} a b c d\ne f g" for w in bsd.split())
    noted = "\n".join(" # " + " ".join(mit.split()[i : i + 4]) + " (a note that was put here by somebody)" for i in range(0, 40, 4))
    one_a_line = "\n".join(f"// two more {w}" for w in mit.split())
    apart = spark.createDataFrame([(1, far("\n \n")), (2, far("\n")), (3, "x\n\n" + noted + "\n\ny"), (4, one_a_line), (5, far("\n//\n"))], "doc_id int, text string")
    assert [r["labels"] for r in licenses.license_scan(apart).orderBy("doc_id").collect()] == ["", "bsd", "mit-text", "mit-text", "bsd"]


def test_windows_like_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice("abcdefgx").encode() for _ in range(rng.randrange(1, 40))]
        m = licenses.Matcher({"t": "a b c d a"}, {}, 0.75, 1)
        want = max(len(set(words[i : i + 10]) & {b"a", b"b", b"c", b"d"}) for i in range(len(words))) / 4
        assert m.best(words, [True] * len(words)) == ({"t": want} if want >= 0.75 else {})  # each word a part of its own
