"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 1 bit
of one of their 32-bit halves.  So the covering is laid over the halves: of each
half, 31 bits are covered by the perfect Hamming code [31, 26], whose 2**26
codewords are the anchors and whose covering radius is 1.  A fingerprint is
replicated to every anchor within radius plus threshold, 1 + 1 = 2, of its half
(16 of them, or 1 if the half is a codeword); two fingerprints that are within 1
on a half share the anchor nearest to either, so comparing per anchor misses
nothing.  A single code over all 64 bits would need radius plus 3 and hundreds
of replicas; this takes 32 replicas at most.  There are 2**27 anchors in all, so
time is linear up to about 10 million distinct fingerprints, where an anchor has
two or three; beyond, an anchor's fingerprints grow with the corpus and what is
compared grows with the square, one in 130,000 of all pairs.

Whole texts are read once.  Exact copies collapse to one fingerprint before the
replication, an anchor's fingerprints are compared only in their 64 bits, and
from each anchor only a spanning forest of its links leaves.  Anchors with very
many fingerprints are cut into tiles that separate tasks compare.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brontide.llm.common import Plain, appended, let, small_batches, stored, with_columns
from brontide.llm.components import components

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
#: Fingerprints of one anchor that one task compares; more are cut into tiles of this many.
TILE = 4096
_ANCHORS_BITS = 31


def fingerprint(text: str | None) -> int:
    """The SimHash of a whole text, unsigned.  Null and blank texts: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only U+0009-D and space split
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    last = ends[min(SHINGLE, len(words)) - 1 :] - 1
    ones = np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    step = 1 << 14
    for i in range(0, n, step):
        hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts[i : min(n, i + step)].tolist(), last[i : i + step].tolist(), strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", keep_text: bool = True) -> DataFrame:
    """docs with the fingerprint as a signed long appended; a column of that name, in any case, is replaced."""
    small_batches(docs.sparkSession)
    table = Plain(docs, [name])
    column = table.name(text)
    slim = table.slim(column)

    def run(batches):
        for b in batches:
            made = np.array([fingerprint(t) for t in b.column(b.schema.names.index(column)).to_pylist()], dtype=np.uint64)
            if not keep_text:
                b = b.drop_columns([column])
            yield with_columns(b, ["made"], [pa.array(made.view(np.int64))])

    return slim.mapInArrow(run, appended(slim.schema, [] if keep_text else [column], made=T.LongType())).select(*table.own(*([] if keep_text else [column])), F.col("made").alias(name))


def _replicas(half: Column) -> Column:
    """The codewords within 2 of the low 31 bits of half.

    Bit i - 1 stands for position i of the Hamming code; the syndrome s is the
    exclusive or of the positions that are set.  Flipping position s, or any two
    positions whose exclusive or is s, gives a codeword.
    """
    low = half.bitwiseAND(F.lit((1 << _ANCHORS_BITS) - 1))
    flips = [[0]]
    for s in range(1, 32):
        flips.append([1 << (s - 1)] + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i < (i ^ s)])
    choices = F.array(*(F.array(*(F.lit(x).cast("bigint") for x in f)) for f in flips))
    return let(low, lambda x: F.transform(F.element_at(choices, _syndrome(x) + 1), lambda m: m.bitwiseXOR(x)))


def _syndrome(low: Column) -> Column:
    out = F.lit(0)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        out = out.bitwiseOR(F.shiftleft(F.bit_count(low.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)), k))
    return out


def forest(points: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of points that links within near connect: at most len(points) - 1."""
    a, b, rest = [], [], points
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            p = front.pop()
            hit = np.bitwise_count(rest ^ p) <= near
            if hit.any():
                new = rest[hit]
                a.append(np.full(len(new), p))
                b.append(new)
                front.extend(new)
                rest = rest[~hit]
    none = points[:0]
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def run_links(keys: np.ndarray, points: np.ndarray, near: int, short: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """keys: sorted.  Links among the points of each key: all of them in short runs, a forest in longer ones."""
    if not len(keys):
        return points, points
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((first, [len(keys)])))
    a, b = [points[:0]], [points[:0]]
    small = np.repeat(sizes <= short, sizes)
    for k in range(1, short):
        hit = (keys[k:] == keys[:-k]) & small[k:] & (np.bitwise_count(points[k:] ^ points[:-k]) <= near)
        a.append(points[:-k][hit])
        b.append(points[k:][hit])
    for i, n in zip(first[sizes > short], sizes[sizes > short], strict=True):
        x, y = forest(points[i : i + n], near)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def _linked(rows: DataFrame, near: int) -> DataFrame:
    """rows: (key, fp), a key's rows together and in order.  A run is held until its key ends."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(keys, fps):
            a, b = run_links(keys, fps, near)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (held and held[0][0][0] != keys[0]):
                ready = [*held, (keys[:cut], fps[:cut])]
                held = []
                yield out(*(np.concatenate(x) for x in zip(*ready, strict=True)))
            held.append((keys[cut:], fps[cut:]))
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.select("key", "fp").mapInArrow(run, "a bigint, b bigint")


def fingerprint_links(fps: DataFrame, near: int = MAX_DISTANCE, tile: int = TILE) -> DataFrame:
    """fps: one column fp of distinct longs.  Links (a, b) that connect what links within near bits connect."""
    if near > 3:
        raise ValueError("the covering of halves is laid for at most 3 differing bits")
    both = F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))
    anchors = fps.select("fp", F.posexplode(both).alias("half", "bits")).select("fp", F.explode(_replicas(F.col("bits"))).alias("anchor"), "half")
    keyed = anchors.select("fp", F.shiftleft(F.col("half").cast("bigint"), _ANCHORS_BITS).bitwiseOR(F.col("anchor")).alias("key"))
    # Counted with a partial aggregate; only the keys of the anchors that are cut into tiles leave it.
    crowded = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * tile))
    many = crowded.count()
    if not many:
        return _linked(keyed.repartition("key").sortWithinPartitions("key"), near).distinct()
    if many <= 100_000:  # a checked bound; beyond it the joins shuffle
        crowded = F.broadcast(crowded)
    usual = keyed.join(crowded, "key", "left_anti")
    k = F.ceil(F.col("n") / tile)
    chunk = F.pmod(F.xxhash64("fp"), k)
    large = keyed.join(crowded, "key").select("fp", "key", chunk.alias("c"), F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1)).alias("j"))
    tiles = large.select("fp", F.xxhash64("key", F.least("c", "j"), F.greatest("c", "j")).alias("key"))
    return usual.select("key", "fp").unionByName(tiles).transform(lambda rows: _linked(rows.repartition("key").sortWithinPartitions("key"), near)).distinct()


def _marked(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, h, fp) of each row, in the shared folder: h is a 64-bit hash of the text."""
    table = Plain(docs)
    text = F.col(table.name(text)).cast("string")
    return stored(with_fingerprints(table.df.select(F.col(table.name(id)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")), keep_text=False))


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (id, fp, component_id) for each row of docs.

    Documents link if their fingerprints differ in at most 3 bits; component_id
    is the smallest id that links reach, the document's own included.  Null,
    empty and blank texts have fingerprint zero and link like any other.  Null
    ids are kept and never the smallest unless all ids of the component are
    null.  Repeated rows give repeated rows.  Other columns are not carried.
    """
    marked = _marked(docs, id, text).select("id", "fp")
    return marked.join(fingerprint_groups(marked), "fp").select(F.col("id").alias(id), "fp", "component_id")


def fingerprint_groups(marked: DataFrame) -> DataFrame:
    """marked: (id, fp).  One row (fp, root, component_id) for each distinct fingerprint; root tells components apart."""
    least = stored(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(fingerprint_links(least.select("fp")))
    named = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(ids, "root").select("fp", "root", "component_id")


def simhash_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates: the one with the smallest id.

    Of several rows with that id, one stays.  A row with a null id stays only
    where all ids of its group are null, and then one.  Texts are shuffled once,
    by id, which no group of copies makes uneven.
    """
    table = Plain(docs)
    id_, text_ = table.name(id), F.col(table.name(text))
    marked = _marked(table.df, id_, table.name(text))
    first = marked.join(fingerprint_groups(marked.select("id", "fp")), "fp").filter(F.col("id").eqNullSafe(F.col("component_id")))
    stay = stored(first.groupBy("root").agg(F.min(F.struct("h", "id")).alias("x")).select(F.col("x.id").alias("stay_id"), F.col("x.h").alias("stay_h")))
    kept = table.df.withColumn("h", F.xxhash64(text_)).join(stay, F.col(id_).eqNullSafe(F.col("stay_id")) & (F.col("h") == F.col("stay_h")), "left_semi")
    copies = Window.partitionBy(id_, "h").orderBy(*(F.col(c) for c, t in table.df.dtypes if "map<" not in t and "variant" not in t))
    return kept.withColumn("rank", F.row_number().over(copies)).filter("rank = 1").select(*table.own())
