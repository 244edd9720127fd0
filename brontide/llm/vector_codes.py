"""Product codes of integer vectors, assigned by annular norm pruning.

A vector is cut into parts, and each part is coded as the nearest of its
codebook's entries.  The entries of a codebook are sorted by norm.  With D the
squared distance to the best entry so far, the triangle inequality says that only
entries with

    |part| - sqrt(D)  <=  |entry|  <=  |part| + sqrt(D)

can be as near.  That interval of the sorted norms, the annulus, is found by
binary search and all of it, its rims included, is evaluated in integers: first
NEAR entries on either side of the one whose norm is nearest, then, with the best
of them, what the annulus that is left holds.  The interval is widened by more
than its own rounding, so the result is exact, ties and all.

Components are whole numbers, so all sums are exact and do not depend on how the
table is partitioned.  A round of fitting is one pass over the vectors; tasks hand
on sums by part, entry and position, and the driver holds the codebooks alone,
which are as large as `entries` vectors of each length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brontide.llm.common import Plain, discard, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Entries on either side of the nearest norm that are evaluated before the annulus is searched for.
NEAR = 8
#: Pairs of a part and an entry that are evaluated at once.
PAIRS = 1 << 19
#: Components beyond this could overflow 64-bit squares and sums.
_MOST = 1 << 26


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end: consecutive, and equal where parts divides the length."""
    short, over = divmod(length, parts)
    ends = np.cumsum([short + (k < over) for k in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _nearest_in(x: np.ndarray, book: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, best: np.ndarray, code: np.ndarray) -> int:
    """Evaluates rows' entries order[lo:hi] exactly, updates best and code in place; of equal distances the lower entry wins."""
    width, done = hi - lo, 0
    rows = np.flatnonzero(width > 0)
    ends = np.cumsum(width[rows])
    while done < len(rows):
        begun = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, begun + PAIRS, side="right")))
        r = rows[done:upto]
        w = width[r]
        first = np.cumsum(w) - w
        entry = order[np.arange(first[-1] + w[-1]) - np.repeat(first - lo[r], w)]
        gap = np.repeat(x[r], w, axis=0) - book[entry]
        distance = np.einsum("ij,ij->i", gap, gap)
        least = np.minimum.reduceat(distance, first)
        least_entry = np.minimum.reduceat(np.where(distance == np.repeat(least, w), entry, len(book)), first)
        better = (least < best[r]) | ((least == best[r]) & (least_entry < code[r]))
        best[r[better]], code[r[better]] = least[better], least_entry[better]
        done = upto
    return int(ends[-1]) if len(rows) else 0


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the nearest row of book (ties: the lower), its squared distance, and how many distances were evaluated."""
    n = len(x)
    best, code = np.full(n, np.iinfo(np.int64).max), np.full(n, len(book), np.int64)
    norm_x, norms = np.sqrt(np.einsum("ij,ij->i", x, x).astype(np.float64)), np.sqrt(np.einsum("ij,ij->i", book, book).astype(np.float64))
    order = np.argsort(norms, kind="stable")
    norms = norms[order]
    at = np.searchsorted(norms, norm_x)
    lo0, hi0 = np.maximum(at - NEAR, 0), np.minimum(at + NEAR, len(book))
    work = _nearest_in(x, book, order, lo0, hi0, best, code)
    reach = np.sqrt(best.astype(np.float64))
    slack = 1e-9 * (norm_x + reach + 1)
    lo, hi = np.searchsorted(norms, norm_x - reach - slack, side="left"), np.searchsorted(norms, norm_x + reach + slack, side="right")
    work += _nearest_in(x, book, order, lo, np.minimum(hi, lo0), best, code)
    work += _nearest_in(x, book, order, np.maximum(lo, hi0), hi, best, code)
    return code, best, work


Books = dict[int, list[np.ndarray]]


def _matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a batch as a matrix for each length, with the rows they are in."""
    vectors = batch.column(column)
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *vectors.value_lengths().to_pylist()])
    lengths = np.diff(ends)
    if len(flat) and (flat.max() > _MOST or flat.min() < -_MOST):
        raise ArithmeticError(f"a component is beyond {_MOST} after scaling; distances would not fit in a long")
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[ends[rows][:, None] + np.arange(d)].astype(np.int64).reshape(len(rows), d)


def _summed(books: Books, parts: int):
    """Sums and counts of the parts that each entry wins in a partition."""

    def run(batches):
        held = {}
        for b in batches:
            for rows, m in _matrices(b, 0):
                d = m.shape[1]
                if d not in held:
                    held[d] = [(np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)) for book in books[d]]
                for (lo, hi), book, (sums, counts) in zip(cuts(d, parts), books[d], held[d], strict=True):
                    code = assign(m[:, lo:hi], book)[0]
                    counts += np.bincount(code, minlength=len(book))
                    np.add.at(sums, code, m[:, lo:hi])
        for d, by_part in held.items():
            for p, (sums, counts) in enumerate(by_part):
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"length": np.full(len(used), d, np.int32), "part": np.full(len(used), p, np.int32), "entry": used.astype(np.int32), "n": counts[used], "sums": pa.array(sums[used].tolist(), pa.list_(pa.int64()))})

    return run


def fit_codebooks(vectors: DataFrame, id: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """The codebooks of each length of vectors: a list of arrays (entry, position), one a part.

    vectors: rows whose vector is an array<bigint> without nulls.  Codebooks begin
    as the vectors of the least ids; of equal ids the lesser vector is first, null
    ids are last.  In each round every part is assigned, and each entry becomes
    the floor of its parts' mean; unused entries stay.
    """
    first = Window.partitionBy("length").orderBy(F.col(id).asc_nulls_last(), vector)
    start = vectors.select(F.size(vector).alias("length"), id, vector).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= entries)
    held: dict[int, dict[int, list[int]]] = {}
    for r in start.select("length", "place", vector).collect():  # at most `entries` vectors of each length
        held.setdefault(r["length"], {})[r["place"]] = r[vector]
    books = {}
    for d, found in held.items():
        m = np.array([found[k] for k in sorted(found)], np.int64).reshape(len(found), d)
        if np.abs(m).max(initial=0) > _MOST:
            raise ArithmeticError(f"a component is beyond {_MOST} after scaling; distances would not fit in a long")
        books[d] = [m[:, lo:hi].copy() for lo, hi in cuts(d, parts)]
    for _ in range(rounds if books else 0):
        sums = vectors.select(vector).mapInArrow(_summed(books, parts), "length int, part int, entry int, n bigint, sums array<bigint>")
        each = sums.select("length", "part", "entry", "n", F.posexplode_outer("sums").alias("position", "sum"))
        total = each.groupBy("length", "part", "entry", F.coalesce("position", F.lit(0)).alias("position")).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
        after = {d: [book.copy() for book in by_part] for d, by_part in books.items()}
        for r in total.collect():  # as many numbers as the codebooks have
            if r["sum"] is not None:
                after[r["length"]][r["part"]][r["entry"], r["position"]] = r["sum"] // r["n"]
        books = after
    return books


def digest(books: Books, length: int) -> str:
    """SHA-256 of a length's entries: their components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books[length] for v in book.reshape(-1).tolist()).encode()).hexdigest()


def _coded(books: Books, parts: int, at: int):
    """Appends code, error and codebooks_sha256 to batches whose column `at` is the vector."""
    sums = {d: digest(books, d) for d in books}

    def run(batches):
        for b in batches:
            codes, errors, books_of = [""] * b.num_rows, np.zeros(b.num_rows, np.int64), [""] * b.num_rows
            for rows, m in _matrices(b, at):
                d = m.shape[1]
                by_part = np.zeros((len(rows), parts), np.int64)
                for p, ((lo, hi), book) in enumerate(zip(cuts(d, parts), books[d], strict=True)):
                    by_part[:, p], distance, _ = assign(m[:, lo:hi], book)
                    errors[rows] += distance
                for row, code in zip(rows.tolist(), by_part.tolist(), strict=True):
                    codes[row], books_of[row] = "".join(f"{c:02x}" for c in code), sums[d]
            kept = [i for i in range(b.num_columns) if i != at]
            made = [pa.array(codes, pa.string()), pa.array(errors), pa.array(books_of, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *made], [*(b.schema.names[i] for i in kept), "code", "error", "codebooks_sha256"])

    return run


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as array<bigint>; null where the vector is null or has a null or non-finite component."""
    v = vector.cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(v.isNotNull() & sound, F.transform(v, lambda x: F.floor(x * float(scale)).cast("bigint")))


_MADE = ("code", "error", "label_error", "codebooks_sha256")


def encode_vectors(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vectors with code, error, label_error and codebooks_sha256 appended.

    Rows whose vector is null or holds a null or non-finite component are left
    out, as the operator's definition asks; every other row is coded.  code: the
    index of each part's entry from 0, in two hex digits, in the order of parts
    (so `entries` is at most 256).  error: the squared distances of the parts to
    their entries, summed.  label_error: error summed over the rows with the same
    label; rows without one are together.

    Vectors of each length have codebooks of their own; a length that `parts`
    doesn't divide gives its first parts one component more.  Empty vectors have
    error 0.  Repeated rows and ids are rows of their own.  Components beyond
    2**26 after scaling raise ArithmeticError, since distances would not fit in a
    long.  Columns of vectors named as an appended one, in any case, are replaced.
    An empty table gives an empty result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part: entries must be from 1 to 256")
    table = Plain(vectors, _MADE)
    id_, label_ = table.name(id), table.name(label)
    own = [f"c{i}" for i in table.kept]
    keep = list(dict.fromkeys([*own, id_, label_]))
    whole = table.df.select(*keep, whole_numbers(F.col(table.name(embedding)), scale).alias("v")).filter("v is not null")
    numbers = stored(whole)
    books = fit_codebooks(numbers, id_, "v", parts, entries, rounds)
    schema = numbers.drop("v").schema.add("code", "string").add("error", "long").add("codebooks_sha256", "string")
    coded = stored(numbers.mapInArrow(_coded(books, parts, len(keep)), schema))
    discard(numbers)
    sums = coded.groupBy(F.col(label_).alias("of")).agg(F.sum("error").alias("label_error"))
    if sums.limit(100_001).count() <= 100_000:  # a checked bound; beyond it the join shuffles
        sums = F.broadcast(sums)
    out = coded.join(sums, F.col(label_).eqNullSafe(F.col("of")))
    return out.select(*table.own(), "code", "error", "label_error", "codebooks_sha256")


def decode_codes(coded: DataFrame, books: Books, length: int, code: str = "code", into: str = "decoded", scale: int = SCALE) -> DataFrame:
    """coded with the vector that its codes stand for, the middle of each component's step."""
    entries = [[[(int(v) + 0.5) / scale for v in e] for e in book] for book in books[length]]
    parts = [F.element_at(F.array(*(F.array(*map(F.lit, e)) for e in book)), F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") + 1) for p, book in enumerate(entries)]
    return coded.withColumn(into, F.concat(*parts))
