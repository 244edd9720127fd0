"""How far the sources of a language diverge in their words, exactly, from deduplicated count columns.

1. Terms are counted where the texts are: a task keeps counts by language, source
   and term and hands them on when it holds FLUSH of them, so of a source that
   holds a third of all rows only sums travel.
2. A term's column is its sparse vector of counts by source.  Rare terms by the
   million have the same column, so terms are grouped by it: everything after
   works on distinct columns with a multiplicity.
3. Every pair of sources is evaluated once for each distinct column and the result
   multiplied by the multiplicity.  Where neither source of a pair has the term
   the result is the same for all columns: it is worked out once and multiplied
   by how many terms are so.  A task holds a block of sources against all sources,
   at most CELLS pairs, whatever the number of columns.
4. The same columns give each source's terms their values.  Of a group only the
   columns that can reach the last rank are looked up again among the terms, and
   the terms, not the columns, are ranked.

All is in whole numbers.  Shares have nine decimals and are worked out by long
division in base 1000, sums of squares in two words, so nothing overflows for
languages of up to 9 * 10**15 words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from brontide.llm.common import Plain, small_batches, stored

#: The scale of a share.
UNIT = 1_000_000_000
LEAST_DOCUMENTS = 3
RANKS = 200
#: Counts that a task holds before it hands them on.
FLUSH = 250_000
#: Pairs of sources that a task adds up at a time.
CELLS = 1 << 22
#: Distinct columns that are evaluated together, about.
PIECE = 1 << 14
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_LONG = 1 << 20


def terms(text: bytes) -> Counter:
    """How often each term is in a text: runs of letters A-Z, lower-cased, and of characters beyond ASCII, in UTF-8."""
    low = text.lower()  # bytes: only A-Z change
    if len(low) < _LONG:
        return Counter(_TERM.findall(low))
    out, found = Counter(), (m.group() for m in _TERM.finditer(low))
    while part := list(islice(found, 1 << 16)):
        out.update(part)
    return out


_COUNTED = "lang string, source string, term binary, n bigint, df bigint"


def _counts(batches):
    """Rows (lang, source, text) to sums (lang, source, term, n, df); the null term says that the group occurs."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = defaultdict(dict)
    size = 0

    def out():
        for (lang, source), of in held.items():
            k = len(of)
            values = np.array(list(of.values()), np.int64).reshape(k, 2)
            for a in range(0, k, 1 << 16):
                part = list(islice(of, a, a + (1 << 16))) if k > 1 << 16 else list(of)
                m = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * m), pa.array([source] * m), pa.array(part, pa.binary()), pa.array(values[a : a + m, 0]), pa.array(values[a : a + m, 1])],
                    ["lang", "source", "term", "n", "df"],
                )

    for b in batches:
        for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            of = held[lang, source]
            size -= len(of)
            of.setdefault(None, [0, 0])
            for term, n in terms(text).items():
                if (seen := of.get(term)) is None:
                    of[term] = [n, 1]
                else:
                    seen[0] += n
                    seen[1] += 1
            size += len(of)
            if size >= FLUSH:
                yield from out()
                held.clear()
                size = 0
    yield from out()


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / whole) for count < whole < 9 * 10**15, by long division in base 1000."""
    whole = np.maximum(whole, 1)
    out, rest = np.divmod(count + 1, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def share_of(count: Column, whole: Column) -> Column:
    """share() as an expression; null where whole is 0."""
    scaled = (count.cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(whole > 0, F.call_function("div", scaled, whole.cast("decimal(19,0)")) + F.lit(1))


def gain_of(p: Column, q: Column) -> Column:
    """gain() as an expression."""
    return F.call_function("div", (p - q) * (p - q), q)


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q)."""
    d = p - q
    return d * d // q


_PAIRS = "lang string, s int, t int, high bigint, low bigint, seen bigint"


def _pair_sums(langs):
    """Adds up the pairs of a block of sources with all sources, for a piece of a language's columns.

    langs: rows lang, block, piece, kind, at, n, m, sorted by the first four.  kind 0
    heads a piece: at holds the block's first source and its end, n the words of
    each source plus the number of terms.  kind 1: a column with counts n at
    sources `at`, and its multiplicity m.  A pair's sum comes in two words,
    high * 2**32 + low, over the columns in which either source has the term, with
    the number of terms so `seen`.
    """

    def add(state, columns):
        lo, hi, whole, none, high, low, seen = state
        m = np.array([c[2] for c in columns], np.int64)
        width = np.array([len(c[0]) for c in columns])
        b, s, n = np.repeat(np.arange(len(columns)), width), np.concatenate([c[0] for c in columns]), np.concatenate([c[1] for c in columns])
        p = np.repeat(none[None], len(columns), axis=0)
        has = np.zeros(p.shape, bool)
        p[b, s], has[b, s] = share(n, whole[s]), True
        step = max(1, CELLS // 4 // len(whole))
        for first in range(0, len(s), step):
            at = slice(first, first + step)
            bb, ss = b[at], s[at]
            # The block's sources that have the term, against all.
            mine = (ss >= lo) & (ss < hi)
            rows, one = bb[mine], ss[mine]
            f = gain(p[rows, one][:, None], p[rows])
            np.add.at(high, one - lo, (f >> 32) * m[rows, None])
            np.add.at(low, one - lo, (f & 0xFFFFFFFF) * m[rows, None])
            np.add.at(seen, one - lo, np.repeat(m[rows, None], len(whole), axis=1))
            # All sources that have it, against the block's sources that don't.
            f = gain(p[bb, lo:hi], p[bb, ss][:, None])
            times = m[bb, None] * ~has[bb, lo:hi]
            np.add.at(high.T, ss, (f >> 32) * times)
            np.add.at(low.T, ss, (f & 0xFFFFFFFF) * times)
            np.add.at(seen.T, ss, times)

    def out(lang, state):
        lo, hi, whole, _, high, low, seen = state
        s, t = np.nonzero(seen)
        for a in range(0, len(s), 1 << 16):
            i, j = s[a : a + (1 << 16)], t[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i)), pa.array((i + lo).astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(x[i, j]) for x in (high, low, seen))], [f.split()[0] for f in _PAIRS.split(", ")])

    key, state, waiting, cells = None, None, [], 0
    for batch in langs:
        for lang, block, piece, kind, at, n, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                if key:
                    if waiting:
                        add(state, waiting)
                    yield from out(key[0], state)
                key, waiting, cells = (lang, block, piece), [], 0
                (lo, hi), whole = at, np.array(n, np.int64)
                shape = (hi - lo, len(whole))
                state = (lo, hi, whole, share(np.zeros(len(whole), np.int64), whole), np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64))
                continue
            waiting.append((np.array(at, np.int64), np.array(n, np.int64), m))
            cells += len(state[2])
            if cells >= CELLS >> 3:
                add(state, waiting)
                waiting, cells = [], 0
    if key:
        if waiting:
            add(state, waiting)
        yield from out(key[0], state)


class Audit:
    """The counts of a corpus by language, source and term, and what they say about its sources.

    Null text, language and source are read as ''.  A language keeps the terms
    that at least `least` of its documents (rows) have.  Every group of a language
    and a source that occurs has its place, with or without terms.
    """

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS):
        table = Plain(docs)
        spark = docs.sparkSession
        small_batches(spark)
        read = lambda c: F.coalesce(F.col(table.name(c)).cast("string"), F.lit(""))
        counted = table.df.select(read(lang).alias("lang"), read(source).alias("source"), read(text).cast("binary").alias("text")).mapInArrow(_counts, _COUNTED)
        sums = stored(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
        numbered = Window.partitionBy("lang").orderBy("source")
        groups = sums.filter("term is null").select("lang", "source").withColumn("s", F.row_number().over(numbered) - 1)
        #: A row for each term that a language keeps: its column of counts by source number, sorted.
        named = sums.filter("term is not null").join(groups, ["lang", "source"])
        column = F.array_sort(F.collect_list(F.struct("s", "n"))).alias("column")  # a term has at most one entry for each of its language's sources
        of_term = named.groupBy("lang", "term").agg(F.sum("df").alias("df"), column)
        self.terms = stored(of_term.filter(F.col("df") >= least).select("lang", "term", "column"))
        #: The distinct columns with their multiplicity.
        self.columns = stored(self.terms.groupBy("lang", "column").agg(F.count("*").alias("m")))
        total = F.aggregate("column", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
        words = self.columns.select("lang", "m", F.inline("column")).groupBy("lang", "s").agg(F.sum(F.col("n") * F.col("m")).alias("words"))
        per_lang = self.columns.groupBy("lang").agg(F.sum("m").alias("kept"), F.sum(total * F.col("m")).alias("lang_words"))
        joined = groups.join(words, ["lang", "s"], "left").join(per_lang, "lang", "left")
        #: A row for each source of a language: its number, its words of kept terms, the language's, and how many terms it keeps.
        self.groups = stored(joined.select("lang", "source", "s", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("words", "lang_words", "kept"))))

    def pairs(self) -> DataFrame:
        """lang, source, item (each other source of the language) and value: f summed over all kept terms."""
        whole = self.groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("s", (F.col("words") + F.col("kept")).alias("n")))).alias("g"), F.max("kept").alias("kept"))
        whole = whole.filter("kept > 0").select("lang", F.transform("g", lambda x: x["n"]).alias("n"))
        size = F.size("n")
        height = F.greatest(F.lit(1), F.floor(F.lit(CELLS) / size)).cast("int")
        blocks = whole.select("lang", "n", height.alias("height"), F.explode(F.sequence(F.lit(0), F.floor((size - 1) / height).cast("int"))).alias("block"))
        pieces = max(1, -(-self.columns.count() // PIECE))
        end = F.least(size, (F.col("block") + 1) * F.col("height"))
        head = blocks.select("lang", "block", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), F.lit(0).alias("kind"), F.array(F.col("block") * F.col("height"), end).alias("at"), "n", F.lit(0).cast("bigint").alias("m"))
        entry = lambda name: F.transform("column", lambda x: x[name])
        # A language's columns go to each of its blocks; there is one unless the language has thousands of sources.
        of_lang = blocks.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
        dealt = self.columns.withColumn("piece", F.pmod(F.xxhash64("column"), F.lit(pieces)).cast("int")).join(of_lang, "lang")
        body = dealt.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "piece", F.lit(1).alias("kind"), entry("s").alias("at"), entry("n").alias("n"), "m")
        tasks = max(1, min(4096, pieces * blocks.count()))
        keyed = head.unionByName(body).repartition(tasks, "lang", "block", "piece").sortWithinPartitions("lang", "block", "piece", "kind")
        sums = keyed.mapInArrow(_pair_sums, _PAIRS).groupBy("lang", "s", "t")
        wide = lambda c: F.sum(F.col(c).cast("decimal(30,0)"))
        sums = sums.agg((wide("high") * F.lit(1 << 32).cast("decimal(12,0)")).cast("decimal(38,0)").alias("high"), wide("low").cast("decimal(38,0)").alias("low"), F.sum("seen").alias("seen"))
        none = share_of(F.lit(0), F.col("words") + F.col("kept")).alias("none")
        one, other = self.groups.select("lang", F.col("source"), "s", "kept", none), self.groups.select("lang", F.col("source").alias("item"), F.col("s").alias("t"), none.alias("none_t"))
        every = one.join(other, "lang").filter("s <> t").join(sums, ["lang", "s", "t"], "left")
        flat = F.when(F.col("kept") > 0, gain_of(F.col("none"), F.col("none_t"))).cast("decimal(20,0)")
        unseen = (F.col("kept") - F.coalesce("seen", F.lit(0))).cast("decimal(18,0)")
        zero = F.lit(0).cast("decimal(38,0)")
        value = F.when(F.col("kept") > 0, F.coalesce("high", zero) + F.coalesce("low", zero) + (flat * unseen)).otherwise(zero)
        return every.select("lang", "source", "item", value.cast("bigint").alias("value"))

    def top_terms(self, ranks: int = RANKS) -> DataFrame:
        """lang, source, item (a term that the source has more often than its language), value and rank, ranks to `ranks`."""
        total = F.aggregate("column", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
        entries = self.columns.select("lang", "column", "m", total.alias("total"), F.inline("column"))
        p, q = share_of(F.col("n"), F.col("words") + F.col("kept")), share_of(F.col("total"), F.col("lang_words") + F.col("kept"))
        valued = entries.join(self.groups, ["lang", "s"]).select("lang", "source", "column", "m", p.alias("p"), q.alias("q")).filter("p > q")
        valued = stored(valued.select("lang", "source", "column", "m", gain_of(F.col("p"), F.col("q")).alias("value")))
        # The least value that can have one of the ranks: fewer terms than that have a greater one.
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
        levels = valued.groupBy("lang", "source", "value").agg(F.sum("m").alias("m")).withColumn("k", F.row_number().over(best)).filter(F.col("k") <= ranks)
        above = F.coalesce(F.sum("m").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        levels = levels.withColumn("above", above).filter(F.col("above") < ranks).select("lang", "source", "value")
        wanted = valued.join(levels, ["lang", "source", "value"]).select("lang", "source", "column", "value")
        ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        ranked = wanted.join(self.terms, ["lang", "column"]).select("lang", "source", F.col("term").cast("string").alias("item"), "value").withColumn("rank", F.row_number().over(ordered))
        return ranked.filter(F.col("rank") <= ranks)


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """Rows lang, source, part, item, value, rank: how far each source is from each other source of its language, and in which terms from the language.

    With p of a group 1 + floor(10**9 * (count + 1) / (words + kept)) for each kept
    term, and f = floor((p - q)**2 / q): part "pair" has a row for each other
    source, with f summed over all kept terms (0 where none is kept), all ranks;
    part "term" has the kept terms whose p is above the language's, up to `ranks`.
    Ranks go by value, then by item in the order of UTF-8 bytes.

    Null text, lang and source are ''.  Repeated rows count as often as they occur.
    A language with one source has no pairs; texts without terms leave their
    group in place.  Other columns are not read, whatever their names.  An empty
    table gives an empty result.
    """
    audit = Audit(docs, text, lang, source, least)
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = audit.pairs().withColumn("rank", F.row_number().over(ordered))
    row = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast(T.IntegerType()).alias("rank"))
    return row(pairs, "pair").unionByName(row(audit.top_terms(ranks), "term"))
