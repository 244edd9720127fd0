"""URL filters by a Bloom filter cascade.

The keys of a URL are the pairs of a suffix of its host, cut at dots, and a
prefix of its path of one of the lengths that listed paths have.  The *key
universe* is all keys of all URLs of the corpus.

Level 0 is a Bloom filter of the listed keys.  Level 1 holds the keys of the
universe that level 0 takes for listed and that are not; level 2 the listed keys
that level 1 takes for false; and so on, until a level lets nothing through.  A
key of the universe is listed if the first level that doesn't hold it is an odd
one.  Nothing is joined, and the answer is exact for every key of the universe.

Level 0 is sized from the number of keys in the universe, so that about one of
them passes for listed though it is not, whatever the corpus's size: each doubling of the
universe takes one more hash and one and a half more bits for each listed key.  The
false positives, the only thing that leaves the tasks, are therefore few; should there
be more than FALSE of them, level 0 is made larger and they are sought again.  Each
level salts its hash, so two keys that one level can't tell apart are told apart
by another.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brontide.llm.common import Plain, appended, with_columns

#: False positives of a level that the driver takes in, at most.
FALSE = 100_000
#: Bits of a key at the levels above level 0, and its hashes.
PER_KEY = 24
HASHES = 4
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class UrlRule:
    """A rule fits a host and all its subdomains if the URL's path starts with path."""

    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lowered, and path; both empty without ://."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = rest[:end].translate(_LOWER), rest[end:]
    end = next((i for i, c in enumerate(rest) if c in "?#"), len(rest))
    return host, rest[:end]


def url_keys(host: str, path: str, lengths: tuple[int, ...]) -> Iterator[tuple[str, str]]:
    """The keys of a URL, longest first: by host, then by path."""
    parts = host.split(".")
    for i in range(len(parts)):
        suffix = ".".join(parts[i:])
        for n in lengths:
            if n <= len(path):
                yield suffix, path[:n]


class Bloom:
    """A Bloom filter of UTF-8 keys, salted by its level."""

    def __init__(self, level: int, bits: int, hashes: int = HASHES):
        self.level, self.bits, self.hashes = level, max(64, bits), hashes
        self.held = np.zeros((self.bits + 7) // 8, np.uint8)

    @classmethod
    def of(cls, level: int, keys: Iterable[str], per_key: int | None = None, hashes: int | None = None) -> Bloom:
        keys = sorted(keys)
        made = cls(level, len(keys) * (per_key or PER_KEY), hashes or HASHES)
        for k in keys:
            made.set(made.places(k))
        return made

    def places(self, key: str) -> Iterator[int]:
        """The key's bits: each from 32 bits of a hash of its own, so that a small filter tells as many keys apart as a large one."""
        raw, h = key.encode("utf-8", "surrogatepass"), 0
        for i in range(self.hashes):
            h = h >> 32 if i % 4 else xxhash.xxh3_128_intdigest(raw, seed=self.level << 16 | i)
            yield (h & 0xFFFFFFFF) * self.bits >> 32

    def set(self, places: Iterable[int]) -> None:
        for p in places:
            self.held[p >> 3] |= 1 << (p & 7)

    def __contains__(self, key: str) -> bool:
        held = self.held
        return all(held[p >> 3] >> (p & 7) & 1 for p in self.places(key))


class Cascade:
    """Levels that alternate between listed keys and false positives."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def key_text(host: str, path: str) -> str:
    """Host and path with a mark between that neither has."""
    return f"{host}\x00{path}"


def universe_size(urls: DataFrame, column: str, lengths: tuple[int, ...]) -> int:
    """How many keys the URLs have at most: host suffixes times lengths of path prefixes, repeats included."""
    dots = F.length(F.col(column)) - F.length(F.replace(F.col(column), F.lit("."), F.lit(""))) + 1
    return (urls.agg(F.sum(dots.cast("bigint"))).first()[0] or 0) * max(1, len(lengths))


def build_cascade(urls: DataFrame, listed: set[tuple[str, str]], column: str = "url", lengths: tuple[int, ...] | None = None, universe: int | None = None, hashes: int | None = None, most_false: int = FALSE, most_levels: int = 64) -> Cascade:
    """The cascade of listed over the keys of all URLs.

    lengths: those of the path prefixes in the universe; the listed ones' if None.
    universe: its size, about, if known.  hashes: of level 0; None for as many as
    leave about one false positive.

    listed is a parameter, held by driver and tasks while the cascade is built;
    afterwards only the cascade is needed.  Each pass over the URLs finds what
    the levels so far get wrong.
    """
    table = Plain(urls)
    urls = table.df.select(F.col(table.name(column)).cast("string").alias("url"))
    lengths = lengths or tuple(sorted({len(p) for _, p in listed}, reverse=True))
    names = {key_text(h, p) for h, p in listed}
    if hashes is None:
        hashes = max(HASHES, math.ceil(math.log2(max(1, universe_size(urls, "url", lengths) if universe is None else universe))))
    while True:
        levels = [Bloom.of(0, names, math.ceil(hashes / math.log(2)), hashes)]
        inside = names
        while len(levels) < most_levels:
            # Odd levels: unlisted keys of the universe that all levels so far hold.
            wrong = _wrong(urls, lengths, names, levels, most_false)
            if not wrong or len(wrong) > most_false:
                break
            levels.append(Bloom.of(len(levels), wrong))
            # Even levels: listed keys that all levels so far hold.
            inside = {k for k in inside if k in levels[-1]}
            if not inside:
                break
            levels.append(Bloom.of(len(levels), inside))
        else:
            raise ValueError(f"no exact cascade within {most_levels} levels")
        if len(wrong) <= most_false:  # later levels never find more than the first did
            return Cascade(levels)
        hashes += 8  # level 0 let too many through: 256 times fewer next time


def _wrong(urls: DataFrame, lengths: tuple[int, ...], names: set[str], levels: list[Bloom], most: int) -> set[str]:
    """The unlisted keys of the universe that all levels hold; if there are more than most, most + 1 of them."""

    def run(batches):
        found: set[str] = set()
        for b in batches:
            for u in b.column(0).to_pylist():
                for h, p in url_keys(*split_url(u), lengths):
                    k = key_text(h, p)
                    if k not in names and len(found) <= most and all(k in x for x in levels):
                        found.add(k)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["k"])

    return {r["k"] for r in urls.mapInArrow(run, "k string").distinct().limit(most + 1).collect()}


def judge_urls(urls: DataFrame, rules: tuple[UrlRule, ...] = RULES, column: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule and verdict appended.

    rule: the longest that fits, host and path together, null if none does.
    verdict: the rule's, else default.  Of rules with the same host and path the
    last counts.  Null and malformed URLs have an empty host and path and the
    default.  Columns of urls named as an appended one, in any case, are replaced.
    Repeated rows are judged alike; an empty table gives an empty result.
    """
    made = dict.fromkeys(("host", "path", "rule", "verdict"), T.StringType())
    table = Plain(urls, made)
    name = table.name(column)
    slim = table.slim(name)
    verdicts = {(r.host, r.path): r.verdict for r in rules}
    lengths = tuple(sorted({len(p) for _, p in verdicts}, reverse=True))
    universe = universe_size(slim.select(F.col(name).cast("string").alias("url")), "url", lengths)
    cascades = {v: build_cascade(slim, {k for k, x in verdicts.items() if x == v}, name, lengths, universe) for v in sorted(set(verdicts.values()))}

    def judge(u: str | None) -> tuple[str, str, str | None, str]:
        host, path = split_url(u)
        best, verdict = None, default
        for h, p in url_keys(host, path, lengths):
            if best is None or len(h) + len(p) > len(best):
                k = key_text(h, p)
                for v, cascade in cascades.items():
                    if k in cascade:
                        best, verdict = h + p, v
                        break
        return host, path, best, verdict

    def run(batches):
        for b in batches:
            rows = [judge(u) for u in b.column(b.schema.names.index(name)).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield with_columns(b, list(made), [pa.array(c, pa.string()) for c in columns])

    return slim.mapInArrow(run, appended(slim.schema, [], **made)).select(*table.own(), *made)
