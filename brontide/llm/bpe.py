"""Byte-level BPE encoding and decoding as a monoid over pieces of text.

A piece's encoding is its token ids.  Long pieces are encoded by halves, and two
neighbours are joined by encoding again only a window around their border.  The
window reaches, on either side, from the border to a *stable cut*, and grows
until it has found one.

A cut is stable where a character that is not white space is followed by one
that is.  No match of the splitting pattern spans such a place: the only
alternatives that take white space take one space before, never after, other
characters, or take white space alone.  A match that ends there ends there too
if the text stops, and one that starts there depends on nothing before it, so
the tokens on either side of the cut are those of the two sides encoded alone.
A window that finds no cut grows to the whole of that side, so the join is exact
for every text, a single word of any length included; a text without such a
place (one endless word, or a script that puts no spaces) is then encoded anew at
every level of the tree, log2(n / LEAF) times in all.

Decoding concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brontide.llm.common import Plain, appended, small_batches, with_columns

#: Characters a leaf of the tree holds at most, and the first window on either side of a border.
LEAF = 1 << 13
WINDOW = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder of one vocabulary.  The driver reads the file once; executors get plain ranks and build their own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, window: int = WINDOW):
        self.ranks, self.pattern, self.leaf, self.window = ranks, pattern, leaf, window
        self._encoding = None
        self._bytes = None

    def plain(self) -> tuple:
        """What a codec is made from: built-in values, which a worker without this package can read."""
        return self.ranks, self.pattern, self.leaf, self.window

    def _plain(self, text: str) -> np.ndarray:
        if self._encoding is None:
            import tiktoken

            self._encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return np.asarray(self._encoding.encode_ordinary(text), dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, without special tokens, as unsigned 32-bit integers."""
        if len(text) <= self.leaf:
            return self._plain(text)
        half = len(text) // 2
        if "\ud800" <= text[half - 1] <= "\udbff":
            half += 1
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """encode(left + right), from the encodings of both and a window around their border."""
        a, b = self._cut_before(left), self._cut_after(right)
        if a == len(left) and b == 0:
            return np.concatenate((left_ids, right_ids))
        drop_left, drop_right = len(self._plain(left[a:])), len(self._plain(right[:b]))
        return np.concatenate((left_ids[: len(left_ids) - drop_left], self._plain(left[a:] + right[:b]), right_ids[drop_right:]))

    def _cut_before(self, left: str) -> int:
        """The last stable cut of left; 0 if it has none."""
        size = self.window
        while True:
            at = max(0, len(left) - size)
            found = None
            for found in re.finditer(r"(?<=\S)[ \t\n\r]", left[at:]):
                pass
            if found:
                return at + found.start()
            if not at:
                return 0
            size *= 2

    def _cut_after(self, right: str) -> int:
        """The first stable cut of right; its length if it has none."""
        size = self.window
        while True:
            found = re.search(r"(?<=\S)[ \t\n\r]", right[:size])
            if found:
                return found.start()
            if size >= len(right):
                return len(right)
            size *= 2

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: decoded by halves, concatenated up the tree."""
        if self._bytes is None:
            self._bytes = {i: b for b, i in self.ranks.items()}
        if len(ids) > self.leaf:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self._bytes.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, codec: Codec, text: str = "text", digest: bool = False, verify: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens and ids (array of int) appended; with digest, hashes in place of the ids.

    digest: ids_sha256, of the ids as little-endian unsigned 32-bit integers, and
    decoded_sha256, of the bytes the ids decode to, both as lowercase hex.
    verify: round_trip says whether the ids decode to the text's UTF-8.

    Null texts count as empty and have no tokens.  Columns of docs named as an
    appended one, in any case, are replaced.  Rows are independent: a lost task
    is run again.
    """
    small_batches(docs.sparkSession, 256)
    kinds = {"n_tokens": T.LongType()} | ({"ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} if digest else {"ids": T.ArrayType(T.IntegerType())}) | ({"round_trip": T.BooleanType()} if verify else {})
    names = list(kinds)
    table = Plain(docs, kinds)
    column = table.name(text)
    slim = table.slim(column)
    sent = docs.sparkSession.sparkContext.broadcast(codec.plain())  # one vocabulary: its size doesn't depend on docs

    def run(batches):
        c = Codec(*sent.value)
        for b in batches:
            n, out, decoded, same = [], [], [], []
            for t in b.column(b.schema.names.index(column)).to_pylist():
                ids = c.encode(t or "")
                back = c.decode(ids) if digest or verify else b""
                n.append(len(ids))
                same.append(back == (t or "").encode())
                out.append(hashlib.sha256(ids.tobytes()).hexdigest() if digest else ids.astype(np.int32))
                decoded.append(hashlib.sha256(back).hexdigest() if digest else None)
            made = [pa.array(n, pa.int64()), pa.array(out, pa.string() if digest else pa.list_(pa.int32()))]
            made += [pa.array(decoded, pa.string())] * digest + [pa.array(same, pa.bool_())] * verify
            yield with_columns(b if keep_text else b.drop_columns([column]), names, made)

    return slim.mapInArrow(run, appended(slim.schema, [] if keep_text else [column], **kinds)).select(*table.own(*([] if keep_text else [column])), *names)


def decode_documents(tokens: DataFrame, codec: Codec, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """tokens with the bytes that ids decode to appended as a binary column.  Null ids decode to null."""
    small_batches(tokens.sparkSession, 256)
    table = Plain(tokens, [name])
    column = table.name(ids)
    slim = table.slim(column)
    sent = tokens.sparkSession.sparkContext.broadcast(codec.plain())

    def run(batches):
        c = Codec(*sent.value)
        for b in batches:
            rows = b.column(b.schema.names.index(column)).to_pylist()
            yield with_columns(b, ["made"], [pa.array([None if r is None else c.decode(np.asarray(r, dtype="<u4")) for r in rows], pa.binary())])

    return slim.mapInArrow(run, appended(slim.schema, [], made=T.BinaryType())).select(*table.own(), F.col("made").alias(name))
