"""Quoted CSV files of any size, read by as many tasks as they have ranges.

A line may end a record or stand inside a quoted cell; which, depends on all that
comes before it.  But at a line's start there are two states only, outside and
inside quotes, so a range of the file is a map from the state that it starts in to
the one that it ends in.  A first scan gives each range's map; a running
composition of these maps, over one row for each range, gives the state that each
range starts in; a second scan then parses every range alone.  A record that runs
over the end of its range is put together from its pieces afterwards.

Lines are bytes until then: line ends, quotes and delimiters are no part of any
other character in the encodings that are tried, so an encoding reads a file if
it reads each of its lines.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brontide.sources.files import CATALOG_ENCODINGS, CATALOG_IDS, id_column
from brontide.sources.stored import written

#: Ranges whose states travel to every task; beyond it the lines are shuffled to them.
MOST_SENT = 200_000


def state_after(line: bytes, inside: bool, delimiter: bytes) -> bool:
    """Whether the end of a line is inside quotes, if its start is."""
    if b'"' not in line:
        return inside
    at, begins = 0, not inside
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == b'"':
                at += 2
            else:
                inside, begins, at = False, False, at + 1
        elif begins and line[at : at + 1] == b'"':
            inside, at = True, at + 1
        else:
            at = line.find(delimiter, at)
            if at < 0:
                return False
            begins, at = True, at + 1


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, start, line): the bytes of each line with the range that it starts in; a range's lines come in order."""
    meta = lambda f: F.col(f"_metadata.{f}")
    return spark.read.option("lineSep", "\n").text(path).select(meta("file_path").alias("path"), meta("file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _ranges(batches) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """((path, start), lines) of the ranges of a partition, one after the other."""
    rows = ((p, s, v) for b in batches for p, s, v in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    row = next(rows, None)

    def of(key):
        nonlocal row
        while row is not None and row[:2] == key:
            yield row[2]
            row = next(rows, None)

    while row is not None:
        key = row[:2]
        lines = of(key)
        yield key, lines
        for _ in lines:  # what the caller left
            pass


_SUMMARY = "path string, start bigint, outside boolean, inside boolean, begins boolean, readable array<boolean>"


def range_states(lines: DataFrame, delimiter: str = ",", encodings: tuple[str, ...] = CATALOG_ENCODINGS) -> DataFrame:
    """(path, start, state, home, encoding) of each range.

    state: whether it starts inside quotes.  home: the range in which the record
    begins that a range starts in the middle of.  encoding: the first that reads
    the whole file, null without one.
    """
    mark = delimiter.encode()

    def summed(batches):
        for (path, start), held in _ranges(batches):
            out, into, begins, ok = False, True, False, [True] * len(encodings)
            for line in held:
                begins |= not into  # a record begins here though the range starts inside quotes
                out, into = state_after(line, out, mark), state_after(line, into, mark)
                for k, name in enumerate(encodings):
                    if ok[k] and not (line.isascii() and k):
                        try:
                            line.decode(name)
                        except UnicodeDecodeError:
                            ok[k] = False
            yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "outside": out, "inside": into, "begins": begins, "readable": ok}], pa.schema([("path", pa.string()), ("start", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_()), ("begins", pa.bool_()), ("readable", pa.list_(pa.bool_()))]))

    each = written(lines.mapInArrow(summed, _SUMMARY))
    order = Window.partitionBy("path").orderBy("start")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    swap = F.col("outside") & ~F.col("inside")
    # A map either keeps, swaps or forgets its state: the last that forgets, and the swaps since, say what holds.
    runs = each.withColumn("swaps", F.sum(swap.cast("int")).over(upto)).withColumn("set", F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").alias("to"), "swaps")))
    held = runs.withColumn("last", F.last("set", ignorenulls=True).over(before)).withColumn("done", F.coalesce(F.lag("swaps").over(order), F.lit(0)))
    state = F.coalesce(F.col("last.to"), F.lit(False)) != ((F.col("done") - F.coalesce("last.swaps", F.lit(0))) % 2 == 1)
    known = held.withColumn("state", state)
    home = F.last(F.when(~F.col("state") | F.col("begins"), F.col("start")), ignorenulls=True).over(before)
    whole = Window.partitionBy("path")
    reads = [F.every(F.get("readable", k)).over(whole) for k in range(len(encodings))]
    encoding = F.coalesce(*(F.when(r, F.lit(n)) for r, n in zip(reads, encodings, strict=True)))
    return written(known.select("path", "start", "state", home.alias("home"), encoding.alias("encoding")))


_PIECES = "path string, start bigint, ordinal bigint, encoding string, home bigint, piece bigint, raw binary, cells array<string>"


def _cells(raw: bytes, encoding: str, delimiter: str) -> list[str] | None:
    """The cells of one record; None where it can't be read."""
    csv.field_size_limit(1 << 30)
    try:
        return next(csv.reader(_with_ends(raw.decode(encoding)), delimiter=delimiter), [])
    except (csv.Error, UnicodeDecodeError):
        return None


def _with_ends(text: str) -> Iterator[str]:
    parts = text.split("\n")
    for k, p in enumerate(parts):
        yield p + "\n" if k < len(parts) - 1 else p


def read_records(spark: SparkSession, path: str | list[str], delimiter: str = ",", encodings: tuple[str, ...] = CATALOG_ENCODINGS) -> DataFrame:
    """(path, start, ordinal, encoding, cells): the records of quoted CSV files, in the order of start and ordinal.

    cells is null where a record can't be read.  Blank records have no cells.
    Files that no encoding reads give no rows.  Lines end in LF or CRLF.
    """
    lines = _lines(spark, path)
    states = range_states(lines, delimiter, encodings)
    if states.count() <= MOST_SENT:
        rows = lines.join(F.broadcast(states), ["path", "start"])
    else:
        numbered = lines.withColumn("row", F.monotonically_increasing_id())
        rows = numbered.join(states, ["path", "start"]).repartition("path", "start").sortWithinPartitions("path", "start", "row")
    mark = delimiter.encode()

    def parsed(batches):
        names = [f.split()[0] for f in _PIECES.split(", ")]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()))
        batches = iter(batches)
        said: dict[tuple, tuple] = {}

        def noted():
            for b in batches:
                for key in dict.fromkeys(zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), strict=True)):
                    said[key[:2]] = key[2:]
                yield b

        out: list[tuple] = []
        for (file, start), held in _ranges(noted()):
            inside, home, encoding = said[file, start]
            if encoding is None:
                continue
            head, open_, ordinal = inside, [], 0

            def done(cut: bool):
                nonlocal head, open_, ordinal  # noqa: B023
                raw = b"\n".join(open_)
                if head:  # the end, or the middle, of a record of another range
                    out.append((file, start, None, encoding, home, start, raw, None))  # noqa: B023
                else:
                    out.append((file, start, ordinal, encoding, start if cut else None, start if cut else None, raw if cut else None, None if cut else _cells(raw, encoding, delimiter)))  # noqa: B023
                    ordinal += 1
                head, open_ = False, []

            for line in held:
                open_.append(line)
                inside = state_after(line, inside, mark)
                if not inside:
                    done(False)
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
            if open_:
                done(True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    pieces = written(rows.select("path", "start", "line", "state", "home", "encoding").mapInArrow(parsed, _PIECES))
    whole = pieces.filter("home is null").select("path", "start", "ordinal", "encoding", "cells")
    joined = pieces.filter("home is not null").groupBy("path", "home", "encoding").agg(F.sort_array(F.collect_list(F.struct("piece", "raw"))).alias("parts"), F.max("ordinal").alias("ordinal"))

    @F.pandas_udf("array<string>")
    def read(parts: pd.Series, encoding: pd.Series) -> pd.Series:
        return pd.Series([_cells(b"\n".join(bytes(p["raw"]) for p in ps), e, delimiter) for ps, e in zip(parts, encoding, strict=True)])

    return whole.unionByName(joined.select("path", F.col("home").alias("start"), "ordinal", "encoding", read("parts", "encoding").alias("cells")))


def catalog_table(spark: SparkSession, path: str | list[str], encodings: tuple[str, ...] = CATALOG_ENCODINGS, markers: tuple[str, ...] = CATALOG_IDS) -> DataFrame:
    """(path, encoding, number, row as a map) of catalog CSVs of any size: the rows that have a document number, as files.catalog_rows gives them.

    The encoding is the first that reads the whole file.
    """
    records = read_records(spark, path, ",", encodings).filter("cells is not null")
    first = F.col("start").isin(0) & (F.col("ordinal") == 0)
    heads = records.filter(first).select("path", F.col("cells").alias("names"))  # one row a file
    rows = records.filter(~first).join(heads, "path")

    def run(batches):
        for pdf in batches:
            out = []
            for p, e, names, cells in zip(pdf["path"], pdf["encoding"], pdf["names"], pdf["cells"], strict=True):
                names = [n.lstrip("﻿") for n in names]
                if not any(names):
                    continue
                row = dict(zip(names, cells, strict=False))
                values = [row.get(id_column(names, markers)) or "", *(v for v in row.values() if len(v) > 5)]
                number = next((int(v) for k, v in enumerate(x.strip() for x in values) if v.isdecimal() and v.isascii() and (k == 0 or len(v) > 5)), None)
                if number is not None:
                    out.append((p, e, number, row))
            yield pd.DataFrame(out, columns=["path", "encoding", "number", "row"]).astype({"number": "int64"})

    return rows.select("path", "encoding", "names", "cells").mapInPandas(run, "path string, encoding string, number bigint, row map<string,string>")
