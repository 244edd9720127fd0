"""A stream of the lines of files that grow, which can be taken up again after any line.

An offset names for each file how many lines, and how many bytes, have been read,
so a batch is a byte range of each file and can be read again.  A last line
without its end waits until the end is there.  Every row carries its line's
number, so errors further on can name it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_CHUNK = 1 << 20


@dataclass
class LineRange(InputPartition):
    """Lines of a file: the number of the first, and the bytes that they take."""

    file: str
    line: int
    start: int
    end: int


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class LineReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix, self.after = options["path"].rstrip("/"), options.get("suffix", ""), int(options.get("after", "0"))
        self.seen: dict[str, list[int]] = {}

    def _files(self):
        from pyarrow import fs

        store, base = _place(self.path)
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        return store, base, sorted((x for x in found if x.type == fs.FileType.File and x.path.endswith(self.suffix)), key=lambda x: x.path)

    def initialOffset(self) -> dict:
        """Before the first line; with after, behind so many lines of each file."""
        if not self.after:
            return {}
        store, base, files = self._files()
        return {x.path[len(base) + 1 :]: self._forward(store, x.path, [0, 0], x.size, self.after) for x in files}

    def _forward(self, store, path: str, at: list[int], size: int, most: int | None = None) -> list[int]:
        """The place behind the last whole line, or behind line `most`."""
        line, end = at
        with store.open_input_file(path) as f:
            pos = end
            while pos < size and (most is None or line < most):
                part = f.read_at(min(_CHUNK, size - pos), pos)
                if not part:
                    break
                if most is not None and line + part.count(b"\n") > most:
                    for _ in range(most - line):
                        end = pos + part.index(b"\n", end - pos if end > pos else 0) + 1
                    return [most, end]
                n = part.count(b"\n")
                if n:
                    line, end = line + n, pos + part.rindex(b"\n") + 1
                pos += len(part)
        return [line, end]

    def latestOffset(self) -> dict:
        store, base, files = self._files()
        for x in files:
            name = x.path[len(base) + 1 :]
            at = self.seen.get(name, [0, 0])
            if x.size > at[1]:
                self.seen[name] = self._forward(store, x.path, at, x.size)
        return {k: list(v) for k, v in self.seen.items() if v[0]}

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        out = []
        for name, (line, stop) in sorted(end.items()):
            at, begin = start.get(name, [0, 0])
            if stop > begin:
                out.append(LineRange(name, at + 1, begin, stop))
        return out

    def read(self, partition: LineRange):
        store, base = _place(self.path)
        number, left = partition.line, b""
        with store.open_input_file(f"{base}/{partition.file}") as f:
            pos = partition.start
            while pos < partition.end:
                part = f.read_at(min(_CHUNK, partition.end - pos), pos)
                pos += len(part)
                *whole, left = (left + part).split(b"\n")
                for line in whole:
                    yield partition.file, number, line.removesuffix(b"\r").decode("utf-8", "replace")
                    number += 1

    def commit(self, end: dict) -> None:
        pass


class LineSource(DataSource):
    """The format "numbered_lines": options path, suffix, after (lines of each file to leave out)."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "file string, line bigint, value string"

    def streamReader(self, schema) -> LineReader:
        return LineReader(dict(self.options))


def read_lines(spark: SparkSession, path: str, suffix: str = "", after: int = 0) -> DataFrame:
    """(file, line, value): a stream of the lines of a folder's files, from line after + 1 of each on."""
    spark.dataSource.register(LineSource)
    return spark.readStream.format("numbered_lines").option("suffix", suffix).option("after", after).load(path)
