"""Sinks that put all of a job's rows in place, or none of them.

Tasks write below a folder of the job's own, `_staged`, and only the driver, when
every task has ended, puts that in place: first it marks the folder as ready, then
moves what is in it.  A job that fails is taken back by removing its folder, and
old files stay as they were; a task that is still running then may stage a file
more, which no reader takes for a document.  If the driver dies between the mark and the last
move, `recover` finishes the moves, which may be repeated; what has no mark it
removes.

Two layouts: "documents", a JSON file for each row, of which the newest replaces
an older one of its id and type; and "split", a folder of JSON lines for each
target, which is replaced as a whole.
"""

from __future__ import annotations

import datetime
import decimal
import json
import uuid
from collections import Counter
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGED, READY = "_staged", "_ready"
UNKNOWN = "_unknown"


class EmptyTarget(ValueError):
    """A target that must have rows has none."""


@dataclass
class Written(WriterCommitMessage):
    """How many rows of each target a task has written."""

    rows: dict = field(default_factory=dict)
    task: str = ""


def _json(value):
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    raise TypeError(f"{type(value).__name__} has no JSON form")


def _plain(value):
    """A row's values as what JSON has: rows become objects."""
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class StagedWriter(DataSourceWriter):
    """Writes rows below the job's folder; commit moves them."""

    def __init__(self, options: dict[str, str]):
        self.path, self.by = options["path"].rstrip("/"), options.get("by", "api_type")
        self.id, self.layout = options.get("id", "api_id"), options.get("layout", "documents")
        self.targets = [t for t in options.get("targets", "").split(",") if t]
        self.job = uuid.uuid4().hex
        if self.layout not in ("documents", "split"):
            raise ValueError(f"no layout {self.layout}")

    def _target(self, row) -> str:
        kind = row[self.by]
        kind = UNKNOWN if kind is None or str(kind) == "" else str(kind)
        return UNKNOWN if self.targets and kind not in self.targets else kind

    def write(self, iterator):
        store, base = _place(self.path)
        context = TaskContext.get()
        mine = f"{base}/{STAGED}/{self.job}/{context.partitionId()}-{context.taskAttemptId()}"
        rows, open_ = Counter(), {}
        for row in iterator:
            target = self._target(row)
            rows[target] += 1
            if target == UNKNOWN and self.targets:
                continue  # counted, not written
            if any(c in target for c in "/\\") or target.startswith((".", "_")) and target != UNKNOWN:
                raise ValueError(f"{target!r} can't name a folder")
            line = json.dumps(_plain(row), ensure_ascii=False, default=_json).encode()
            folder = f"{mine}/{target}"
            if self.layout == "documents":
                name = str(row[self.id])
                if row[self.id] is None or not name or any(c in name for c in "/\\") or name.startswith("."):
                    raise ValueError(f"{name!r} can't name a document")
                store.create_dir(folder)
                with store.open_output_stream(f"{folder}/{name}.json") as f:
                    f.write(line)
            else:
                if target not in open_:
                    store.create_dir(folder)
                    open_[target] = store.open_output_stream(f"{folder}/part-{context.partitionId():05d}.json")
                open_[target].write(line + b"\n")
        for f in open_.values():
            f.close()
        return Written(dict(rows), f"{context.partitionId()}-{context.taskAttemptId()}")

    def commit(self, messages):
        store, base = _place(self.path)
        total = Counter()
        for m in messages:
            total.update(m.rows if m else {})
        empty = [t for t in self.targets if not total[t]]
        if empty:
            self.abort(messages)
            raise EmptyTarget(f"no rows for {', '.join(empty)}")
        folder = f"{base}/{STAGED}/{self.job}"
        store.create_dir(folder)
        said = {"layout": self.layout, "tasks": [m.task for m in messages if m], "rows": total}
        with store.open_output_stream(f"{folder}/{READY}.part") as f:
            f.write(json.dumps(said).encode())
        store.move(f"{folder}/{READY}.part", f"{folder}/{READY}")
        _finish(store, base, self.job)

    def abort(self, messages):
        store, base = _place(self.path)
        _drop(store, f"{base}/{STAGED}/{self.job}")
        _tidy(store, base)


def _drop(store, folder: str) -> None:
    from pyarrow import fs

    if store.get_file_info(folder).type == fs.FileType.Directory:
        store.delete_dir(folder)


def _tidy(store, base: str) -> None:
    """Removes the folder of jobs when no job is in it."""
    from pyarrow import fs

    if not store.get_file_info(fs.FileSelector(f"{base}/{STAGED}", allow_not_found=True)):
        _drop(store, f"{base}/{STAGED}")


def _finish(store, base: str, job: str) -> None:
    """Moves what a job that is ready has staged.  It may be broken off and begun again."""
    from pyarrow import fs

    folder = f"{base}/{STAGED}/{job}"
    with store.open_input_stream(f"{folder}/{READY}") as f:
        said = json.loads(f.read())
    found = [x for x in store.get_file_info(fs.FileSelector(folder, recursive=True)) if x.type == fs.FileType.File]
    for x in sorted(found, key=lambda x: x.path):
        task, _, rest = x.path[len(folder) + 1 :].partition("/")
        if not rest or task not in said["tasks"]:
            continue  # the mark, or an attempt that another one has replaced
        target, _, name = rest.partition("/")
        store.create_dir(f"{base}/{target}")
        store.move(x.path, f"{base}/{target}/{job}-{name}" if said["layout"] == "split" else f"{base}/{target}/{name}")
    if said["layout"] == "split":
        for target in said["rows"]:
            for old in store.get_file_info(fs.FileSelector(f"{base}/{target}", allow_not_found=True)):
                if not old.base_name.startswith(f"{job}-"):
                    store.delete_file(old.path)
    _drop(store, folder)
    _tidy(store, base)


def recover(path: str) -> tuple[int, int]:
    """Finishes the jobs below path that were ready and takes back the others: (finished, removed).  No job may be running."""
    from pyarrow import fs

    store, base = _place(path.rstrip("/"))
    done = gone = 0
    for x in store.get_file_info(fs.FileSelector(f"{base}/{STAGED}", allow_not_found=True)):
        if store.get_file_info(f"{x.path}/{READY}").type == fs.FileType.File:
            _finish(store, base, x.base_name)
            done += 1
        else:
            _drop(store, x.path)
            gone += 1
    _tidy(store, base)
    return done, gone


class StagedSink(DataSource):
    """The format "staged": options path, layout, by (the column of types), id, targets (joined by commas)."""

    @classmethod
    def name(cls) -> str:
        return "staged"

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return StagedWriter(dict(self.options))


def write_documents(df: DataFrame, path: str, by: str = "api_type", id: str = "api_id") -> None:
    """A JSON file `<type>/<id>.json` for each row; the ids are unique.  A file of the same name is replaced, others stay; all of it or nothing.

    Rows without a type go to `_unknown`.  An id or type that can't name a file fails the job.
    """
    _save(df, path, layout="documents", by=by, id=id)


def write_split(df: DataFrame, path: str, by: str, targets: list[str]) -> None:
    """JSON lines in a folder for each target, each replaced as a whole; all of it or nothing.

    Rows of other types are counted as `_unknown` and not written.  A target
    without rows raises EmptyTarget, and every old file stays.
    """
    _save(df, path, layout="split", by=by, targets=",".join(targets))


def _save(df: DataFrame, path: str, **options: str) -> None:
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(StagedSink)
    df.write.format("staged").mode("append").options(**options).save(path)
