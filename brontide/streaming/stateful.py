"""Keyed state on streams: legality of a run's steps, idempotency keys with conflicts, numbered events with a bounded tail.

State is held by key in the state store (RocksDB), with the stream's checkpoint:
a restarted query goes on where it was.  Each form gives the rows that its batch
form in operators.ledger gives over all that has arrived.  The events of a key
must arrive in their order; within a batch they are put in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brontide.operators.ledger import TRANSITIONS

#: How many lines of a log, events of a run and runs are held.
LOG_LINES, RUN_EVENTS, RUNS = 400, 2000, 20
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of this kind needs this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _ordered(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")


class _Steps(StatefulProcessor):
    """The last status of a run; each further one is held against it."""

    def __init__(self, run: str, status: str, order: str, allowed: dict[str, tuple[str, ...]]):
        self.run, self.status, self.order, self.allowed = run, status, order, allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        out = []
        for at, now in _ordered(rows, self.order)[[self.order, self.status]].itertuples(index=False, name=None):
            if before is not None and now not in self.allowed.get(before, ()):
                out.append((key[0], at, before, now))
            before = now
        self.last.update((before,))
        yield pd.DataFrame(out, columns=[self.run, self.order, "previous", self.status])

    def close(self) -> None:
        pass


def illegal_steps(events: DataFrame, run: str, status: str, order: str, allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(run, order, previous, status): the steps of a stream whose status may not follow the run's last one."""
    schema = T.StructType([events.schema[run], events.schema[order], T.StructField("previous", T.StringType()), events.schema[status]])
    use_rocksdb(events.sparkSession)
    rows = events.select(run, order, status)
    return rows.groupBy(run).transformWithStateInPandas(_Steps(run, status, order, TRANSITIONS if allowed is None else allowed), schema, "Append", "None")


class _Requests(StatefulProcessor):
    """The first request of a key; a later one is the same or in conflict with it."""

    def __init__(self, key: str, hash_: str, order: str, kinds: str, keep_ms: int | None):
        self.key, self.hash, self.order, self.kinds, self.keep_ms = key, hash_, order, kinds, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", self.kinds, self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = tuple(self.first.get()) if self.first.exists() else None
        out = []
        for at, said in _ordered(rows, self.order)[[self.order, self.hash]].itertuples(index=False, name=None):
            if first is None:
                first, outcome = (at, said), "created"
                self.first.update(first)
            else:
                outcome = "existing" if first[1] == said else "conflict"
            out.append((key[0], at, said, outcome, first[0]))
        yield pd.DataFrame(out, columns=[self.key, self.order, self.hash, "outcome", "first"])

    def close(self) -> None:
        pass


def idempotent_requests(requests: DataFrame, key: str, hash_: str, order: str, keep_ms: int | None = None) -> DataFrame:
    """(key, order, hash, outcome, first): created for a key's first request, then existing, or conflict where another hash comes with the key.

    first is the order of the request that the key stands for.  keep_ms: how long
    after its first request a key is remembered; None for ever.
    """
    kind = requests.schema[order]
    schema = T.StructType([requests.schema[key], kind, requests.schema[hash_], T.StructField("outcome", T.StringType()), T.StructField("first", kind.dataType)])
    kinds = f"at {kind.dataType.simpleString()}, hash {requests.schema[hash_].dataType.simpleString()}"
    use_rocksdb(requests.sparkSession)
    mode = "None" if keep_ms is None else "ProcessingTime"
    return requests.select(key, order, hash_).groupBy(key).transformWithStateInPandas(_Requests(key, hash_, order, kinds, keep_ms), schema, "Append", mode)


class _Tail(StatefulProcessor):
    """Numbers a run's events and holds the last of them."""

    def __init__(self, run: str, order: str, payload: str, kind: str, most: int):
        self.run, self.order, self.payload, self.kind, self.most = run, order, payload, kind, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n bigint")
        self.held = handle.getListState("held", f"payload {self.kind}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        new = _ordered(rows, self.order)[[self.order, self.payload]]
        kept = [*([x[0] for x in self.held.get()] if self.held.exists() else []), *new[self.payload].tolist()][-self.most :]
        self.held.put([(x,) for x in kept])
        total = n + len(new)
        self.count.update((total,))
        out = pd.DataFrame({self.run: key[0], self.order: new[self.order], self.payload: new[self.payload], "sequence": range(n + 1, total + 1), "oldest": total - len(kept) + 1})
        yield out.astype({"sequence": "int64", "oldest": "int64"})

    def close(self) -> None:
        pass


def numbered_tail(events: DataFrame, run: str, order: str, payload: str, most: int = RUN_EVENTS) -> DataFrame:
    """(run, order, payload, sequence, oldest): each event with its gap-free number in its run, and the number of the oldest event still held.

    The state holds a run's last `most` payloads and no more.
    """
    schema = T.StructType([events.schema[run], events.schema[order], events.schema[payload], T.StructField("sequence", T.LongType()), T.StructField("oldest", T.LongType())])
    use_rocksdb(events.sparkSession)
    kind = events.schema[payload].dataType.simpleString()
    return events.select(run, order, payload).groupBy(run).transformWithStateInPandas(_Tail(run, order, payload, kind, most), schema, "Append", "None")
