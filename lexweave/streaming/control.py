"""Request control over a stream: the decisions of a replay, made as events come, in whatever order within the watermark.

A key's events wait until the watermark has passed them, as after that none can come before them. One timer, at the first event that waits, wakes
the key, which takes all that are due in order, forgets them and sets the timer anew; its state is a short text. Both are kept by RocksDB, so what waits need not fit
in memory, and a restarted stream goes on where it stopped. Events later than the watermark allows are dropped.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexweave.operators.control import COLUMNS, DECISION, Control, Event, Limits, plain

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB: a stream takes its settings along when it starts, and the session gets its own back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


#: What waits, and how many of these a part holds at most.
WAITING = pa.schema([("us", pa.int64()), ("id", pa.int64()), ("tokens", pa.int64()), ("elapsed", pa.float64()), ("kind", pa.string()), ("pause", pa.float64())])
BATCH = 10_000


def packed(events: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, events.schema) as out:
        out.write_table(events)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(value)).read_all()


class _Processor(StatefulProcessor):
    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a part of the input each, as an Arrow stream: an event each would cost a row of state each
        self.waiting = handle.getListState("waiting", "events binary")
        self.control = handle.getValueState("control", "saved string, first long")

    def _known(self) -> tuple[str | None, int | None]:
        return tuple(self.control.get()) if self.control.exists() else (None, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (names of the interface)
        saved, before = self._known()
        first = before
        for part in rows:
            if len(part):
                self.waiting.appendValue((packed(pa.Table.from_pandas(part[WAITING.names], WAITING, preserve_index=False)),))
                first = min(int(part["us"].min()), first if first is not None else int(part["us"].min()))
        if first != before:
            self._wake(first)
            self.control.update((saved, first))
        return iter(())

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        saved, first = self._known()
        if first is None or first > mark:
            return  # an earlier timer of this batch has taken what was due
        waiting = pa.concat_tables([unpacked(r[0]) for r in self.waiting.get()]).sort_by([("us", "ascending"), ("id", "ascending")])
        n = int(np.searchsorted(waiting["us"].to_numpy(), mark, "right"))
        due, left = waiting.slice(0, n), waiting.slice(n)
        control = Control(self.limits, saved)

        def events() -> Iterator[Event]:
            for part in due.to_batches(BATCH):
                yield from plain(part.to_pandas())

        decided = control.run(events())
        while out := [(key[0], *d) for d in islice(decided, BATCH)]:
            yield pd.DataFrame(out, columns=COLUMNS)
        first = left["us"][0].as_py() if left.num_rows else None
        if first is None:
            self.waiting.clear()
        else:
            self.waiting.put([(packed(pa.Table.from_batches([b])),) for b in left.combine_chunks().to_batches(BATCH)])
            self._wake(first)
        self.control.update((control.saved(), first))

    def close(self) -> None:
        pass


def controlled(found: DataFrame, limits: Limits, late: str = "10 minutes") -> DataFrame:
    """(key, and DECISION) on a stream of events, as control.events() makes them. To be started within rocksdb()."""
    own = found.withWatermark("ts", late).groupBy("key")
    return own.transformWithStateInPandas(statefulProcessor=_Processor(limits), outputStructType=f"key string, {DECISION}", outputMode="Append", timeMode="EventTime")
