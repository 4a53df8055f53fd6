"""Runs steps over batches and streams, with the same rows for both.

A stream's rows wait in a list until the watermark has passed them, then go through the step in order of (ms, ord): order
of arrival doesn't matter, and rows that come after the watermark are dropped and counted by Spark.  Event-time timers do
the rest: one at the least waiting row, and after the last row of a key one at the end of its idle time, when the step's
open rows are reported and all of the key's state is deleted.  So state holds keys that were heard of within the idle time
and rows within the watermark's delay, whatever the history.  A restarted query goes on from its checkpoint.

A batch is sorted by key and order in its partitions and streamed through the step: no key's rows are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from fleetpulse.streaming.steps import Step

#: A key that is silent for half an hour is over.
IDLE_MS = 30 * 60_000

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(value: object) -> object:
    """Python values for what Arrow or pandas made of them; missing values are None."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item") and not isinstance(value, (list, tuple)):
        return value.item()
    return int(value) if isinstance(value, float) and value.is_integer() else value


def _rows(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    return [tuple(_plain(v) for v in r) for r in frame[["ms", "ord", *columns]].itertuples(index=False, name=None)]


def _names(schema: str) -> list[str]:
    return StructType.fromDDL(schema).names


class _Key:
    """A key between rows: its state and the time of its last row."""

    def __init__(self, step: Step, idle_ms: int, state: tuple | None = None, last_ms: int | None = None) -> None:
        self.step, self.idle_ms, self.last_ms = step, idle_ms, last_ms
        self.state = step.start() if state is None else state

    def add(self, row: tuple) -> list[tuple]:
        out = []
        if self.last_ms is not None and row[0] - self.last_ms > self.idle_ms:
            out, self.state = self.step.end(self.state), self.step.start()
        self.state, more = self.step.add(self.state, row)
        self.last_ms = row[0]
        return [*out, *more]

    def end(self) -> list[tuple]:
        return self.step.end(self.state)


def _prepared(rows: DataFrame, keys: list[str], step: Step) -> DataFrame:
    """ord, where there is none, is 0: rows of one ms then have no order."""
    ties = F.col("ord") if "ord" in rows.columns else F.lit(0)
    return rows.select(*keys, F.col("ms").cast("bigint").alias("ms"), ties.cast("bigint").alias("ord"), *step.columns)


def _schema(rows: DataFrame, keys: list[str], step: Step) -> str:
    return ", ".join([f"`{k}` {t}" for k, t in rows.select(*keys).dtypes] + [step.output])


def replay(rows: DataFrame, keys: list[str], step: Step, idle_ms: int = IDLE_MS) -> DataFrame:
    """The step's rows over a batch with the keys, ms, ord (ties of ms) and the step's columns."""
    schema = _schema(rows, keys, step)
    names, n = [*keys, *_names(step.output)], len(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flat() -> Iterator[tuple]:
            for frame in frames:
                heads = [tuple(map(_plain, k)) for k in frame[keys].itertuples(index=False, name=None)]
                yield from zip(heads, _rows(frame, step.columns))

        out: list[tuple] = []
        for head, members in groupby(flat(), key=lambda r: r[0]):
            key = _Key(step, idle_ms)
            for _, row in members:
                out += [(*head, *r) for r in key.add(row)]
                if len(out) >= 5000:
                    yield pd.DataFrame(out, columns=names).astype(object)
                    out = []
            out += [(*head, *r) for r in key.end()]
        yield pd.DataFrame(out, columns=names).astype(object)

    return _prepared(rows, keys, step).repartition(*keys).sortWithinPartitions(*keys, "ms", "ord").mapInPandas(run, schema)


class _Follower(StatefulProcessor):
    def __init__(self, step: Step, idle_ms: int, columns: str, names: list[str]) -> None:
        self.step, self.idle_ms, self.columns, self.names = step, idle_ms, columns, names

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.kept = handle.getValueState("kept", f"last_seen bigint, {self.step.state}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        """Rows wait for the watermark; the timer of the least one wakes the key."""
        least = None
        for frame in rows:
            new = _rows(frame, self.step.columns)
            if new:
                self.waiting.appendList(new)
                least = min([r[0] for r in new] + ([] if least is None else [least]))
        if least is not None:
            self.handle.registerTimer(least)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(map(_plain, r)) for r in self.waiting.get()), key=lambda r: (r[0], r[1] is not None, r[1] or 0)) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= now]
        rest = rows[len(ready):]
        kept = tuple(self.kept.get()) if self.kept.exists() else None
        if kept is None and not ready:
            return
        state = _Key(self.step, self.idle_ms, None if kept is None else kept[1:], None if kept is None else kept[0])
        out = [r for row in ready for r in state.add(row)]
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if not rest and state.last_ms + self.idle_ms < now:
            out += state.end()
            self.kept.clear()
        else:
            if ready:
                self.kept.update((state.last_ms, *state.state))
            self.handle.registerTimer(rest[0][0] if rest else state.last_ms + self.idle_ms + 1)
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=self.names).astype(object)

    def close(self) -> None:
        pass


def follow(rows: DataFrame, keys: list[str], step: Step, late: str = "10 seconds", idle_ms: int = IDLE_MS) -> DataFrame:
    """The same over a stream; needs the RocksDB state store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ready = _prepared(rows, keys, step)
    waiting = ", ".join(f"`{c}` {t}" for c, t in ready.drop(*keys).dtypes)
    timed = ready.withColumn("_ts", F.timestamp_millis("ms")).withWatermark("_ts", late)
    return timed.groupBy(*keys).transformWithStateInPandas(_Follower(step, idle_ms, waiting, [*keys, *_names(step.output)]), _schema(rows, keys, step), "append", "EventTime")
