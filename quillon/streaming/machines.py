"""State machines over events: one definition, run on a stream with event-time timers or over a table.

A machine moves on events and, in states that wait, on its own when the wait ends. On a stream each key keeps its state and what
has come but is not yet due: events are held until the watermark passes them, so they are taken in the order of their times
however they came, and a repeated event (same key, time and id) counts once. Waits are timers of event time. What is behind the
watermark is late and left out. A key whose state is the start again and that holds nothing is dropped from the store, so the
store holds live keys only. The rows are the same as over a table up to the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MOVES = "key string, at long, before string, after string, cause string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Machine:
    """``moves`` (state, event): state; ``waits`` state: (milliseconds, state). Events without a move change nothing."""

    start: str
    moves: dict[tuple[str, str], str]
    waits: dict[str, tuple[int, str]] = field(default_factory=dict)

    def due(self, state: str, since: int) -> int | None:
        """When the state moves on by itself."""
        return since + self.waits[state][0] if state in self.waits else None

    def run(self, state: str, since: int, events: Iterator[tuple[int, str]], until: int | None) -> Iterator[tuple[str, int, str, str, str]]:
        """(state, since, before, after, cause) of each move, over events in order and then waits that end by ``until``. An event at the
        moment a wait ends comes first."""

        def waited(limit, inclusive):
            nonlocal state, since
            while (at := self.due(state, since)) is not None and (at < limit or (inclusive and at == limit)):
                before, state, since = state, self.waits[state][1], at
                yield state, since, before, state, "wait"

        for at, event in events:
            yield from waited(at, False)
            after = self.moves.get((state, event))
            if after is not None:
                before, state, since = state, after, at
                yield state, since, before, after, event
        if until is not None:
            yield from waited(until, True)


class Keyed(StatefulProcessor):
    """A machine for each key: its state and since when, and the events that are not yet due. Calls to the store are a few a key and
    batch, not a few an event: what has come is appended at once, and one timer, for what is due first, takes all that is due."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string, since long")
        self.pending = handle.getListState("pending", "at long, id string, event string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs(), None
        for frame in rows:
            come = [e for e in zip(frame["at"].tolist(), frame["id"].tolist(), frame["event"].tolist(), strict=True) if e[0] > passed]
            if come:
                self.pending.appendList(come)
                first = min(e[0] for e in come) if first is None else min(first, *(e[0] for e in come))
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        state, since = self.state.get() if self.state.exists() else (self.machine.start, 0)
        due, held = {}, {}
        for at, id_, event in self.pending.get() if self.pending.exists() else ():
            (due if at <= passed else held).setdefault((at, id_), event)  # a repeated event counts once
        order = sorted(due, key=lambda k: (k[0], k[1] is not None, k[1] or ""))
        out = []
        for state, since, before, after, cause in self.machine.run(state, since, iter([(k[0], due[k]) for k in order]), passed):  # noqa: B020
            out.append((key[0], since, before, after, cause))
        if due and held:
            self.pending.put([(at, id_, event) for (at, id_), event in held.items()])
        elif due:
            self.pending.clear()
        ends = [at for at, _ in held]
        if state == self.machine.start and self.machine.due(state, since) is None:
            self.state.clear()
        else:
            self.state.update((state, since))
            if (at := self.machine.due(state, since)) is not None and at > passed:
                ends.append(at)
        if ends:
            self.handle.registerTimer(min(ends))
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "before", "after", "cause"])

    def close(self) -> None:
        pass


def _plain(events: DataFrame, key: str, when: str, id_: str, event: str) -> DataFrame:
    return events.where(F.col(key).isNotNull() & F.col(when).isNotNull() & F.col(event).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.unix_millis(F.col(when).cast("timestamp")).alias("at"), F.col(id_).cast("string").alias("id"), F.col(event).cast("string").alias("event"), F.col(when).cast("timestamp").alias("time"))


def on_stream(events: DataFrame, machine: Machine, late: str, key: str, when: str, id_: str, event: str) -> DataFrame:
    """The moves of each key's machine over a stream, MOVES; the session's state store has to be ROCKS (``with_rocks``)."""
    rows = _plain(events, key, when, id_, event).withWatermark("time", late)
    return rows.groupBy("key").transformWithStateInPandas(Keyed(machine), outputStructType=MOVES, outputMode="append", timeMode="eventTime")


def with_rocks(spark) -> None:
    """State that timers and maps need, and that does not have to fit in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _folded(machine: Machine):
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, since, until = None, None, 0, None
        for frame in frames:
            out = []
            for name, group in frame.groupby("key", sort=False):
                if name != key:
                    if key is not None:
                        out += [(key, at, *m) for _, at, *m in machine.run(state, since, iter(()), until)]
                    key, state, since = name, machine.start, 0
                until = int(group["until"].iloc[0])
                for state, since, *move in machine.run(state, since, iter(zip(group["at"], group["event"], strict=True)), None):
                    out.append((key, since, *move))
            yield pd.DataFrame(out, columns=["key", "at", "before", "after", "cause"])
        if key is not None:
            yield pd.DataFrame([(key, at, *m) for _, at, *m in machine.run(state, since, iter(()), until)], columns=["key", "at", "before", "after", "cause"])

    return fold


def on_table(events: DataFrame, machine: Machine, until: DataFrame, key: str, when: str, id_: str, event: str) -> DataFrame:
    """The same moves over a table, up to the one value (milliseconds) of ``until``. Partitions are read key by key in order, batch by
    batch: a task holds one state."""
    rows = _plain(events, key, when, id_, event).dropDuplicates(["key", "at", "id"])
    rows = rows.crossJoin(F.broadcast(until.toDF("until"))).where("at <= until")  # one row
    return rows.select("key", "at", "id", "event", "until").repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(_folded(machine), MOVES)
