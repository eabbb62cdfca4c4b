"""Streams that act when time has passed: rows that settle and sessions that end, and a window of raw rows read again at each tick.

Both keep their state in Spark's state store by key (transformWithState), with timers in event time. A timer fires once the watermark
has passed it, so what it does depends on the rows' own times and not on when they were read: a restart from the checkpoint goes on as if
there had been none. Null keys are a key of their own; rows with a null time are left out; repeated rows count each. An empty stream gives
nothing. The session's state store provider must be RocksDB's, as `stateful` sets it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewater.streaming.fold import RECENT, Row, fold

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds after which an unchanged row settles, and a session without a span is over.
SETTLE, OVER = 5_000, 60_000

CHANGES = "session bigint, idx bigint, text string, start double, end double, revisions bigint, open boolean, event string, at bigint"


def stateful(spark: SparkSession) -> None:
    """Timers and list state need this provider; a session that has another by choice is left alone."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in spark.conf.get(key):
        spark.conf.set(key, PROVIDER)


class Settling(StatefulProcessor):
    """Folds spans into rows; a row unchanged for `settle` ms settles, and a session silent for `over` ms ends: what is left settles and
    the state is freed. State holds the rows that a span can still reach, and those that haven't settled."""

    def __init__(self, settle: int, over: int):
        self.settle, self.over = settle, over

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "idx bigint, text string, start double, end double, revisions bigint, open boolean, changed bigint, settled boolean")
        self.last = handle.getValueState("last", "at bigint")

    def held(self) -> tuple[list[Row], dict[int, list]]:
        """Rows, and by idx when each changed and whether it has settled."""
        got = sorted(self.rows.get()) if self.rows.exists() else []
        return [Row(*r[:6]) for r in got], {r[0]: [r[6], r[7]] for r in got}

    def keep(self, rows: list[Row], about: dict[int, list]) -> None:
        kept = [r for k, r in enumerate(rows) if k >= len(rows) - RECENT or not about[r.idx][1]]
        if kept:
            self.rows.put([(*r, *about[r.idx]) for r in kept])
        else:
            self.rows.clear()

    def out(self, key: tuple, rows: list[tuple[Row, str, int]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r, event, at) for r, event, at in rows], columns=[c.split()[0] for c in CHANGES.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mine, about = self.held()
        heard = pd.concat(list(rows)).sort_values(["at", "window_end", "start", "end", "text"])
        changed: dict[int, tuple[Row, int]] = {}
        for s in heard.itertuples(index=False):
            row = fold(mine, s.text, s.start, s.end, s.window_end)
            if row is not None:
                about[row.idx], changed[row.idx] = [int(s.at), False], (row, int(s.at))
        last = max(int(heard["at"].max()), self.last.get()[0] if self.last.exists() else 0)
        for at in {at + self.settle for _, at in changed.values()} | {last + self.over}:
            self.handle.registerTimer(at)
        self.last.update((last,))
        self.keep(mine, about)
        if changed:
            yield self.out(key, [(row, "change", at) for row, at in changed.values()])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        mine, about = self.held()
        ends = self.last.exists() and self.last.get()[0] + self.over <= now
        due = [k for k, r in enumerate(mine) if not about[r.idx][1] and (ends or about[r.idx][0] + self.settle <= now)]
        for k in due:
            mine[k], about[mine[k].idx][1] = mine[k]._replace(open=False), True
        if ends:
            self.rows.clear()
            self.last.clear()
            for at in list(self.handle.listTimers()):
                if at != now:
                    self.handle.deleteTimer(at)
        else:
            self.keep(mine, about)
        # When a row settles, or a session ends, is told by the rows; not by when the timer came to be handled.
        if due:
            yield self.out(key, [(mine[k], "finish" if ends else "settle", now) for k in due])

    def close(self) -> None:
        pass


def settling(spans: DataFrame, late: str = "10 seconds", settle: int = SETTLE, over: int = OVER) -> DataFrame:
    """spans (session, text, start, end, window_end, ts), streaming -> a changelog: each row as it changes, as it settles, or as its session
    finishes, with the event time of that. A session that goes on after its end begins anew."""
    stateful(spans.sparkSession)
    rows = spans.where("ts is not null").withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return rows.groupBy("session").transformWithStateInPandas(Settling(settle, over), CHANGES, "append", "eventTime")


class Ticking(StatefulProcessor):
    """Holds the raw rows of the last `size` ms, `most` of them at most, the newest; reads them again at each multiple of `step`, but not
    within `apart` ms of the last time that it did."""

    def __init__(self, size: int, step: int, most: int, apart: int):
        self.size, self.step, self.most, self.apart = size, step, most, apart

    def init(self, handle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "at bigint, value string")
        self.told = handle.getValueState("told", "at bigint, lost bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [*map(tuple, self.ring.get())] if self.ring.exists() else []
        fresh = [(int(a), v) for f in rows for a, v in zip(f["at"], f["value"], strict=True)]
        held = sorted([*held, *fresh], key=lambda r: (r[0], r[1] or ""))
        told, lost = self.told.get() if self.told.exists() else (-(1 << 62), 0)
        lost += max(0, len(held) - self.most)
        self.ring.put(held[-self.most :])
        self.told.update((told, lost))
        # Every tick that will read a row, as timers that are set while others fire wait for the next batch.
        for at in {(a // self.step + k) * self.step for a, _ in fresh for k in range(1, -(-self.size // self.step) + 1)}:
            self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tick = expiredTimerInfo.getExpiryTimeInMs()
        held = [*map(tuple, self.ring.get())] if self.ring.exists() else []
        told, lost = self.told.get() if self.told.exists() else (-(1 << 62), 0)
        here = [r for r in held if tick - self.size <= r[0] < tick]
        later = [r for r in held if r[0] >= tick + self.step - self.size]
        said = here and tick - told >= self.apart
        if later:
            self.ring.put(later)
            self.told.update((tick, 0) if said else (told, lost))
        else:
            self.ring.clear()
            self.told.update((tick, 0)) if said else None
        if said:
            yield pd.DataFrame({"key": [key[0]], "tick": [tick], "n": [len(here)], "lost": [lost], "text": [" ".join(v for _, v in here if v is not None)]})

    def close(self) -> None:
        pass


def ticking(rows: DataFrame, size: int, step: int, late: str = "10 seconds", most: int = 10_000, apart: int = 0) -> DataFrame:
    """rows (key, value, ts), streaming -> for each key and tick (ms, a multiple of step) with rows in the size ms before it: n, how many were
    lost to the bound, and the values in order of time joined by spaces. size is at least step."""
    stateful(rows.sparkSession)
    kind = rows.schema["key"].dataType.simpleString()
    base = rows.where("ts is not null").withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return base.groupBy("key").transformWithStateInPandas(Ticking(size, step, most, apart), f"key {kind}, tick bigint, n bigint, lost bigint, text string", "append", "eventTime")
