"""Stateful streaming on event time: machines that see their rows in order, whatever order the rows arrive in.

Rows wait in state until no earlier row is expected, then run through the same step functions as in batch. Timers on event
time release what still waits when a key falls silent, close what is open, and drop the state of the key. A row that
comes after its place has been passed is not applied but handed out marked as late.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import or_
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from touchline.functions.scan import Step

Finish = Callable[[dict[str, Any], tuple], "pd.DataFrame | None"]


def _plain(value: Any) -> Any:
    """A cell as JSON holds it."""
    if isinstance(value, (np.ndarray, list, tuple)) and not hasattr(value, "asDict"):
        return [_plain(v) for v in value]
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, np.generic):
        return value.item()
    return None if value is pd.NA or value is pd.NaT else value


class OrderedMachine(StatefulProcessor):
    """Runs ``step(state, rows)`` over the rows of a key by ``order``, ``hold_ms`` behind the newest row of the key.

    ``finish(state, key)`` gives the rows of what is open when the key has been silent for ``idle_ms`` or the stream ends. A group is
    a share of the keys: their state is read and written together once in a batch, and one timer stands for the first that falls due.
    """

    def __init__(self, step: Step, keys: Sequence[str], order: Sequence[str], columns: Sequence[tuple[str, str]], names: Sequence[str], hold_ms: int, idle_ms: int,
                 finish: Finish | None = None):
        self.step, self.keys, self.order, self.columns, self.names = step, list(keys), list(order), list(columns), list(names)
        self.hold_ms, self.idle_ms, self.finish = hold_ms, idle_ms, finish

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "name string, ms bigint, cells string")
        self.machines = handle.getListState("machines", "name string, state string, newest bigint, passed bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def _load(self) -> tuple[dict[str, list], dict[str, list]]:
        """By key: its state as JSON (empty before the first step), newest and last applied moment; and its rows that wait."""
        live = {name: list(rest) for name, *rest in self.machines.get()} if self.machines.exists() else {}
        held: dict[str, list] = {}
        for name, ms, cells in self.waiting.get() if self.waiting.exists() else ():
            held.setdefault(name, []).append((ms, cells))
        return live, held

    def _save(self, live: dict[str, list], held: dict[str, list]) -> None:
        waiting = [(name, *row) for name, rows in held.items() for row in rows]
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        self.machines.put([(name, *rest) for name, rest in live.items()]) if live else self.machines.clear()
        before = self.timer.get()[0] if self.timer.exists() else None
        at = min((newest for _, newest, _ in live.values()), default=None)
        at = None if at is None else at + self.idle_ms
        if at != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if at is not None:
                self.handle.registerTimer(at)
            self.timer.update((at,)) if at is not None else self.timer.clear()

    def _rows(self, held: list[tuple[int, str]]) -> pd.DataFrame:
        table = pd.DataFrame([json.loads(cells) for _, cells in held], columns=[c for c, _ in self.columns])
        for name, kind in self.columns:
            if kind == "double":
                table[name] = table[name].astype(float)
        return table.sort_values(self.order, kind="stable").reset_index(drop=True)

    def _run(self, machine: list, held: list[tuple[int, str]]) -> pd.DataFrame | None:
        if not held:
            return None
        out, after = self.step(json.loads(machine[0]) if machine[0] else {}, self._rows(held))
        machine[0] = json.dumps(after)
        return out

    def _told(self, parts: list[pd.DataFrame | None], late: bool) -> Iterator[pd.DataFrame]:
        """The rows of many keys in one frame, every cell as it was."""
        parts = [p for p in parts if p is not None and len(p)]
        if parts:
            yield pd.DataFrame({n: pd.Series([v for p in parts for v in p[n].tolist()], dtype=object) for n in self.names}).assign(late=late)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        if key[0] < 0:
            return
        live, held = self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        done, gone, fresh = [], [], {}
        ms = (new["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist()
        names = [json.dumps([_plain(v) for v in values]) for values in new[self.keys].itertuples(index=False, name=None)]
        for at, (name, m, values) in enumerate(zip(names, ms, new[[c for c, _ in self.columns]].itertuples(index=False, name=None))):
            machine = live.setdefault(name, ["", -(1 << 62), -(1 << 62)])
            if m <= machine[2]:
                gone.append(at)
            else:
                held.setdefault(name, []).append((m, json.dumps([_plain(v) for v in values])))
            fresh[name] = max(m, fresh.get(name, m))
        for name, newest in fresh.items():
            machine = live[name]
            machine[1] = max(machine[1], newest)
            due = max(machine[1] - self.hold_ms, watermark)
            ready = [h for h in held.get(name, ()) if h[0] <= due]
            if ready:
                done.append(self._run(machine, ready))
                machine[2] = max(machine[2], max(m for m, _ in ready))
                held[name] = [h for h in held[name] if h[0] > due]
        self._save(live, held)
        yield from self._told(done, False)
        if gone:
            known, few = {*self.keys, *self.order}, new.iloc[gone]
            yield from self._told([pd.DataFrame({n: pd.Series(few[n].tolist() if n in known else [None] * len(few), dtype=object) for n in self.names})], True)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        live, held = self._load()
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        done = []
        for name in [n for n, (_, newest, _) in live.items() if newest + self.idle_ms <= passed]:
            machine = live.pop(name)
            done.append(self._run(machine, held.pop(name, [])))
            if self.finish and machine[0]:
                done.append(self.finish(json.loads(machine[0]), tuple(json.loads(name))))
        self.timer.clear()
        self._save(live, held)
        yield from self._told(done, False)

    def close(self) -> None:
        pass


#: Shares into which the keys of a machine are dealt.
KEY_SHARES = 256


def ordered_scan(stream: DataFrame, keys: Sequence[str], order: str | Sequence[str], step: Step, schema: str, hold: int = 2000, idle: int = 60000, delay: str = "30 seconds",
                 finish: Finish | None = None, shares: int = KEY_SHARES) -> DataFrame:
    """``touchline.functions.scan`` over a stream with event time ``ts``; its columns and ``late``.

    Rows of a key may come ``hold`` milliseconds out of order and are then applied in order; later ones come back with
    ``late`` true and only their keys and place. Spark itself drops what lies behind the watermark of ``delay``. A key
    silent for ``idle`` milliseconds of event time, which must exceed what its state can still matter for, is closed and forgotten.
    State lies by ``shares`` shares of the keys: calls to the store grow with the shares, not with the keys.
    """
    order = [order] if isinstance(order, str) else list(order)
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    columns = [(f.name, f.dataType.simpleString()) for f in stream.schema.fields if f.name != "ts"]
    machine = OrderedMachine(step, keys, order, columns, names, hold, idle, finish)
    # rows without a key go by themselves: they move the watermark, and nothing else
    nameless = reduce(or_, [F.col(k).isNull() for k in keys])
    share = F.when(nameless, F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(*keys), F.lit(shares)).cast("long"))
    dealt = stream.withWatermark("ts", delay).withColumn("_share", share).groupBy("_share")
    return dealt.transformWithStateInPandas(machine, f"{schema}, late boolean", "append", "EventTime")


class Retention(StatefulProcessor):
    """Keeps the rows of one moment and share of the keys until ``keep_ms`` of event time have passed; then one timer gives them all up, for good."""

    def __init__(self, key: str, name: str, keep_ms: int):
        self.key, self.name, self.keep_ms = key, name, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "keys array<bigint>, ids array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for new in rows:
            self.kept.appendValue(tuple([None if pd.isna(v) else int(v) for v in new[c]] for c in (self.key, self.name)))
        self.handle.registerTimer(int(key[0]) + self.keep_ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        for keys, ids in self.kept.get():
            yield pd.DataFrame({c: pd.array(list(v), dtype="Int64") for c, v in ((self.key, keys), (self.name, ids))})
        self.kept.clear()

    def close(self) -> None:
        pass


#: Shares into which the rows of one moment are dealt by key.
SHARES = 16


def expired(stream: DataFrame, key: str, name: str, keep_ms: int, delay: str = "1 second") -> DataFrame:
    """``key, name`` of the rows (both whole numbers) that the watermark has left behind by ``keep_ms``; only younger ones stay in state.

    State is kept by moment (milliseconds) and share of the keys, not by key: rows that fall due together have one timer, and no state is rewritten. Rows
    without a time never fall due and are not kept.
    """
    dealt = stream.filter("ts IS NOT NULL").withWatermark("ts", delay).withColumn("_ms", F.unix_millis("ts")).withColumn("_share", F.pmod(F.xxhash64(key), F.lit(SHARES)))
    return dealt.groupBy("_ms", "_share").transformWithStateInPandas(Retention(key, name, keep_ms), f"{key} bigint, {name} bigint", "append", "EventTime")
