"""Keyed automata on ``transformWithState``: typed state, event-time timers, rows in event-time order.

The RocksDB state store has to be configured (:func:`wardline.streaming.replay.run_to_table` does so).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ORDER = ["ts_us", "seq"]
PIECE_ROWS, PART_ROWS = 1_000, 10_000

#: ``fold(key, memory, rows) -> (memory, result rows)``: the state of a key as a list of tuples, rows by (ts_us, seq)
Fold = Callable[[tuple, list[tuple], pd.DataFrame], tuple[list[tuple], list[tuple]]]


class InOrder(StatefulProcessor):
    """Folds the rows of a key in event-time order; the memory of a key is a list state.

    Spark hands a key over in chunks.  A single chunk is sorted and folded.  Of several, each is sorted and laid aside in
    pieces in a map state, and the pieces are merged, so a task holds one piece of every chunk and never the whole key.
    The parts that are folded grow with what the merge holds: a key has few of them, however long and sparse it is.
    With ``keep_ms`` the memory goes once the watermark is that far past the newest row of the key.
    """

    def __init__(self, fold: Fold, memory: str, row: str, out: list[str], keep_ms: int | None) -> None:
        self.fold, self.memory_kind, self.out, self.keep_ms = fold, memory, out, keep_ms
        self.columns = [c.strip().split(" ", 1) for c in row.split(",")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getListState("memory", self.memory_kind)
        self.aside = handle.getMapState("aside", "start bigint, chunk int", ", ".join(f"{n} array<{k}>" for n, k in self.columns))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, second = next(rows, None), next(rows, None)
        if first is None:
            return
        memory = [tuple(m) for m in self.memory.get()] if self.memory.exists() else []
        newest = 0
        for part in [first.sort_values(ORDER)] if second is None else self._merged(chain([first, second], rows)):
            newest = max(newest, int(part["ts_us"].max()))
            memory, found = self.fold(key, memory, part)
            if found:
                yield pd.DataFrame(found, columns=self.out)
        if memory:
            self.memory.put(memory)
        else:
            self.memory.clear()
        if self.keep_ms is not None:
            self._drop_at(max(newest // 1000 + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def _merged(self, chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [n for n, _ in self.columns]
        pieces: list[tuple] = []
        for k, chunk in enumerate(chunks):
            chunk = chunk[chunk["ts_us"].notna()].sort_values(ORDER)
            for start in range(0, len(chunk), PIECE_ROWS):
                rows = chunk.iloc[start:start + PIECE_ROWS]
                self.aside.updateValue((start, k), tuple([_plain(v) for v in rows[n]] for n in names))
                ts, seq = rows["ts_us"].iat[0], rows["seq"].iat[0]
                pieces.append((int(ts), math.inf if pd.isna(seq) else int(seq), start, k))
        pieces.sort()
        held, n_held, enough = [], 0, PART_ROWS
        for i, (_, _, start, k) in enumerate(pieces):
            held.append(pd.DataFrame(dict(zip(names, self.aside.getValue((start, k))))))
            self.aside.removeKey((start, k))
            n_held += len(held[-1])
            last = i + 1 == len(pieces)
            if n_held < enough and not last:
                continue
            rows = pd.concat(held, ignore_index=True).sort_values(ORDER)
            if last:
                yield rows
                return
            # no row of a later piece comes before that piece's first one
            ts, seq = pieces[i + 1][:2]
            done = (rows["ts_us"] < ts) | ((rows["ts_us"] == ts) & (rows["seq"] < seq))
            held, n_held = [rows[~done]], int((~done).sum())
            enough = max(PART_ROWS, 2 * n_held)
            if done.any():
                yield rows[done]

    def _drop_at(self, ms: int) -> None:
        """One timer a key, never moved back by late rows."""
        timers = list(self.handle.listTimers())
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max([ms, *timers]))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.memory.clear()
        return iter(())

    def close(self) -> None:
        pass


def _plain(value):
    """A value of a data frame as the state store takes it."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    return None if isinstance(value, float) and value != value else value


def in_order(df: DataFrame, keys: list[str], row: str, memory: str, out: str, fold: Fold, keep_ms: int | None = None) -> DataFrame:
    """``fold`` over the rows of each key in event-time order; ``row``, ``memory`` and ``out`` are schemas.

    ``df`` has the watermarked time ``ts`` and the columns ``ts_us`` and ``seq``, which ``row`` must list.
    """
    names = [c.strip().split(" ")[0] for c in row.split(",")]
    results = [c.strip().split(" ")[0] for c in out.split(",")]
    processor = InOrder(fold, memory, row, results, keep_ms)
    return df.select(*keys, "ts", *names).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="None" if keep_ms is None else "EventTime")


MINUTE_US = 60_000_000


class AsOf(StatefulProcessor):
    """Pairs every lookup with the latest earlier source of its key, at most ``window_us`` old.

    Rows (ts_us, seq, edge_type, node_id) wait in slots of the window's length; a source has no edge_type.  A lookup is
    answered once the watermark is ``window_us`` past the end of its minute, when no earlier source can come any more.
    A task holds one slot of a key, and a row is paired with one source at most.
    """

    def __init__(self, window_us: int) -> None:
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "slot bigint, part bigint", ", ".join(f"{n} array<{k}>" for n, k in AS_OF_ROW))
        self.parts = handle.getValueState("parts", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = self.parts.get()[0] if self.parts.exists() else 0
        oldest = None
        for chunk in rows:
            for slot, some in chunk.groupby(chunk["ts_us"] // self.window_us):
                self._put(int(slot), part, list(zip(*([_plain(v) for v in some[n]] for n, _ in AS_OF_ROW))))
            part, first = part + 1, int(chunk["ts_us"].min())
            oldest = first if oldest is None else min(oldest, first)
        self.parts.update((part,))
        if oldest is not None:
            self._wake(self._due_ms(oldest), timerValues)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000 - self.window_us
        # lookups still to come or to be answered are younger than this by the window at least
        needed = closed - MINUTE_US - self.window_us
        slots: dict[int, list[int]] = {}
        for slot, part in list(self.rows.keys()):
            slots.setdefault(slot, []).append(part)
        wake, source = [], None
        for slot in sorted(slots):
            if slot * self.window_us > closed:
                wake.append(self._due_ms(slot * self.window_us))
                break
            rows = sorted((r for p in slots[slot] for r in zip(*self.rows.getValue((slot, p)))), key=lambda r: (r[0], r[1], r[2] is None))
            kept, found = [], []
            for row in rows:
                ts, seq, kind, node = row
                if kind is None:
                    source = row
                    if ts >= needed:
                        kept.append(row)
                        wake.append((ts + 2 * self.window_us + MINUTE_US) // 1000)
                elif (ts // MINUTE_US + 1) * MINUTE_US > closed:
                    kept.append(row)
                    wake.append(self._due_ms(ts))
                elif source is not None and ts - source[0] <= self.window_us:
                    found.append((*key, source[3], node, kind, ts, source[0], source[1]))
            if len(kept) < len(rows):
                for p in slots[slot]:
                    self.rows.removeKey((slot, p))
                if kept:
                    self._put(slot, slots[slot][0], kept)
            if found:
                yield pd.DataFrame(found, columns=AS_OF_OUT)
        if wake:
            self._wake(min(wake), timerValues)
        else:
            self.parts.clear()

    def _put(self, slot: int, part: int, rows: list[tuple]) -> None:
        self.rows.updateValue((slot, part), tuple(list(column) for column in zip(*rows)))

    def _due_ms(self, ts_us: int) -> int:
        return ((ts_us // MINUTE_US + 1) * MINUTE_US + self.window_us) // 1000

    def _wake(self, ms: int, timerValues) -> None:
        """One timer a key, the earliest."""
        now = timerValues.getCurrentWatermarkInMs()
        ahead = [t for t in self.handle.listTimers() if t > now]
        for t in ahead:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(now + 1, min([ms, *ahead])))

    def close(self) -> None:
        pass


AS_OF_ROW = [("ts_us", "bigint"), ("seq", "bigint"), ("edge_type", "string"), ("node_id", "string")]
AS_OF_OUT = ["host", "pid", "src", "dst", "edge_type", "ts_us", "src_us", "src_seq"]


def as_of(rows: DataFrame, window_us: int) -> DataFrame:
    """Lookups of (host, pid) with the latest earlier source; ``rows`` has the watermarked time ``ts`` and the columns of a row."""
    names = [n for n, _ in AS_OF_ROW]
    return rows.select("host", "pid", "ts", *names).groupBy("host", "pid").transformWithStateInPandas(
        statefulProcessor=AsOf(window_us), outputMode="Append", timeMode="EventTime",
        outputStructType="host string, pid bigint, src string, dst string, edge_type string, ts_us bigint, src_us bigint, src_seq bigint")
