"""Decisions on scans as a stream: cooldown, scans in flight, duplicate boxes, the recent list, with state that expires.

Scans of a key wait in slots of time until the watermark has passed a slot's end; its timer then takes the slot's scans in the
order of time and decides each. So results don't depend on which micro-batch a scan came in, or on the order of its rows.
State goes when nothing can depend on it any more: slots once they are decided, boxes after ``remember``, the rest
after the longest of its times. Rows are taken chunk by chunk as they come and never put together.

Every call of the state store is a message to another process, so a key has one timer, one value of its own and its waiting
scans in spans of ``together`` slots: the messages grow with a key's spans in a micro-batch, not with its scans. A task holds
the scans of one span of one key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SECOND = 1_000_000

#: Columns of a scan besides its key: ts (timestamp), tie (long), whether it is readable, of a known product, a restock,
#: forced; item and box (strings), and how long its processing keeps its key in flight.
COLUMNS = ("ts", "tie", "readable", "known", "restock", "forced", "item", "box", "busy_seconds")
#: The same as they are kept, with microseconds for the time.
SCAN = ("t", *COLUMNS[1:])


@dataclass(frozen=True)
class Rules:
    """Times in seconds. lifetime: of an item on the recent list; delay: until it may be scanned again after that; together: slots that wait side by side."""

    cooldown: int = 2
    lifetime: int = 15
    delay: int = 2
    capacity: int = 3
    remember: int = 365 * 86400
    slot: int = 60
    together: int = 8


@dataclass
class Known:
    """What is known of a key. recent: [item, time] of what is on the list or not yet released, the newest first."""

    last: int | None = None
    busy: int | None = None
    recent: list[list] = field(default_factory=list)


def decide_scan(known: Known, boxes: dict, scan: dict, rules: Rules) -> str:
    """The decision on one scan, and what is known after it (ST1-ST4). boxes: the times of boxes, asked for by name."""
    now = scan["t"]
    if not scan["readable"]:
        return "warning"
    free = (known.busy is None or now >= known.busy) and (known.last is None or now - known.last >= rules.cooldown * SECOND)
    if not (scan["forced"] or free):
        return "ignored"
    known.last, known.busy = now, now + scan["busy_seconds"] * SECOND
    known.recent = [x for x in known.recent if now - x[1] < (rules.lifetime + rules.delay) * SECOND]
    listed = any(x[0] == scan["item"] for x in known.recent)
    if not scan["restock"] and listed and not scan["forced"]:
        return "ignored"
    if not scan["known"]:
        return "not_found"
    if scan["restock"]:
        if scan["box"] is not None:
            added = boxes.get(scan["box"])
            if added is not None and now - added < rules.remember * SECOND:
                return "duplicate"
            boxes[scan["box"]] = now
        return "added"
    others = [x for x in known.recent if x[0] != scan["item"]]
    shown = sum(now - x[1] < rules.lifetime * SECOND for x in others)
    if shown >= rules.capacity:
        del others[rules.capacity - 1]
    known.recent = [[scan["item"], now], *others]
    return "replaced" if listed else "success"


class _Boxes:
    """The boxes of a key in the state store; each is asked for once and written once in a call."""

    def __init__(self, state):
        self.state, self.held, self.changed = state, {}, set()

    def get(self, box: str) -> int | None:
        if box not in self.held:
            found = self.state.getValue((box,))
            self.held[box] = None if found is None else found[0]
        return self.held[box]

    def __setitem__(self, box: str, at: int) -> None:
        self.held[box] = at
        self.changed.add(box)

    def write(self) -> None:
        for box in sorted(self.changed):
            self.state.updateValue((box,), (self.held[box],))
        self.held, self.changed = {}, set()

    def forget(self, before: int) -> bool:
        """Drop boxes from before that time; whether any is left."""
        found = list(self.state.iterator())
        for (box,), (at,) in found:
            if at <= before:
                self.state.removeKey((box,))
        return any(at > before for _, (at,) in found)


@dataclass
class Held:
    """A key's own state, read and written once in a call.

    spans: of each span of slots with scans that wait, the end of the first such slot and the number of parts that hold them.
    timer: the only one of the key. sweep: when what is too old is dropped next. Both in milliseconds.
    """

    known: Known = field(default_factory=Known)
    spans: dict[int, list[int]] = field(default_factory=dict)
    timer: int | None = None
    sweep: int | None = None


class Decider(StatefulProcessor):
    def __init__(self, key: str, key_type: T.DataType, rules: Rules):
        self.key, self.key_type, self.rules = key, key_type, rules
        self.size = rules.slot * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "last long, busy long, recent string, spans string, timer long, sweep long")
        self.boxes = _Boxes(handle.getMapState("boxes", "box string", "at long"))
        self.waiting = handle.getMapState("waiting", "span long, part long", "scans string")

    def _read(self) -> Held:
        found = self.held.get()
        if found is None:
            return Held()
        last, busy, recent, spans, timer, sweep = found
        return Held(Known(last, busy, json.loads(recent)), {int(k): v for k, v in json.loads(spans).items()}, timer, sweep)

    def _write(self, held: Held) -> None:
        """Keep a key's state, with its timer at the next time when something is to be done."""
        due = min((t for t in (held.sweep, *(first for first, _ in held.spans.values())) if t is not None), default=None)
        if due != held.timer:
            if held.timer is not None:
                self.handle.deleteTimer(held.timer)
            if due is not None:
                self.handle.registerTimer(due)
            held.timer = due
        known = held.known
        self.held.update((known.last, known.busy, json.dumps(known.recent), json.dumps(held.spans), held.timer, held.sweep))

    def _wait(self, held: Held, span: int, scans: list[list]) -> None:
        """Lay scans (t first) beside those that wait in a span."""
        first, parts = held.spans.get(span, (None, 0))
        end = (min(s[0] for s in scans) // (self.size * 1000) + 1) * self.size
        self.waiting.updateValue((span, parts), (json.dumps(scans),))
        held.spans[span] = [end if first is None else min(first, end), parts + 1]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, held, wide = timerValues.getCurrentWatermarkInMs(), self._read(), self.size * 1000 * self.rules.together
        for chunk in rows:
            spans: dict[int, list[list]] = {}
            for scan in zip(*(chunk[c].tolist() for c in SCAN), strict=True):
                t = scan[0]
                # Without a time, or too late: the slot is decided.
                if t == t and (int(t) // (self.size * 1000) + 1) * self.size > passed:
                    spans.setdefault(int(t) // wide, []).append([int(t), *scan[1:]])
            for span, scans in spans.items():
                self._wait(held, span, scans)
        self._write(held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, held = timerValues.getCurrentWatermarkInMs(), self._read()
        if held.timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        # The timer has fired, so it is gone. Scans from this time on are not decided yet; all others are after this call.
        held.timer, bound = None, passed // self.size * self.size
        for span in sorted(s for s, (first, _) in held.spans.items() if first <= passed):
            scans = self._due(held, span, bound * 1000)
            decisions = [decide_scan(held.known, self.boxes, scan, self.rules) for scan in scans]
            self.boxes.write()
            yield pd.DataFrame({self.key: [key[0]] * len(scans), "tie": [s["tie"] for s in scans], "decision": decisions})
        self._expire(held, bound)

    def _due(self, held: Held, span: int, before: int) -> list[dict]:
        """The scans of a span from before that time, sorted; the others go on waiting."""
        found = [scan for part in range(held.spans[span][1]) for scan in json.loads(self.waiting.getValue((span, part))[0])]
        for part in range(held.spans.pop(span)[1]):
            self.waiting.removeKey((span, part))
        if later := [s for s in found if s[0] >= before]:
            self._wait(held, span, later)
        return sorted((dict(zip(SCAN, s, strict=True)) for s in found if s[0] < before), key=lambda s: (s["t"], s["tie"]))

    def _expire(self, held: Held, bound: int) -> None:
        """Keep a key's state after scans from before that time are decided, without what no later scan can depend on."""
        r, known = self.rules, held.known
        # A slot more, so that no timer is set for a time that has passed.
        longest = -(-1000 * max(r.cooldown, r.lifetime + r.delay, r.remember) // self.size) * self.size + self.size
        idle = (known.last is None or bound * 1000 - known.last >= longest * 1000) and (known.busy is None or known.busy <= bound * 1000)
        if idle or (held.sweep is not None and held.sweep <= bound):
            left = self.boxes.forget(bound * 1000 - r.remember * SECOND)
            held.sweep = None
            if idle and not left:
                held.known = Known()
                if not held.spans:
                    self.held.clear()
                    return
        if held.sweep is None and held.known.last is not None:
            held.sweep = bound + longest
        self._write(held)

    def close(self) -> None:
        pass


def decide_stream(scans: DataFrame, key: str, lateness: str, rules: Rules) -> DataFrame:
    """key, tie and decision of each scan of a stream whose slot the watermark has passed.

    ``scans`` have the key and COLUMNS. The state store must be RocksDB's.
    """
    rows = scans.select(key, *COLUMNS).withWatermark("ts", lateness).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    schema = T.StructType([scans.schema[key], T.StructField("tie", T.LongType()), T.StructField("decision", T.StringType())])
    return rows.groupBy(key).transformWithStateInPandas(Decider(key, scans.schema[key].dataType, rules), schema, "Append", "EventTime")
