"""Keyed state over events in the order of their own times: throttled beats, changes of page.

Events wait in a key's state until the watermark has passed them, and are then taken in the
order of their times, so that the order in which files arrive changes nothing. Timers take
them out, and a last timer clears what a key has left. A call to the store costs far more than
a row, so what a key gets in a batch is stored in pieces, and waits for one timer. The state store must be RocksDB:
``spark.sql.streaming.stateStore.providerClass`` names it, see ``PROVIDER``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from itertools import batched

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a key that are stored as one value.
PIECE = 4096

_EPOCH, _MS = datetime(1970, 1, 1, tzinfo=timezone.utc), timedelta(milliseconds=1)


def _ms(at: datetime) -> int:
    """Whole milliseconds; a time without a zone is local, as workers get it."""
    return (at.astimezone(timezone.utc) - _EPOCH) // _MS


class InOrder(StatefulProcessor):
    """Hands each key's rows (``at`` first) to ``rule(last, row, since)``, by ``at`` and then the other columns.

    ``since`` is the milliseconds from the last row's time. The rule returns the row to
    remember, None to keep what is remembered, and whether the row goes on. What is remembered is forgotten ``keep_ms`` after its time.
    """

    def __init__(self, names: list[str], schema: str, rule: Callable[[tuple | None, tuple, int | None], tuple[tuple | None, bool]], keep_ms: int):
        self.names, self.schema, self.rule, self.keep_ms = names, schema, rule, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        for piece in batched(map(tuple, rows), PIECE):
            self.held.appendValue((pickle.dumps(piece),))
            at = min(r[0] for r in piece)
            first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(_ms(first) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        done = timerValues.getCurrentWatermarkInMs()
        held = [(_ms(r[0]), r) for (piece,) in self.held.get() for r in pickle.loads(piece)]
        due = sorted((x for x in held if x[0] <= done), key=lambda x: (x[1][0], *((c is not None, c) for c in x[1][1:])))
        stored = self.last.get()
        last = before = None if stored is None else (_ms(stored[0]), tuple(stored))
        out = []
        for at, row in due:
            if last is not None and at - last[0] > self.keep_ms:
                last = None
            kept, goes = self.rule(last and last[1], row, last and at - last[0])
            last = last if kept is None else (at, kept)
            if goes:
                out.append(Row(**dict(zip(self.names, row, strict=True))))
        rest = [x for x in held if x[0] > done]
        if due and rest:
            self.held.put([(pickle.dumps(piece),) for piece in batched((r for _, r in rest), PIECE)])
            self.handle.registerTimer(min(rest, key=lambda x: x[0])[0] + 1)
        elif due:
            self.held.clear()
        if last is not None and last[0] + self.keep_ms < done and not rest:
            if before is not None:
                self.last.clear()
        elif last is not None and last != before:
            self.last.update(last[1])
            self.handle.registerTimer(last[0] + self.keep_ms + 1)
        return iter(out)

    def close(self) -> None:
        pass


def _in_order(events: DataFrame, time: str, keys: list[str], others: list[str], late: str, rule: Callable, keep_ms: int) -> DataFrame:
    fields = [events.schema[c] for c in [time, *keys, *others]]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    told = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    rows = events.withWatermark(time, late).select(*(f.name for f in fields))
    return rows.groupBy(*keys).transformWithState(statefulProcessor=InOrder(rows.columns, told, rule, keep_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def throttled(events: DataFrame, time: str, keys: list[str], others: list[str] | None = None, seconds: int = 60, late: str = "2 hours") -> DataFrame:
    """(time, keys, others): a key's events at least ``seconds`` after the last one that went on.

    Rows later than ``late`` behind the newest event are left out. A key's state is gone once
    the watermark is ``seconds`` past its last event.
    """

    def rule(last, row, since):
        goes = last is None or since >= seconds * 1000
        return (row if goes else None), goes

    return _in_order(events, time, keys, others or [], late, rule, seconds * 1000)


def page_changes(events: DataFrame, time: str, keys: list[str], page: str, others: list[str] | None = None, late: str = "2 hours", forget: int = 30 * 86400) -> DataFrame:
    """(time, keys, others, page): a key's events whose page is not that of its event before; null is a page.

    Ties in time go by the other columns in the order given, null first. After ``forget``
    seconds without an event a key's next one counts as a change, and its state is gone.
    """
    at = 1 + len(keys) + len(others or [])

    def rule(last, row, since):
        return row, last is None or last[at] != row[at]

    return _in_order(events, time, keys, [*(others or []), page], late, rule, forget * 1000)
