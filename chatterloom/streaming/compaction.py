"""Compaction of threads while their log arrives, edits included.

The rule of ``compaction_boundaries`` is applied whenever a new message ends a turn.
A log row appends a message, overwrites one in place (an append of an id that is
there) or removes one. As in a stored thread, an edit never moves the boundary:
messages behind a removed one move up, and while the boundary lies past the
end, new messages fill the gap first.

State of a thread, kept in the state store and never as text: a value (counts,
boundary, last row handled), a list with the lengths of the unsummarized tail,
a map from the ids of present messages to their place in the order of arrival, and a
list of rows that wait. Rows wait until the watermark, ``lateness`` behind the latest
time seen, has passed them; an event-time timer then hands all of them on in
log order, so rows may arrive out of order by that much. Rows at or below the last one
handled come out as ``late``.

Between two edits nothing is done per message: lengths are summed up once, and the next
fold is the first turn end beyond the first place where either limit is
passed, found by search in the sums.

Rows with ``op = 'tick'`` belong to no thread; they only move the clock on, so that a
quiet log is handled to its end.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from chatterloom.config import CompactionConfig
from chatterloom.functions import text as X
from chatterloom.session import ship_package

OUT = "thread_id string, kind string, boundary_no long, at_message long, summarized_count long, seq long"
WAITING = ["seq", "sub", "at", "op", "id", "chars", "is_end"]
_KEEP, _NEW, _OVER, _GONE = range(4)


class Tail:
    """A thread's counts and the places and lengths of its unsummarized messages."""

    def __init__(self, cfg: CompactionConfig, messages=0, summarized=0, folds=0, places=(), chars=()):
        self.cfg, self.messages, self.summarized, self.folds = cfg, messages, summarized, folds
        self.places, self.chars = np.asarray(places, np.int64), np.asarray(chars, np.int64)

    def append(self, places: np.ndarray, chars: np.ndarray, ends: np.ndarray) -> list[tuple]:
        """Add new messages; the folds they bring: (index of the message, number, messages, boundary)."""
        keep, limit = self.cfg.keep_last, (self.cfg.max_tokens + 1) * self.cfg.chars_per_token
        filled = min(max(self.summarized - self.messages, 0), len(places))  # the boundary lies past the end
        old, found, start = len(self.places), [], 0
        self.places = np.concatenate([self.places, places[filled:]])
        self.chars = np.concatenate([self.chars, chars[filled:]])
        sums = np.append(0, np.cumsum(self.chars))
        sizes = np.flatnonzero(ends[filled:]) + old + 1  # tail and new messages up to each turn end
        while True:
            by_chars = int(np.searchsorted(sums, sums[start] + limit)) + keep
            least = max(min(by_chars, start + self.cfg.max_messages + 1), start + keep + 1)
            at = int(np.searchsorted(sizes, least))
            if at == len(sizes):
                break
            size = int(sizes[at])
            total = self.messages + filled + size - old
            start, self.folds, self.summarized = size - keep, self.folds + 1, total - keep
            found.append((filled + size - old - 1, self.folds, total, self.summarized))
        self.places, self.chars = self.places[start:], self.chars[start:]
        self.messages += len(places)
        return found

    def overwrite(self, place: int, chars: int) -> None:
        self.chars[self.places == place] = chars

    def remove(self, place: int) -> None:
        """One message less: of the tail, or the tail's first one moves up behind the boundary."""
        self.messages -= 1
        if len(self.places):
            at = int(np.searchsorted(self.places, place)) if place >= self.places[0] else 0
            self.places, self.chars = np.delete(self.places, at), np.delete(self.chars, at)


def replay(tail: Tail, rows: pd.DataFrame, place_of, next_place: int) -> tuple[list[tuple], dict, int]:
    """Apply rows in order. ``place_of(id)`` looks a present message up; gives folds (row, number,
    messages, boundary), the places of the ids touched (none: removed) and the next place."""
    kinds, places, touched = np.zeros(len(rows), np.int8), np.zeros(len(rows), np.int64), {}
    for i, (op, id_) in enumerate(zip(rows["op"], rows["id"])):
        if id_ not in touched:
            touched[id_] = place_of(id_)
        place = touched[id_]
        if op == "remove":
            kinds[i], places[i] = (_KEEP, 0) if place is None else (_GONE, place)
            touched[id_] = None
        elif place is None:
            kinds[i], places[i], touched[id_] = _NEW, next_place, next_place
            next_place += 1
        else:
            kinds[i], places[i] = _OVER, place
    chars, ends, folds = rows["chars"].to_numpy(np.int64), rows["is_end"].to_numpy(bool), []
    breaks = np.flatnonzero(np.diff(kinds == _NEW)) + 1
    for lo, hi in zip([0, *breaks], [*breaks, len(rows)]):
        if kinds[lo] == _NEW:
            folds += [(lo + i, *rest) for i, *rest in tail.append(places[lo:hi], chars[lo:hi], ends[lo:hi])]
            continue
        for i in range(lo, hi):
            if kinds[i] == _OVER:
                tail.overwrite(places[i], chars[i])
            elif kinds[i] == _GONE:
                tail.remove(places[i])
    return folds, touched, next_place


class _Compactor(StatefulProcessor):
    def __init__(self, cfg: CompactionConfig, lateness_ms: int):
        self.cfg, self.lateness_ms = cfg, lateness_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.facts = handle.getValueState(
            "facts", "messages long, summarized long, folds long, next_place long, last_seq long, last_sub long"
        )
        self.tail = handle.getListState("tail", "place long, chars long")
        self.present = handle.getMapState("present", "id string", "place long")
        self.waiting = handle.getListState(
            "waiting", "seq long, sub long, at long, op string, id string, chars long, is_end boolean"
        )

    def _facts(self) -> tuple:
        return tuple(self.facts.get()) if self.facts.exists() else (0, 0, 0, 0, None, None)

    @staticmethod
    def _told(thread: str, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(thread, *r) for r in rows], columns=[c.split()[0] for c in OUT.split(", ")])
        return out.astype({"boundary_no": "Int64", "at_message": "Int64", "summarized_count": "Int64"})

    def _split_late(self, thread: str, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        seq, sub = self._facts()[4:]
        if seq is None:
            return rows, rows[:0]
        late = (rows["seq"] < seq) | (rows["seq"] == seq) & (rows["sub"] <= sub)
        return rows[~late], rows[late]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            chunk = chunk[chunk["op"] != "tick"]
            if not len(chunk):
                continue
            fresh, late = self._split_late(key[0], chunk[WAITING])
            if len(late):
                yield self._told(key[0], [("late", None, None, None, int(s)) for s in late["seq"]])
            if len(fresh):
                self.waiting.appendList(list(fresh.itertuples(index=False, name=None)))
                # All that is due goes at the first timer, so a timer for each stretch of time is enough.
                for stretch in np.unique(-(-fresh["at"].to_numpy() // self.lateness_ms)).tolist():
                    self.handle.registerTimer(stretch * self.lateness_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            return
        rows = pd.DataFrame(list(self.waiting.get()), columns=WAITING)
        due = rows["at"] <= timerValues.getCurrentWatermarkInMs()
        if not due.any():
            return
        later, rows = rows[~due], rows[due].sort_values(["seq", "sub"], kind="stable")
        if len(later):
            self.waiting.put(list(later.itertuples(index=False, name=None)))
        else:
            self.waiting.clear()
        rows, late = self._split_late(key[0], rows)
        again = rows.duplicated(["seq", "sub"])
        late, rows = pd.concat([late, rows[again]]), rows[~again].reset_index(drop=True)
        told = [("late", None, None, None, int(s)) for s in late["seq"]]
        if len(rows):
            told += self._advance(rows)
        if told:
            yield self._told(key[0], told)

    def _advance(self, rows: pd.DataFrame) -> list[tuple]:
        messages, summarized, folds, next_place = self._facts()[:4]
        kept = list(self.tail.get()) if self.tail.exists() else []
        tail = Tail(self.cfg, messages, summarized, folds, [r[0] for r in kept], [r[1] for r in kept])
        place_of = lambda id_: self.present.getValue((id_,))[0] if self.present.containsKey((id_,)) else None
        found, touched, next_place = replay(tail, rows, place_of, next_place)
        for id_, place in touched.items():
            if place is None:
                self.present.removeKey((id_,))
            else:
                self.present.updateValue((id_,), (place,))
        if len(tail.places):
            self.tail.put(list(zip(tail.places.tolist(), tail.chars.tolist())))
        else:
            self.tail.clear()
        last = rows.iloc[-1]
        self.facts.update((tail.messages, tail.summarized, tail.folds, next_place, int(last["seq"]), int(last["sub"])))
        return [("fold", number, total, boundary, int(rows["seq"].iat[i])) for i, number, total, boundary in found]


def compaction(events: DataFrame, cfg: CompactionConfig = CompactionConfig(), lateness_seconds: int = 3600) -> DataFrame:
    """A ``fold`` row whenever a thread's tail is due, and ``late`` rows.

    ``events(thread_id, seq, message_id, type, content, tool_calls, ts)``, and ``op`` and
    ``sub`` if the log has them. Needs the RocksDB state store (``write_batches`` with
    ``keyed_state``).
    """
    ship_package(events.sparkSession)
    optional = lambda c, other: F.coalesce(F.col(c), other) if c in events.columns else other
    timed = events.withColumn("_clock", F.col("ts").cast("timestamp")).withWatermark("_clock", f"{lateness_seconds} seconds")
    narrow = timed.select(
        "thread_id",
        "seq",
        optional("sub", F.lit(0)).cast("bigint").alias("sub"),
        # A plain number: rows behind the watermark must come in, to come out as late.
        F.coalesce(F.expr("unix_millis(_clock)"), F.lit(0)).alias("at"),
        optional("op", F.lit("append")).alias("op"),
        F.coalesce("message_id", F.lit("")).alias("id"),
        X.content_length(F.col("content")).alias("chars"),
        F.coalesce(X.ends_turn(F.col("type"), F.col("tool_calls")), F.lit(False)).alias("is_end"),
    )
    # Spark also starts a worker beside the driver, which gets no shipped files: the processor
    # travels whole, with plain limits in place of a class of another module.
    limits = SimpleNamespace(
        max_tokens=cfg.max_tokens, max_messages=cfg.max_messages, keep_last=cfg.keep_last, chars_per_token=cfg.chars_per_token
    )
    this = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(this)
    try:
        return narrow.groupBy("thread_id").transformWithStateInPandas(
            _Compactor(limits, lateness_seconds * 1000), OUT, "append", "eventTime"
        )
    finally:
        cloudpickle.unregister_pickle_by_value(this)
