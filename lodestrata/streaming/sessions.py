"""Transfers judged as their chunks arrive: state by session, with expiry.

Chunks may come in any order and again.  A session's chunks are kept by index in map
state, the stretches still missing in a list, and a timer runs from its last chunk.  A
session is judged once its end has come and nothing is missing, or when the timer runs
out; then its chunks are dropped.  The verdict is that of ``parts.verify`` on its
different messages.  For some time after that a mark stays, so that late repeats open
nothing anew; then all state of the session is gone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import parts, transfer

PART = "body string, report_id string, total int, has_start boolean, has_end boolean, start_hash string, end_hash string"
MARKS = "error string, repeated boolean, highest int, timer long, judged boolean"
OUT = f"session_id string, expired boolean, {parts.FACTS.replace('session_id string, ', '')}"
NAMES = [x.split()[0] for x in OUT.split(", ")]


def closed(gaps: list[tuple[int, int]], highest: int, index: int) -> tuple[list[tuple[int, int]], int]:
    """The missing stretches ``(low, high)`` below the highest index, after ``index`` has come."""
    if index > highest:
        return gaps + [(highest + 1, index - 1)] * (index > highest + 1), index
    out = []
    for low, high in gaps:
        out += [(a, b) for a, b in ((low, index - 1), (index + 1, high)) if a <= b] if low <= index <= high else [(low, high)]
    return out, highest


class Sessions(StatefulProcessor):
    """``idle`` milliseconds without a chunk end a session; its mark stays for ``keep`` more."""

    def __init__(self, idle: int, keep: int):
        self.idle, self.keep = idle, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "index int", PART)
        self.gaps = handle.getListState("gaps", "low int, high int")
        self.marks = handle.getValueState("marks", MARKS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        error, repeated, highest, timer, judged = self.marks.get() if self.marks.exists() else (None, False, 0, 0, False)
        if judged:
            for _ in rows:  # late repeats of a session that has its verdict
                pass
            return
        gaps, now = [tuple(g) for g in self.gaps.get()], 0
        for frame in rows:
            for r in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                now = max(now, int(r["ms"]))
                if r["error"] is not None:
                    error = r["error"] if error is None else min(error, r["error"])
                    continue
                index = int(r["chunk_index"])
                part = (r["body"], r["report_id"], int(r["total_chunks"]), bool(r["has_start"]), bool(r["has_end"]), r["start_hash"], r["end_hash"])
                if self.chunks.containsKey((index,)):
                    repeated = repeated or tuple(self.chunks.getValue((index,))) != part
                    continue
                self.chunks.updateValue((index,), part)
                gaps, highest = closed(gaps, highest, index)
        due = max(now, timerValues.getCurrentWatermarkInMs()) + self.idle
        if timer:
            self.handle.deleteTimer(timer)
        # All is there once the last chunk, which alone has the end, is and no stretch is missing.
        whole = not gaps and highest and (last := self.chunks.getValue((highest,)))[4] and last[2] == highest
        if whole:
            yield self._verdict(key, error, repeated, False)
            due += self.keep
        else:
            self.gaps.put(gaps) if gaps else self.gaps.clear()
        self.handle.registerTimer(due)
        self.marks.update((error, repeated, highest, due, bool(whole)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        error, repeated, highest, timer, judged = self.marks.get()
        if judged:
            self.marks.clear()
            return
        yield self._verdict(key, error, repeated, True)
        due = timerValues.getCurrentWatermarkInMs() + self.keep
        self.handle.registerTimer(due)
        self.marks.update((error, repeated, highest, due, True))

    def _verdict(self, key, error, repeated, expired: bool) -> pd.DataFrame:
        """The session's facts; its chunks are read one by one in order, then dropped."""
        indices = sorted(k[0] for k in self.chunks.keys())
        running, first, most = hashlib.sha256(), None, {"total": None, "start": None, "end": None}
        same, starts, ends = [True, True], 0, 0
        for index in indices:
            body, report, total, start, end, start_hash, end_hash = self.chunks.getValue((index,))
            first = first or (report, total)
            same = [same[0] and report == first[0], same[1] and total == first[1]]
            starts, ends = starts + start, ends + end
            for k, v in (("total", total), ("start", start_hash), ("end", end_hash)):
                if v is not None:
                    most[k] = v if most[k] is None else max(most[k], v)
            running.update((body or "").encode())
        self.chunks.clear()
        self.gaps.clear()
        low, high = (indices[0], indices[-1]) if indices else (None, None)
        row = [key[0], expired, len(indices), error, first and first[0], most["total"], True, *same, repeated, low, high, starts, ends, most["start"], most["end"], running.hexdigest()]
        frame = pd.DataFrame([row], columns=NAMES)
        return frame.astype({"total": "Int32", "lowest": "Int32", "highest": "Int32"})


def judge(messages: DataFrame, idle: str = "10 minutes", delay: str = "1 minute", keep: str = "1 hour") -> DataFrame:
    """``(session_id, status, reason, chunks, hash, expired)`` from a stream of ``messages(message, at)``, a row a session.

    ``at`` is the event time that timers and expiry go by; rows that are ``delay`` later
    than the latest are dropped.  ``chunks`` counts sound ones.  Messages whose header
    can't be read belong to no session and are left out; rows without a time too.
    """
    ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    parsed = transfer.parse_chunks(messages.where("message is not null and at is not null").withWatermark("at", delay)).where("session_id != ''")
    rows = parsed.select("session_id", F.unix_millis("at").alias("ms"), "at", "chunk_index", "body", "error", "report_id", "total_chunks", "has_start", "has_end", "start_hash", "end_hash")
    facts = rows.groupBy("session_id").transformWithStateInPandas(Sessions(ms(idle), ms(keep)), OUT, "Append", "EventTime")
    made = facts.withColumn("reason", parts.reason_of())
    good = F.col("reason").isNull()
    return made.select("session_id", F.when(good, "VERIFIED").otherwise("INVALID").alias("status"), "reason", "chunks", F.when(good, F.col("hash")).alias("hash"), "expired")
