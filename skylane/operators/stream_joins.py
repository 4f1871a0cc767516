"""Joins by time on streams, with state that grows with the rows of both sides and not with their pairs.

Time is cut into slices. A left row stands in its own slice, a right row in each slice that its tolerance touches, so a
slice knows all that its left rows can meet. Rows wait as lists until the watermark passes the last time that still
counts for the slice; then a timer sorts the right rows once, answers every left row and drops the slice's state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Slices of the tolerance on streams: more of them deal a crowded time out to more tasks and copy right rows to more of them.
SLICES = 4
#: Left rows that are answered at a time.
_CHUNK = 10_000
#: Rows wait as JSON text, so state needs no knowledge of their columns; times keep their microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_OUT = "l string, r string, gap long"


def _frame(left, right, gap) -> pd.DataFrame:
    return pd.DataFrame({"l": left, "r": right, "gap": gap}, dtype=object)


class _Slice(StatefulProcessor):
    """State of a slice: left rows that wait, right rows that they may meet."""

    def __init__(self, width_ms: int, reach: int, nearest: bool, unmatched: bool, tie_type: str):
        self.width_ms, self.reach, self.nearest, self.unmatched, self.tie_type = width_ms, reach, nearest, unmatched, tie_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, row string")
        self.met = handle.getListState("met", f"t long, tie {self.tie_type}, row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark names them
        for part in rows:
            for state, columns, mine in ((self.waiting, ["t", "row"], part["is_left"]), (self.met, ["t", "tie", "row"], ~part["is_left"])):
                new = part.loc[mine, columns]
                if len(new):
                    state.appendList(list(zip(*(new[c].tolist() for c in columns))))
        self.handle.registerTimer((int(key[0]) + 1) * self.width_ms + self.reach // 1000)
        yield _frame([], [], [])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = sorted(self.met.get()) if self.met.exists() else []
        if self.nearest:  # of equal times the smallest tie
            seen = [row for k, row in enumerate(seen) if k == 0 or seen[k - 1][0] != row[0]]
        times, right = np.array([s[0] for s in seen], np.int64), np.array([s[2] for s in seen] + [None], object)
        chunk: list = []
        for row in self.waiting.get() if self.waiting.exists() else ():
            chunk.append(row)
            if len(chunk) == _CHUNK:
                yield self._answers(chunk, times, right)
                chunk = []
        if chunk:
            yield self._answers(chunk, times, right)
        self.waiting.clear()
        self.met.clear()

    def _answers(self, chunk: list, times: np.ndarray, right: np.ndarray) -> pd.DataFrame:
        at, left = np.array([c[0] for c in chunk], np.int64), np.array([c[1] for c in chunk], object)
        if self.nearest:
            before, after = np.searchsorted(times, at, "right") - 1, np.searchsorted(times, at, "right")
            far = np.int64(self.reach + 1)
            padded = np.append(times, 0)  # places -1 and len(times) are the same one
            gap_before = np.where(before >= 0, at - padded[before], far)
            gap_after = np.where(after < len(times), padded[after] - at, far)
            gap, pick = np.minimum(gap_before, gap_after), np.where(gap_before <= gap_after, before, after)
            n = (gap <= self.reach).astype(np.int64)
            first = pick
        else:
            first = np.searchsorted(times, at - self.reach, "left")
            n = np.searchsorted(times, at + self.reach, "right") - first
        rows = np.maximum(n, 1) if self.unmatched else n
        of = np.repeat(np.arange(len(at)), rows)
        place = np.repeat(first, rows) + np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
        place = np.where(n[of] > 0, place, len(times))  # right[-1] is None
        gap = np.where(n[of] > 0, np.abs(np.append(times, 0)[place] - at[of]).astype(object), None)
        return _frame(left[of], right[place], gap)

    def close(self) -> None:
        pass


def _joined(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, seconds: int, right_id: str | None, how: str, nearest: bool, slices: int) -> DataFrame:
    """``l`` and ``r`` as structs and their ``gap`` in microseconds."""
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    reach = seconds * 1_000_000
    width = max(1000, reach // slices // 1000 * 1000)
    slice_of = lambda t: F.floor(t / width).cast("long")
    pack = F.to_json(F.struct("*"), _JSON)
    tie_type = "string" if right_id is None else right.schema[right_id].dataType.simpleString()
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    probe = left.select(F.col(left_ts).alias("at"), micros(left_ts).alias("t"), F.lit(None).cast(tie_type).alias("tie"), pack.alias("row"), F.lit(True).alias("is_left"))
    probe = probe.where("t is not null").withColumn("slice", slice_of(F.col("t")))
    build = right.select(F.col(right_ts).alias("at"), micros(right_ts).alias("t"), F.lit(None).cast("string").alias("tie") if right_id is None else F.col(right_id).alias("tie"), pack.alias("row"), F.lit(False).alias("is_left"))
    build = build.withColumn("tie", F.col("row")) if right_id is None else build
    build = build.where("t is not null").withColumn("slice", F.explode(F.sequence(slice_of(F.col("t") - reach), slice_of(F.col("t") + reach))))
    met = probe.union(build.select(*probe.columns)).groupBy("slice").transformWithStateInPandas(
        _Slice(width // 1000, reach, nearest, how == "left", tie_type), _OUT, "Append", "EventTime"
    )
    unpack = lambda c, df: F.from_json(c, df.schema, _JSON).alias(c)
    return met.select(unpack("l", left), unpack("r", right), "gap")


def _columns(left: DataFrame, right: DataFrame) -> list:
    return [F.col(f"l.`{c}`").alias(c) for c in left.columns] + [F.col(f"r.`{c}`").alias(c) for c in right.columns]


def nearest_on_streams(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, right_id: str | None = None, seconds: int = 3600, how: str = "inner", slices: int = SLICES) -> DataFrame:
    """For each left row the right row nearest in time within ``seconds``, once the watermark says that no nearer one can come.

    Both streams need watermarks on their times. Ties go to the earlier right row, then to the smaller ``right_id``
    (without one: to the smaller row as JSON text). Rows with a null time and rows later than the watermark are left out;
    repeated left rows stay. ``how='left'`` keeps left rows without a match. Returns both sides' columns and ``time_diff``.
    """
    met = _joined(left, right, left_ts, right_ts, seconds, right_id, how, True, slices)
    return met.select(*_columns(left, right), (F.col("gap") / 1_000_000).alias("time_diff"))


def interval_on_streams(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, seconds: int, how: str = "inner", slices: int = SLICES) -> DataFrame:
    """All pairs whose times differ by at most ``seconds``; ``how='left'`` gives one row for each left row without a match.

    Both streams need watermarks on their times. A slice's pairs come together when it closes; its state holds rows, no pairs.
    """
    return _joined(left, right, left_ts, right_ts, seconds, None, how, False, slices).select(*_columns(left, right))
