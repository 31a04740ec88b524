"""Repeats of a key that expire, on streams with state and timers and on tables with windows.

A row is ``first`` where no row of its key came less than ``keep`` before it, else ``repeat``; each row, repeats too,
begins the time anew. Rows of one key and time go by their id. A stream holds a row back until the watermark passes
it, so that rows that came out of order are judged in the order of their times, as a table's are; a row that the watermark has
already passed is ``late``: it is returned, not dropped, and changes no other row's answer.

Defined cases: rows without a time are ``undated`` and rows of a null key are a key of their own; repeated rows are
repeats of one another; an empty input gives no rows; rows of a stream that its last watermark hasn't passed come with later input.

State holds, for each key, the rows not yet passed (as many as arrive within the watermark's delay) and the last time; a timer
clears the time ``keep`` later, so keys that fall silent leave nothing behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ANSWERS = "key string, id long, at long, status string"


def _answers(key: str | None, ids, at, status) -> pd.DataFrame:
    return pd.DataFrame({"key": [key] * len(ids), "id": ids, "at": at, "status": status}).astype({"id": "Int64", "at": "Int64"})


class Expiring(StatefulProcessor):
    """Times are microseconds; timers and watermarks are milliseconds, rounded up."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, id long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, soonest = timerValues.getCurrentWatermarkInMs(), None
        for block in rows:
            undated = block["at"].isna().to_numpy()
            ids, at = block["id"], block["at"].fillna(0).astype("int64").to_numpy()
            late = ~undated & (-(-at // 1000) <= passed)
            held = ~undated & ~late
            if held.any():
                self.pending.appendList([(int(a), None if pd.isna(i) else int(i)) for a, i in zip(at[held], ids[held], strict=True)])
                soonest = min(int(at[held].min()), soonest or 1 << 62)
            if not held.all():
                yield _answers(key[0], ids[~held].to_numpy(), block["at"][~held].to_numpy(), np.where(undated[~held], "undated", "late"))
        if soonest is not None:
            self.handle.registerTimer(-(-soonest // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(((a, i) for a, i in self.pending.get()), key=lambda r: (r[0], r[1] is not None, r[1] or 0)) if self.pending.exists() else []
        ready = [r for r in rows if -(-r[0] // 1000) <= passed]
        last = self.last.get()[0] if self.last.exists() else None
        status = []
        for at, _ in ready:
            status.append("first" if last is None or at - last >= self.keep else "repeat")
            last = at
        if ready:
            if len(ready) < len(rows):
                self.pending.put(rows[len(ready) :])
                self.handle.registerTimer(-(-rows[len(ready)][0] // 1000))
            else:
                self.pending.clear()
            self.last.update((last,))
            # No later than the watermark, or it would fire in this round again.
            self.handle.registerTimer(max(-(-(last + self.keep) // 1000), passed + 1))
            yield _answers(key[0], [r[1] for r in ready], [r[0] for r in ready], status)
        elif last is not None and -(-(last + self.keep) // 1000) <= passed:
            self.last.clear()

    def close(self) -> None:
        pass


def expiring_first_seen(rows: DataFrame, key: str, at: str, id: str, keep: timedelta, late: str = "1 hour") -> DataFrame:
    """key (as text), id, at (microseconds) and status of every row of a stream or a table."""
    width = keep // timedelta(microseconds=1)
    if width <= 0:
        raise ValueError("keep must be positive")
    moment = F.col(at).cast("timestamp")
    columns = [F.col(key).cast("string").alias("key"), F.col(id).cast("long").alias("id")]
    if rows.isStreaming:
        # A number bears no watermark, so the operator sees late rows, which Spark would drop without a word.
        held = rows.select(*columns, moment.alias("moment")).withWatermark("moment", late).select("key", "id", F.unix_micros("moment").alias("at"))
        return held.groupBy("key").transformWithStateInPandas(Expiring(width), ANSWERS, "append", "eventTime")
    # Cells of ``keep`` split a hot key by time. What comes before a row is in its cell or, as the latest of that, in the one before.
    cells = rows.select(*columns, F.unix_micros(moment).alias("at")).withColumn("cell", F.floor(F.col("at") / F.lit(width)))
    ends = cells.where("at IS NOT NULL").groupBy("key", "cell").agg(F.max("at").alias("end")).select(F.col("key").alias("_key"), (F.col("cell") + 1).alias("_cell"), "end")
    inside = cells.withColumn("before", F.lag("at").over(Window.partitionBy("key", "cell").orderBy("at", "id")))
    found = inside.join(ends, F.col("key").eqNullSafe(F.col("_key")) & (F.col("cell") == F.col("_cell")), "left")
    before = F.coalesce("before", "end")
    status = F.when(F.col("at").isNull(), "undated").when(before.isNull() | (F.col("at") - before >= width), "first").otherwise("repeat")
    return found.select("key", "id", "at", status.alias("status"))
