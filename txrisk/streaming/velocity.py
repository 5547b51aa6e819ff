"""Velocity counts from a stream: how many earlier rows a user has in the last day and week (the inputs of F8-F10).

State per user holds the instants of the last week and the rows that are
still open. A row is settled once the horizon, the largest instant seen less
``lateness``, has passed it: whatever arrived out of order by then counts. A
timer settles rows of users who send nothing more and drops states that no
window reaches any longer. Counts are over strictly earlier instants of the
half-open windows ``(t - 1 day, t)`` and ``(t - 7 days, t)``, as in the batch
windows, so a stream equals the batch over the same rows.

A row that is already behind the horizon when it arrives could change counts
that are out: it is set aside with ``is_late`` and NULL counts. Spark itself
drops rows behind its watermark before any operator sees them, so its
watermark lies ``keep_late`` behind the horizon; only rows later than both
together are dropped, and Spark's metrics count those.

State and offsets live in the query's checkpoint: a restarted query goes on
where it stopped. Instants are stored once with their number of rows, so many
rows of one instant cost one entry.

Defined results: rows without user or instant are refused by the caller (the
function leaves them out); rows that repeat an id count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_US = 86_400_000_000
WEEK_US = 7 * DAY_US

_OUT = "user string, id string, us long, count_24h long, count_7d long, is_late boolean"
_STATE = "at array<bigint>, n array<bigint>, open_us array<bigint>, open_id array<string>"


def earlier_counts(at: np.ndarray, n: np.ndarray, t: np.ndarray, length: int) -> np.ndarray:
    """For each instant in ``t``, the rows in ``(t - length, t)``; ``at`` ascending, ``n`` rows at each."""
    total = np.concatenate([[0], np.cumsum(n)])
    return total[np.searchsorted(at, t, side="left")] - total[np.searchsorted(at, t - length, side="right")]


def _settle(ahead_us: int):
    """The state function; the horizon is ``ahead_us`` past Spark's watermark."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, n, us, ids = (list(x) for x in state.get) if state.exists else ([], [], [], [])
        mark = state.getCurrentWatermarkMs()
        horizon = mark * 1000 + ahead_us if mark > 0 else None
        if not state.hasTimedOut:
            for frame in frames:
                late = frame["us"] < horizon if horizon is not None else pd.Series(False, index=frame.index)
                if late.any():
                    aside = frame[late]
                    yield pd.DataFrame({"user": key[0], "id": aside["id"], "us": aside["us"], "count_24h": pd.array([None] * len(aside), "Int64"),
                                        "count_7d": pd.array([None] * len(aside), "Int64"), "is_late": True})
                us += frame.loc[~late, "us"].tolist()
                ids += frame.loc[~late, "id"].tolist()
        t = np.array(us, dtype=np.int64)
        done = t < horizon if horizon is not None else np.zeros(len(t), bool)
        if done.any():
            new, more = np.unique(t[done], return_counts=True)
            # settled instants come in order: nothing new lies before those of the state
            at, where = np.unique(np.concatenate([np.array(at, np.int64), new]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([np.array(n, np.int64), more])).astype(np.int64)
            yield pd.DataFrame({"user": key[0], "id": [i for i, d in zip(ids, done, strict=True) if d], "us": t[done],
                                "count_24h": earlier_counts(at, n, t[done], DAY_US), "count_7d": earlier_counts(at, n, t[done], WEEK_US), "is_late": False})
            ids = [i for i, d in zip(ids, done, strict=True) if not d]
            t = t[~done]
        if horizon is not None and len(at):
            reached = np.array(at, np.int64) > horizon - WEEK_US        # by windows of rows yet to be settled
            at, n = np.array(at, np.int64)[reached], np.array(n, np.int64)[reached]
        if not len(t) and not len(at):
            if state.exists:
                state.remove()
            return
        state.update((list(map(int, at)), list(map(int, n)), list(map(int, t)), ids))
        due = int(t.min()) + 1 if len(t) else int(at[-1]) + WEEK_US
        state.setTimeoutTimestamp(max((due - ahead_us) // 1000 + 1, mark + 1))
    return run


def velocity_counts(rows: DataFrame, user: str = "user_id", ident: str = "event_id", timestamp: str = "timestamp",
                    lateness: str = "1 hour", keep_late: str = "30 days") -> DataFrame:
    """A streaming frame -> ``user``, ``id`` (both as text), ``us`` (microseconds), ``count_24h``, ``count_7d`` and ``is_late``, in
    append mode; a row comes out when it is settled, or at once if it is late."""
    spark = rows.sparkSession
    ahead, span = (spark.sql(f"SELECT unix_micros(timestamp'1970-01-01' + interval {x}) - unix_micros(timestamp'1970-01-01')").first()[0]
                   for x in (keep_late, lateness))
    narrow = (rows.select(F.col(user).cast("string").alias("user"), F.col(ident).cast("string").alias("id"), F.col(timestamp).cast("timestamp").alias("ts"))
              .filter("user IS NOT NULL AND ts IS NOT NULL").withColumn("us", F.unix_micros("ts"))
              .withWatermark("ts", f"{(ahead + span) // 1000} milliseconds"))
    return narrow.groupBy("user").applyInPandasWithState(_settle(ahead), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def split_late(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled rows, rows set aside)."""
    return counts.filter("NOT is_late").drop("is_late"), counts.filter("is_late").select("user", "id", "us")
