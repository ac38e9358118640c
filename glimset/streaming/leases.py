"""Leases on a stream: photos that stay in work too long are sent back to waiting.

``expired`` keeps, for each photo in work, the number and the start of its latest claim. A later state
clears them. When the lease has ended, which counts from that start, the photo gets a row of the status log
that says that it waits. As for the batch form (``lifecycle.stale_rows``), a claim without a start never
ends, and rows without a number count for nothing.

Photos are dealt over a fixed number of groups, and a turn of Python handles all changes of a group at once:
a turn a photo would cost about a millisecond each. State is kept of photos in work only, three numbers
each, and a group has one processing-time timer, for the end of its first lease. The number of groups is
part of a stream's checkpoint, as that of its shuffle partitions is.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glimset.schemas import LEASE_MINUTES, PENDING, PROCESSING

EXPIRED = "bucket int, photo_id long, seq long, status string"
#: Groups of photos; those without an id are a group of their own.
BUCKETS = 4096
NO_ID = -1
#: In place of a start: in no work, or in work without a start.
NEVER = -(1 << 63)


def latest(rows: np.ndarray) -> np.ndarray:
    """The columns with each photo's highest number of (photo_id, seq, began); of equal numbers the first."""
    rows = rows[:, np.lexsort((-np.arange(rows.shape[1]), rows[1], rows[0]))]
    return rows[:, np.append(rows[0, 1:] != rows[0, :-1], True)] if rows.shape[1] else rows


def on_change(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, minutes: float, now: float | None) -> Iterator[pd.DataFrame]:
    """One group's turn: new states (photo_id, seq, began in microseconds or ``NEVER``) or a timer."""
    moment = round((time.time() if now is None else now) * 1_000_000)
    before = state.get[0] if state.exists else b""
    rows = np.frombuffer(bytes(before), np.int64).reshape(3, -1)
    if not state.hasTimedOut:
        parts, more = [rows], 0
        for batch in batches:
            parts.append(batch[["photo_id", "seq", "began"]].to_numpy(np.int64).T)
            more += len(batch)
            if more > max(100_000, parts[0].shape[1]):  # no more waits than is kept
                parts, more = [latest(np.concatenate(parts, axis=1))], 0
        rows = latest(np.concatenate(parts, axis=1))
        rows = rows[:, rows[2] != NEVER]
    over = rows[2] + round(minutes * 60_000_000) < moment
    left, over = rows[:, ~over], rows[:, over]
    if left.shape[1]:
        state.update((left.tobytes(),))
        if now is None:
            state.setTimeoutDuration(max(1, (int(left[2].min()) + round(minutes * 60_000_000) - moment) // 1000 + 1))
    elif state.exists:
        state.remove()
    if over.shape[1]:
        yield pd.DataFrame({"bucket": np.int32(key[0]), "photo_id": over[0], "seq": over[1] + 1, "status": PENDING})


def expired(log: DataFrame, minutes: float = LEASE_MINUTES, now: float | None = None) -> DataFrame:
    """Rows of the status log for photos of a streamed log whose lease ends without a later state.

    ``now``: a fixed moment in seconds for a replay, which has no timers and so can end; else the clock."""
    turn = lambda key, batches, state: on_change(key, batches, state, minutes, now)
    began = F.when(F.col("status") == PROCESSING, F.unix_micros(F.col("started_at").cast("timestamp")))
    rows = log.filter("seq IS NOT NULL").select(
        F.when(F.col("photo_id").isNull(), NO_ID).otherwise(F.pmod(F.xxhash64("photo_id"), F.lit(BUCKETS))).cast("int").alias("bucket"),
        F.coalesce("photo_id", F.lit(0)).cast("long").alias("photo_id"), "seq", F.coalesce(began, F.lit(NEVER)).cast("long").alias("began"),
    )
    found = rows.groupBy("bucket").applyInPandasWithState(turn, EXPIRED, "claims binary", "append", GroupStateTimeout.ProcessingTimeTimeout if now is None else GroupStateTimeout.NoTimeout)
    none = lambda kind: F.lit(None).cast(kind)
    photo = F.when(F.col("bucket") != NO_ID, F.col("photo_id")).alias("photo_id")
    return found.select(photo, "seq", "status", none("timestamp_ntz").alias("started_at"), none("timestamp_ntz").alias("processed_at"), none("string").alias("error"))
