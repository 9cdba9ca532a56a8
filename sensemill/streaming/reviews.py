"""Learning state and request limits kept up by Structured Streaming.

State belongs to a key and holds the last scheduler state only; the batch fold over the whole history
gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sensemill.operators.learning import review

_STATE = "stability double, difficulty double, reps long, lapses long, at double"


def _ordered(batches: Iterator[pd.DataFrame], *columns: str) -> list[list]:
    """A key's rows of one trigger by at and seq, as numbers alone; the trigger's size bounds them."""
    parts = [[b[c].to_numpy() for c in columns] for b in batches]
    rows = [np.concatenate(c) for c in zip(*parts)]
    order = np.lexsort((rows[1], rows[0]))
    return [c[order].tolist() for c in rows]


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    s, d, reps, lapses, at = state.get if state.exists else (None, None, 0, 0, None)
    interval = 0
    for now, _, grade in zip(*_ordered(batches, "at", "seq", "grade")):
        lapses += int(s is not None and grade == 1)
        s, d, interval = review(s, d, 0.0 if at is None else (now - at) / 86_400, grade)
        reps, at = reps + 1, float(now)
    state.update((s, d, reps, lapses, at))
    yield pd.DataFrame({"key": [key[0]], "stability": [s], "difficulty": [d], "reps": [reps], "lapses": [lapses], "interval_days": [interval], "at": [at]})


def review_states(reviews: DataFrame, key: str) -> DataFrame:
    """A stream of reviews (the key, at in seconds, seq, grade) to a stream of updated states per key. Events of a key
    are folded in order inside a batch; a late event of an earlier batch is folded when it comes."""
    rows = reviews.select(F.col(key).cast("long").alias("key"), F.col("at").cast("double").alias("at"), F.col("seq").cast("long").alias("seq"), F.col("grade").cast("int").alias("grade"))
    out = "key long, stability double, difficulty double, reps long, lapses long, interval_days long, at double"
    return rows.groupBy("key").applyInPandasWithState(_fold, out, _STATE, "update", GroupStateTimeout.NoTimeout)


def _limiter(width: float, most: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the window is over for every request that may still come
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        ats, seqs = _ordered(batches, "at", "seq")
        allowed = []
        for at in ats:
            if start is None or at - start >= width:
                start, n = float(at), 0
            n += 1
            allowed.append(n <= most)
        state.update((start, n))
        state.setTimeoutTimestamp(max(int((start + width) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]] * len(seqs), "seq": seqs, "allowed": allowed})

    return run


def rate_limited(requests: DataFrame, key: str, width: float, most: int, late: str = "1 minute") -> DataFrame:
    """Fixed windows anchored at a client's first request: allowed is false from request `most` + 1 on.

    Requests that come more than `late` behind the newest one are left out; a client's state goes once its window is
    past that, so idle clients take no room."""
    rows = requests.select(F.col(key).cast("long").alias("key"), F.col("at").cast("double").alias("at"), F.col("seq").cast("long").alias("seq"))
    rows = rows.withColumn("time", F.timestamp_millis((F.col("at") * 1000).cast("long"))).withWatermark("time", late)
    return rows.groupBy("key").applyInPandasWithState(_limiter(width, most), "key long, seq long, allowed boolean", "start double, n long", "append", GroupStateTimeout.EventTimeTimeout)
