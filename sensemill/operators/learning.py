"""Learning state: the scheduler as an ordered fold of reviews, due queues, dashboards, bulk reports.

Every "now" is the parameter as_of.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensemill.functions.score import day_end
from sensemill.operators.keyed import folded_rows

# The default weights of the public FSRS-6 scheduler. ---------------------------------
W = [
    0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796,
    1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542,
]
MAX_INTERVAL = 36_500
# -------------------------------------------------------------------------------------------------
DECAY = -W[20]
FACTOR = 0.9 ** (1 / DECAY) - 1


def review(stability: float | None, difficulty: float | None, days: float, grade: int) -> tuple[float, float, int]:
    """One step of the scheduler: stability and difficulty after a review, and the interval in days.

    Without earlier state the card is new. Grades: 1 again, 2 hard, 3 good, 4 easy.
    """

    def first(g: int) -> float:
        return W[4] - math.exp(W[5] * (g - 1)) + 1

    def clamp(d: float) -> float:
        return min(10.0, max(1.0, d))

    if stability is None or difficulty is None:
        s, d = W[grade - 1], clamp(first(grade))
    else:
        if days < 1:
            gain = math.exp(W[17] * (grade - 3 + W[18])) * stability ** -W[19]
            s = stability * (max(gain, 1.0) if grade >= 3 else gain)
        else:
            r = (1 + FACTOR * days / stability) ** DECAY
            if grade == 1:
                long = W[11] * difficulty ** -W[12] * ((stability + 1) ** W[13] - 1) * math.exp(W[14] * (1 - r))
                s = min(long, stability / math.exp(W[17] * W[18]))
            else:
                gain = math.exp(W[8]) * (11 - difficulty) * stability ** -W[9] * (math.exp(W[10] * (1 - r)) - 1)
                s = stability * (1 + gain * (W[15] if grade == 2 else 1) * (W[16] if grade == 4 else 1))
        change = -W[6] * (grade - 3)
        d = clamp(W[7] * first(4) + (1 - W[7]) * (difficulty + (10 - difficulty) * change / 9))
    s = max(s, 0.001)
    return s, d, int(min(MAX_INTERVAL, max(1, round(s))))


_STATE = "stability double, difficulty double, reps int, lapses int, at double, last_grade int"


class _Reviews:
    """A card's state after its reviews so far."""

    def __init__(self, key: tuple, names: list[str]) -> None:
        self.key, self.names = key, names
        self.state: tuple = (None, None, 0, 0, None, None)

    def feed(self, rows: pa.RecordBatch) -> None:
        self.kinds = [rows.schema.field(c).type for c in self.names]
        s, d, reps, lapses, before, last = self.state
        for kind, at, grade, start in zip(*(rows.column(c).to_pylist() for c in ("__kind", "at", "grade", "__start"))):
            if kind == 0:
                s, d, reps, lapses, before, last = start.values()
                continue
            lapses += int(s is not None and grade == 1)
            s, d, _ = review(s, d, 0.0 if before is None else (at - before) / 86_400, grade)
            reps, before, last = reps + 1, at, grade
        self.state = (s, d, reps, lapses, before, last)

    def end(self) -> pa.RecordBatch:
        s = self.state
        days = None if s[0] is None else int(min(MAX_INTERVAL, max(1, round(s[0]))))
        kinds = [pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
        columns = [pa.array([k], t) for k, t in zip(self.key, self.kinds)] + [pa.array([x], t) for x, t in zip((*s, days), kinds)]
        return pa.RecordBatch.from_arrays(columns, [*self.names, "stability", "difficulty", "reps", "lapses", "at", "last_grade", "interval_days"])


def folded(events: DataFrame, *key: str, start: DataFrame | None = None) -> DataFrame:
    """State per key after its reviews: events have the key, at (seconds), seq and grade, and are taken by at, seq, grade.

    start: states (of this function's columns) that the events continue; keys without events keep theirs. A key's
    history may have any length: only its state is held.
    """
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(*key).schema.fields)
    none = F.lit(None).cast(f"struct<{_STATE}>")
    rows = events.select(*key, F.lit(1).alias("__kind"), F.col("at").cast("double").alias("at"), F.col("seq").cast("long").alias("seq"), F.col("grade").cast("int").alias("grade"), none.alias("__start"))
    if start is not None:
        held = F.struct(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in _STATE.split(", ")])
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("at", "double"), ("seq", "long"), ("grade", "int"))]
        rows = rows.unionByName(start.select(*key, F.lit(0).alias("__kind"), *empty, held.alias("__start")))
    return folded_rows(rows, key, ["__kind", "at", "seq", "grade"], lambda k: _Reviews(k, list(key)), f"{keys}, {_STATE}, interval_days int")


class _Windows:
    """Numbers a client's requests in windows of `width` from the first request after the last window."""

    def __init__(self, key: tuple, width: float) -> None:
        self.width, self.begun, self.n = width, None, 0

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        at = rows.column("at").to_numpy()
        begun, number, i = np.empty(len(at), at.dtype), np.empty(len(at), np.int64), 0
        while i < len(at):  # a step a window
            if self.begun is None or at[i] >= self.begun + self.width:
                self.begun, self.n = at[i], 0
            stop = max(i + 1, int(np.searchsorted(at, self.begun + self.width)))
            begun[i:stop], number[i:stop] = self.begun, self.n + np.arange(1, stop - i + 1)
            self.n, i = self.n + stop - i, stop
        columns = {**{c: rows.column(c) for c in rows.schema.names}, "window_start": pa.array(begun), "number": pa.array(number)}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def end(self) -> None:
        return None


def windowed(requests: DataFrame, *key: str, width: int) -> DataFrame:
    """requests (the key, at, seq) by at and seq, with the start of their window and their number in it, from 1. A window is anchored at
    the first request that no window holds."""
    rows = requests.select(*key, F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return folded_rows(rows.where("at is not null"), key, ["at", "seq"], lambda k: _Windows(k, width), f"{schema}, window_start long, number long")


def due_bucket(due_at: Column, as_of: Column) -> Column:
    """0 overdue, 1 due before the day ends, 2 new; null: not due."""
    return F.when(due_at.isNull(), 2).when(due_at < as_of, 0).when(due_at <= day_end(as_of), 1)


def classified_assignments(requested: DataFrame, known: DataFrame, held: DataFrame, key: str, active: str) -> DataFrame:
    """Each requested key once, in its first position: not_found, already, reactivated or new."""
    first = requested.groupBy(key).agg(F.min("position").alias("position"))
    joined = first.join(known.select(key).distinct().withColumn("__k", F.lit(True)), key, "left").join(held.select(key, active), key, "left")
    status = F.when(F.col("__k").isNull(), "not_found").when(F.col(active).isNull(), "new").when(F.col(active), "already").otherwise("reactivated")
    return joined.select(key, "position", status.alias("status"))


def counted(df: DataFrame, *key: str, **conditions: Column) -> DataFrame:
    return df.groupBy(*key).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def patched(assignments: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Assignments after patches (key, state, priority_override, reset): only sent fields change; a reset without a state
    gives ASSIGNED, and the caller drops the scheduler's state with left_anti on the reset keys."""
    p = patches.select(key, F.col("state").alias("__state"), F.col("priority_override").alias("__priority"), F.col("reset").alias("__reset"))
    joined = assignments.join(p, key, "left")
    state = F.coalesce("__state", F.when(F.col("__reset"), "ASSIGNED"), "state")
    return joined.withColumn("state", state).withColumn("priority_override", F.coalesce("__priority", "priority_override")).select(*assignments.columns)
