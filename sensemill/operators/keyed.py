"""Folds over the ordered rows of a key that hold one state, however long a key's history is.

Rows are dealt by key and sorted inside their partitions; a partition is then one stream of Arrow batches, in which
only the state of the key that is open goes on from batch to batch. Beside that: row numbers over all rows of an order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensemill.tables import staged


class Fold(Protocol):
    """What happens to the rows of one key."""

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        """The next rows, in order, in any division; what is to be said of them at once."""

    def end(self) -> pa.RecordBatch | None:
        """After the last row."""


def _changes(batch: pa.RecordBatch, key: Sequence[str]) -> list[int]:
    """Where another key begins."""
    n, new = batch.num_rows, np.zeros(batch.num_rows, bool)
    for c in key:
        values = batch.column(c)
        codes = values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return [0, *np.flatnonzero(new).tolist(), n]


def folded_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], begin: Callable[[tuple], Fold], schema: str) -> DataFrame:
    """The rows of df through a Fold for each key, in order (nulls first); what the folds give, in the columns of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: tuple | None = None
        fold: Any = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out, cuts = [], _changes(batch, key)
            for a, b in zip(cuts, cuts[1:]):
                now = tuple(batch.column(c)[a].as_py() for c in key)
                if fold is None or now != open_key:
                    if fold is not None:
                        out.append(fold.end())
                    open_key, fold = now, begin(now)
                out.append(fold.feed(batch.slice(a, b - a)))
            if out := [x for x in out if x is not None]:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if fold is not None and (last := fold.end()) is not None:
            yield last

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with its rows' numbers, from 0, in the total order of the columns `order` (which tell all rows apart).

    Rows are dealt out by ranges, numbered inside their partition, and moved by the rows of the partitions before it, of which
    only the counts meet; no task sorts more than its range.
    """
    inside = (1 << 33) - 1  # monotonically_increasing_id is the partition, then the row's place in it
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged, _ = staged(ranged.select("*", F.shiftright("__id", 33).cast("int").alias("__part"), F.col("__id").bitwiseAND(inside).alias(name)).drop("__id"), "numbered")
    counts = sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "__part int, __before long")
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")
