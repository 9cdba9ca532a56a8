"""Substring dedup over windows of 50 words by super-k-mer partitioning.

The minimiser of a window is the least hash among its runs of MINIMISER words. Consecutive windows
of one minimiser form a super-k-mer, one packed string of the words they span. Equal windows have
equal minimisers, so a window can only recur where its minimiser does:

1. Each document gives (minimiser, hash of the packed string, place). Minimisers of one document
   only are done: none of their windows recurs elsewhere.
2. Equal packed strings meet by hash, so copies cost one row: every later document loses the whole
   super-k-mer, and only the first document's windows remain to be judged.
3. Where a minimiser has different packed strings, one string of each travels to the minimiser's
   bucket. There the windows are sorted, and each learns the smallest document that holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import map_arrow, written

WINDOW, MINIMISER = 50, 10
#: A bucket sorts up to so many packed strings of one minimiser in memory (about 50 MB); the windows of a larger
#: one are grouped by a shuffle.
BUCKET = 20_000
_CHUNK = 4 << 20  # bytes of packed strings that are sorted at once, if their minimisers are complete


def _super_kmers(words: K.Words, window: int, m: int) -> tuple[np.ndarray, ...]:
    """minimiser, hash, first word, number of windows of each super-k-mer."""
    h, at = K.runs(words, m)
    value = np.full(len(words.hash) + window, np.iinfo(np.uint64).max, K.U)
    value[at] = h
    width, span = 1, window - m + 1
    while width * 2 <= span:
        value = np.minimum(value, np.r_[value[width:], np.full(width, np.iinfo(np.uint64).max, K.U)])
        width *= 2
    last = np.repeat(words.first[1:], words.counts)
    start = np.flatnonzero(np.arange(len(words.hash)) + window <= last)
    least = np.minimum(value[start], value[start + span - width])
    new = np.r_[True, (start[1:] != start[:-1] + 1) | (least[1:] != least[:-1])] if len(start) else np.zeros(0, bool)
    run = np.flatnonzero(new)
    place = np.arange(len(start)) - np.repeat(run, np.diff(np.r_[run, len(start)]))
    run = np.flatnonzero(place % span == 0)
    n = np.diff(np.r_[run, len(start)])
    first = start[run]
    return least[run], K.span_hash(words, first, first + n + window - 1), first, n


def _scan(window: int, m: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.pieces(batch.column("text")):
                words = K.split(data, offsets)
                mini, packed, first, n = _super_kmers(words, window, m)
                text = np.searchsorted(words.first, first, "right") - 1
                row = pa.array(part.start + text)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(row), batch.column("th").take(row), pa.array(mini.view(np.int64)), pa.array(packed.view(np.int64)),
                        pa.array((first - words.first[text]).astype(np.int32)), pa.array(n.astype(np.int32)),
                    ],
                    ["doc_id", "th", "mini", "packed", "start", "windows"],
                )

    return scan


def _packer(window: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, asked in zip(batch.column("doc_id"), batch.column("text"), batch.column("asked")):
                words = text.as_py().encode().split()
                out += [(a["mini"], a["packed"], doc.as_py(), a["large"], b" ".join(words[a["start"] : a["start"] + a["windows"] + window - 1]).decode()) for a in asked.as_py()]
                if sum(len(x[4]) for x in out[-len(asked) :]) > _CHUNK or len(out) > 5_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return pack


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["mini", "packed", "doc_id", "large", "words"])


def _windows(column: pa.Array, window: int) -> tuple[np.ndarray, ...]:
    """Of packed strings: row, place in the row and 128-bit key of every window."""
    out = []
    for part, data, offsets in K.pieces(column):
        words = K.split(data, offsets)
        a, at = K.runs(words, window)
        b, _ = K.runs(words, window, salt=0x2545F4914F6CDD1D)
        row = words.text_of_word()[at]
        out.append((part.start + row, at - words.first[row], a, b))
    return tuple(np.concatenate(x) for x in zip(*out))


def _sorted_bucket(window: int):
    """Rows come sorted by minimiser and packed string; for each packed string, gives the runs of windows that a smaller document holds too."""

    def judge(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        row, place, a, b = _windows(table.column("words").combine_chunks(), window)
        doc = table.column("doc_id").to_numpy()[row]
        order = np.lexsort((doc, b, a))
        new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
        least = np.repeat(doc[order][new], np.diff(np.r_[np.flatnonzero(new), len(order)]))
        lost = np.sort(order[least < doc[order]])
        row, place = row[lost], place[lost]
        first = np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)] if len(row) else np.zeros(0, bool)
        last = np.r_[first[1:], True] if len(row) else first
        at = pa.array(row[first])
        return pa.RecordBatch.from_arrays(
            [table.column(c).take(at).combine_chunks() if len(at) else pa.array([], pa.int64()) for c in ("mini", "packed")]
            + [pa.array(place[first].astype(np.int32)), pa.array(place[last].astype(np.int32))],
            ["mini", "packed", "lo", "hi"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # rows that repeat a document send its strings again; of each string one stays
            key = np.stack([batch.column(c).to_numpy() for c in ("mini", "packed")])
            other = np.r_[last is None or (key[:, 0] != last).any(), (key[:, 1:] != key[:, :-1]).any(0)]
            last = key[:, -1]
            new = pa.Table.from_batches([batch]).filter(pa.array(other))
            if not new.num_rows:
                continue
            held = new if held is None else pa.concat_tables([held, new])
            if held.nbytes >= _CHUNK:
                mini = held.column("mini").to_numpy()
                cut = int(np.searchsorted(mini, mini[-1]))  # the last minimiser may go on in the next batch
                if cut:
                    yield judge(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield judge(held)

    return run


def _exploder(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, place, a, b = _windows(batch.column("words"), window)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *(batch.column(c).take(at) for c in ("mini", "packed", "doc_id")), pa.array(place.astype(np.int32))],
                    ["a", "b", "mini", "packed", "doc_id", "place"],
                )

    return run


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words_in, removed, digest = [], [], []
        for text, ranges in zip(batch.column("text"), batch.column("ranges")):
            words = (text.as_py() or "").encode().split()
            kept = words
            if ranges.is_valid:
                gone = np.zeros(len(words) + 1, np.int64)
                r = ranges.as_py()
                np.add.at(gone, [x["lo"] for x in r], 1)
                np.add.at(gone, [x["hi"] for x in r], -1)
                kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
            words_in.append(len(words))
            removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words_in, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_ranges(rows: DataFrame, window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """rows (doc_id not null, th, text), th telling apart texts of one doc_id. Returns doc_id, th and
    ranges, an array of word ranges lo to hi (exclusive) that windows of smaller documents cover."""
    place, _ = written(map_arrow(rows, _scan(window, m), "doc_id long, th long, mini long, packed long, start int, windows int"), "super-k-mers")
    shared = (
        place.groupBy("mini")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("packed").alias("p"), F.max("packed").alias("q"))
        .where("lo <> hi").select("mini", (F.col("p") != F.col("q")).alias("mixed"))
    )
    place, _ = written(place.join(shared, "mini").distinct(), "shared")  # a repeated row gives its places once
    first = place.groupBy("mini", "packed").agg(F.min("doc_id").alias("least"), F.first("mixed").alias("mixed"))
    first, _ = written(first, "first")
    many = first.where("mixed").groupBy("mini").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("mini", F.lit(True).alias("large"))
    owner = place.join(first.select("mini", "packed", "least"), ["mini", "packed"])
    later = owner.where("doc_id > least").select("doc_id", "th", F.col("start").alias("lo"), (F.col("start") + F.col("windows") + window - 1).alias("hi"))
    own = owner.where("doc_id = least and mixed")
    asked = (
        own.groupBy("mini", "packed").agg(F.min(F.struct("doc_id", "th", "start", "windows")).alias("x"))
        .join(many, "mini", "left")
        .groupBy("x.doc_id", "x.th").agg(F.collect_list(F.struct("mini", "packed", "x.start", "x.windows", F.coalesce("large", F.lit(False)).alias("large"))).alias("asked"))
    )
    strings = map_arrow(rows.join(asked, ["doc_id", "th"]).select("doc_id", "text", "asked"), _packer(window), "mini long, packed long, doc_id long, large boolean, words string")
    strings, _ = written(strings, "packed")
    bucket = strings.where("not large").select("mini", "packed", "doc_id", "words").repartition("mini").sortWithinPartitions("mini", "packed")
    lost = bucket.mapInArrow(_sorted_bucket(window), "mini long, packed long, lo int, hi int")
    spread = strings.where("large").mapInArrow(_exploder(window), "a long, b long, mini long, packed long, doc_id long, place int")
    least = spread.groupBy("a", "b").agg(F.min("doc_id").alias("least"))
    lost = lost.unionByName(spread.join(least, ["a", "b"]).where("least < doc_id").select("mini", "packed", F.col("place").alias("lo"), F.col("place").alias("hi")))
    some = own.join(lost.distinct(), ["mini", "packed"]).select("doc_id", "th", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + window).alias("hi"))
    return later.unionByName(some).groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Removes repeated passages from docs (doc_id, text): a row for each row of docs with doc_id, n_words,
    n_removed, kept_sha256 (of the kept words joined by one space).

    A word goes if a window of `window` words that covers it also starts in a document with a smaller
    doc_id. Windows are those of the input. Words are runs of anything but ASCII white space. A null
    text has no words; texts shorter than the window keep all. A null doc_id keeps all and takes
    nothing from others. Rows that repeat a doc_id are one document: none of them takes from another.
    Windows are compared by 128-bit keys of their words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    ranges = repeated_ranges(rows.where("doc_id is not null and text is not null"), window)
    return map_arrow(rows.join(ranges, ["doc_id", "th"], "left").select("doc_id", "text", "ranges"), _cutter, "doc_id long, n_words long, n_removed long, kept_sha256 string")
