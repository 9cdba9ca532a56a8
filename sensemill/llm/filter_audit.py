"""How document filters overlap, for every order in which they could run.

A table-driven byte transducer walks the UTF-8 bytes of a text once. Its state after a byte is whether a
word is open, its output a set of marks (word begins, word ended, capital, symbol, continuation byte), both
looked up by state and byte. Finished word spans go into an open-addressing hash table, in which two words
count as equal only after their bytes are compared; its new entries are the text's distinct words.

From there on only small rows travel: a document is its failure pattern, one bit a filter. Equal texts
meet by digest, patterns are summed by part, and each part's 2**k sums give all orders at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import map_arrow, written

LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2  # words; percent of words; percent of code points
SYMBOLS = b"#$%&*|"
FILTERS = "ABCDE"
#: Bytes that the transducer takes in at once.
STEP = 1 << 18
#: Words up to so many bytes are hashed and compared eight bytes at a time, all at once; longer ones singly.
LONG = 256

BEGIN, ENDED, CAPITAL, SYMBOL, CONTINUED = 1, 2, 4, 8, 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """NEXT[byte]: 1 if a word is open after it, in either state; EMIT[state * 256 + byte]: marks."""
    opened = np.ones(256, np.uint8)
    opened[np.frombuffer(K.BLANKS, np.uint8)] = 0
    emit = np.zeros((2, 256), np.uint8)
    emit[0] |= np.where(opened == 1, BEGIN, 0).astype(np.uint8)
    emit[1] |= np.where(opened == 0, ENDED, 0).astype(np.uint8)
    emit[:, 65:91] |= CAPITAL
    emit[:, np.frombuffer(SYMBOLS, np.uint8)] |= SYMBOL
    emit[:, 0x80:0xC0] |= CONTINUED
    return opened, emit.ravel()


NEXT, EMIT = _tables()
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def _eight(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first bytes, eight at most, of the spans, as integers. data has eight bytes more than any span."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[start].view(np.uint64)[:, 0] & _MASKS[np.clip(size, 0, 8)]


class Spans:
    """A hash table of the word spans of some texts; data holds the texts and eight bytes more."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.n = data, 0
        self.start, self.size, self.text = (np.zeros(0, np.int64) for _ in range(3))
        self.key = np.zeros(0, np.uint64)
        self.slots = np.full(1 << 10, -1, np.int64)

    def _hash(self, start: np.ndarray, size: np.ndarray, text: np.ndarray) -> np.ndarray:
        h = K.mix(text.astype(np.uint64) * K.U(0x9E3779B97F4A7C15) + size.astype(np.uint64))
        live, at = np.flatnonzero(size <= LONG), 0
        while len(live):
            h[live] = K.mix(h[live] ^ _eight(self.data, start[live] + at, size[live] - at)) + K.U(0xD1342543DE82EF95)
            at += 8
            live = live[size[live] > at]
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = np.uint64(hash(self.data[start[i] : start[i] + size[i]].tobytes()) & (1 << 64) - 1) ^ h[i]
        return h

    def _equal(self, a: tuple, b: tuple) -> np.ndarray:
        """Whether spans a and b (start, size, text, key) are the same word of the same text, by their bytes."""
        same = (a[1] == b[1]) & (a[2] == b[2]) & (a[3] == b[3])
        live, at = np.flatnonzero(same & (a[1] <= LONG)), 0
        while len(live):
            left = a[1][live] - at
            good = _eight(self.data, a[0][live] + at, left) == _eight(self.data, b[0][live] + at, left)
            same[live[~good]] = False
            at += 8
            live = live[good & (left > 8)]
        for i in np.flatnonzero(same & (a[1] > LONG)).tolist():
            s, t, n = int(a[0][i]), int(b[0][i]), int(a[1][i])
            same[i] = np.array_equal(self.data[s : s + n], self.data[t : t + n])
        return same

    def _grow(self, more: int) -> None:
        need = 1 << int(2 * (self.n + more)).bit_length()
        if need <= len(self.slots):
            return
        self.slots = np.full(need, -1, np.int64)
        live, slot, mask = np.arange(self.n), (self.key & K.U(need - 1)).astype(np.int64), need - 1
        while len(live):  # entries differ from each other, so a slot taken by another one is passed by
            free = live[self.slots[slot[live]] < 0]
            self.slots[slot[free]] = free
            live = live[self.slots[slot[live]] != live]
            slot[live] = (slot[live] + 1) & mask

    def add(self, start: np.ndarray, size: np.ndarray, text: np.ndarray) -> None:
        self._grow(len(start))
        key, mask, base = self._hash(start, size, text), len(self.slots) - 1, self.n
        every = [np.r_[a, b] for a, b in ((self.start, start), (self.size, size), (self.text, text), (self.key, key))]
        live, slot, new = np.arange(len(start)), (key & K.U(mask)).astype(np.int64), np.zeros(len(start), bool)
        while len(live):
            free = live[self.slots[slot[live]] < 0][::-1]
            self.slots[slot[free]] = base + free  # the first of those that ask for a slot
            owner = self.slots[slot[live]]
            won = owner == base + live
            new[live[won]] = True
            rest, owner = live[~won], owner[~won]
            met = self._equal(tuple(e[base + rest] for e in every), tuple(e[owner] for e in every))
            live = rest[~met]
            slot[live] = (slot[live] + 1) & mask
        kept = np.flatnonzero(new)
        self.slots[slot[kept]] = base + np.arange(len(kept))
        self.start, self.size, self.text, self.key = (e[np.r_[np.arange(base), base + kept]] for e in every)
        self.n = base + len(kept)


def transduce(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """words, distinct words, capitals, symbols and code points of each text data[offsets[i]:offsets[i+1]].

    What a text takes beyond its bytes grows with its distinct words only.
    """
    n_texts, padded = len(offsets) - 1, np.r_[data, np.zeros(8, np.uint8)]
    out, spans = np.zeros((5, n_texts), np.int64), Spans(padded)
    marks = {CAPITAL: 2, SYMBOL: 3, CONTINUED: 4}
    opened = np.zeros(0, np.int64)  # start of the word that is open at a step's begin
    for a in range(0, len(data), STEP):
        part = data[a : a + STEP]
        state = np.empty(len(part), np.uint8)
        state[1:] = NEXT[part[:-1]]
        state[0] = len(opened) > 0
        edges = np.unique(offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, a + len(part))]) - a
        closed = a + edges[(state[edges] == 1)]  # a word that ends with its text
        state[edges] = 0
        emit = EMIT[state.astype(np.int64) * 256 + part]
        for mark, row in marks.items():
            at = a + np.flatnonzero((emit & mark) != 0)
            out[row] += np.diff(np.searchsorted(at, offsets))
        begin, end = np.r_[opened, a + np.flatnonzero((emit & BEGIN) != 0)], np.sort(np.r_[a + np.flatnonzero((emit & ENDED) != 0), closed])
        if a + len(part) == len(data) and len(begin) > len(end):
            end = np.r_[end, len(data)]
        opened, begin = begin[len(end) :], begin[: len(end)]
        text = np.searchsorted(offsets, begin, "right") - 1
        out[0] += np.bincount(text, minlength=n_texts)
        spans.add(begin, end - begin, text)
    out[1] = np.bincount(spans.text, minlength=n_texts)
    out[4] = np.diff(offsets) - out[4]
    return out


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [transduce(data, offsets) for _, data, offsets in K.pieces(batch.column("text"))]
        if found:
            counts = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "digest")), *map(pa.array, counts)], ["doc_id", "part", "digest", *COUNTS])


def profile(docs: DataFrame, part: str = "source") -> DataFrame:
    """A row for each of docs (doc_id, text and the column part): doc_id, part (null: empty), digest (SHA-256 of the text),
    n_words, n_distinct, n_capitals, n_symbols, n_chars. A null text counts as empty."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return map_arrow(rows, _count, "doc_id long, part string, digest binary, " + ", ".join(f"{c} long" for c in COUNTS))


def failures() -> Column:
    """The failure pattern of a profile by the filters of one text: A too short, B repetitive, C capitals, D symbols."""
    c = {n: F.col(n) for n in COUNTS}
    fails = [
        c["n_words"] < LEAST_WORDS, 100 * c["n_distinct"] < LEAST_DISTINCT * c["n_words"],
        100 * c["n_capitals"] > MOST_CAPITALS * c["n_chars"], c["n_symbols"] > 0,
    ]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def patterns(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, pattern, n, good, toxic: documents by the set of filters they fail, the copies filter being the last bit."""
    copy = 1 << (len(FILTERS) - 1)
    rows = profile(docs, part).withColumn("pattern", failures()).groupBy("doc_id", "digest", "part", "pattern").agg(F.count(F.lit(1)).alias("n"))
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")).where("doc_id is not null")
        .groupBy("doc_id").agg(F.max(F.coalesce("q", F.lit(False))).cast("int").alias("q"), F.max(F.coalesce("t", F.lit(False))).cast("int").alias("t"))
    )
    rows = rows.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in "qt"})
    # one row for each text, part and labels: the rows of its smallest document and those of all; a row without an id stands by itself
    texts = rows.groupBy("digest", "part", "pattern", "q", "t", F.col("doc_id").isNull().alias("alone")).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    texts, _ = written(texts, "texts")
    least = texts.where("not alone").groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    alone = texts.where("alone").select("part", "pattern", "q", "t", "n")
    met = texts.where("not alone").join(least, "digest").withColumn("firsts", F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0)))
    both = F.array(F.struct("pattern", F.col("firsts").alias("n")), F.struct((F.col("pattern") + copy).alias("pattern"), (F.col("n") - F.col("firsts")).alias("n")))
    met = met.select("part", "q", "t", F.explode(both).alias("x")).select("part", "x.pattern", "q", "t", "x.n")
    return met.unionByName(alone).groupBy("part", "pattern").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("q")).alias("good"), F.sum(F.col("n") * F.col("t")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """For each part of docs (doc_id, text, part) and each order of the filters, what each step does.

    Returns part, filter_order, step, and the long counts kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley; labels is (doc_id, quality, toxic).

    A null part is the empty string. A null text counts as empty; the empty text fails A, and E if a smaller document
    is empty too. Rows of one doc_id are counted each; none is a copy of the others. A row without an id is no copy,
    nor has it copies or labels. A document labelled twice is good (toxic) if one label says so. Other columns
    are ignored. Without documents there are no parts and no rows.
    """
    all_of = range(1 << len(FILTERS))
    sums = patterns(docs, labels, part).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("pattern", F.struct("n", "good", "toxic")))).alias("by"))
    for c in ("n", "good", "toxic"):
        sums = sums.withColumn(c, F.array(*(F.coalesce(F.col("by")[p][c], F.lit(0).cast("long")) for p in all_of)))
    orders = F.array(*(F.lit("".join(o)) for o in permutations(FILTERS)))
    rows = sums.select("part", "n", "good", "toxic", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = [F.instr("filter_order", f) for f in FILTERS]
    rows = rows.withColumns(
        {
            "bit": sum((F.when(p == F.col("step"), F.lit(1 << i)).otherwise(0) for i, p in enumerate(place)), F.lit(0)),
            "earlier": sum((F.when(p < F.col("step"), F.lit(1 << i)).otherwise(0) for i, p in enumerate(place)), F.lit(0)),
        }
    )

    def total(what: str, test: str, times: str = "1") -> Column:
        return F.expr(f"aggregate(sequence(0, {len(all_of) - 1}), 0L, (a, p) -> a + if({test}, {what}[p] * {times}, 0L))")

    first, failed = "(p & bit) <> 0 and (p & earlier) = 0", "(p & bit) <> 0"
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), total("n", "(p & (earlier | bit)) = 0").alias("kept"), total("n", first).alias("removed"),
        total("n", f"{failed} and (p & earlier) <> 0").alias("redundant"), total("n", "p = bit").alias("unique_fails"), total("good", first).alias("good_lost"),
        total("toxic", first).alias("toxic_lost"), total("n", failed, f"({factorial(len(FILTERS))} div bit_count(p))").alias("shapley"),
    )
