"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text has a lookup table over its bins, and so has each of a few pairs of
features. Boosting goes round the features in turn: each time a shallow tree over the bins of one
feature (or of one pair) is fitted to the current gradient and added to that table. A score is the
logistic of the sum of the tables' entries, so scoring is one gather and addition for each table.

Features are counted over the bytes, words and lines of the whole text; none depends on language,
source, doc_id or a label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import map_arrow

#: At most so many labelled rows, those with the smallest hash of their doc_id, fit the model. On the driver they are about 4 MB.
TRAIN_ROWS = 20_000
HELD_OUT_OF, KEEP_FROM = 5, 0.3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "bang": b"!?",
    "symbol": b"#$%&*@^~=+<>\\{}[]_/",
    "bar": b"|",
    "stop": b".,;:",
    "quote": b"'\"()-",
    "line": b"\n",
    "blank": b" \t\r\x0b\x0c",
}
_CODE = np.zeros(256, np.uint8)
for _i, _b in enumerate(_CLASSES.values()):
    _CODE[np.frombuffer(_b, np.uint8)] = _i + 1
_CODE[128:] = len(_CLASSES) + 1
_LINES = K.byte_table(b"\n")

FEATURES = [
    *(f"share_{c}" for c in _CLASSES), "share_high", "log_words", "word_len", "word_len_sd", "longest_word", "short_words",
    "same_as_before", "distinct_words", "words_a_line", "distinct_lines", "symbol_words", "capital_words",
]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x FEATURES; a text without words has zeros."""
    texts, size = len(offsets) - 1, np.diff(offsets)
    code = _CODE[data]

    def per_text(marks: np.ndarray, at: np.ndarray = offsets) -> np.ndarray:
        if marks.dtype == bool:
            return np.diff(np.searchsorted(np.flatnonzero(marks), at)).astype(float)
        return np.diff(np.r_[0, np.cumsum(marks)][at])

    share = [per_text(code == i + 1) / np.maximum(size, 1) for i in range(len(_CLASSES) + 1)]
    words = K.split(data, offsets)
    n, first, of = words.counts, words.first, words.text_of_word()
    some = np.maximum(n, 1)
    length = (words.end - words.start).astype(float)
    mean = per_text(length, first) / some
    spread = np.sqrt(np.maximum(per_text(length**2, first) / some - mean**2, 0))
    longest = np.zeros(texts)
    np.maximum.at(longest, of, length)
    same = np.r_[False, (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])] if len(of) else np.zeros(0, bool)

    def distinct(w: K.Words, of: np.ndarray) -> np.ndarray:
        key = np.sort((of.astype(K.U) << K.U(32)) | (w.hash >> K.U(32)))
        new = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        return np.bincount((new >> K.U(32)).astype(np.int64), minlength=texts) / np.maximum(w.counts, 1)

    lines = K.split(data, offsets, _LINES)
    odd = np.isin(code[words.end - 1], [3, 4, 5]) if len(of) else np.zeros(0, bool)
    capital = (code[words.start] == 1) & (code[np.minimum(words.start + 1, words.end - 1)] == 1) if len(of) else np.zeros(0, bool)
    return np.column_stack([
        *share, np.log1p(n), mean, spread, np.log1p(longest), per_text(length <= 3, first) / some,
        per_text(same, first) / some, distinct(words, of), n / np.maximum(lines.counts, 1), distinct(lines, lines.text_of_word()),
        per_text(odd, first) / some, per_text(capital, first) / some,
    ])


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton steps for each bin from a tree of so many leaves over ordered bins, and its gain."""
    cg, ch = np.r_[0.0, np.cumsum(g)], np.r_[0.0, np.cumsum(h)]

    def worth(a, b):
        return (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)

    cuts, gain = [0, len(g)], 0.0
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            c = np.arange(a + 1, b)
            c = c[(ch[c] - ch[a] >= least) & (ch[b] - ch[c] >= least)]
            if len(c):
                gains = worth(a, c) + worth(c, b) - worth(a, b)
                if (k := int(np.argmax(gains))) is not None and gains[k] > best[0]:
                    best = (float(gains[k]), int(c[k]))
        if best[1] is None:
            break
        gain += best[0]
        cuts = sorted([*cuts, best[1]])
    step = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        step[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return step, gain


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """The same over a grid: one cut of the rows, then a tree of two leaves over the columns on each side."""
    best = (np.zeros_like(g), 0.0)
    for cut in range(1, g.shape[0]):
        (low, a), (high, b) = (_tree(g[s].sum(0), h[s].sum(0), 2, least) for s in (slice(0, cut), slice(cut, None)))
        if a + b > best[1]:
            best = (np.vstack([np.tile(low, (cut, 1)), np.tile(high, (g.shape[0] - cut, 1))]), a + b)
    return best


@dataclass
class Additive:
    """edges: inner bin bounds of each feature; tables: a value for each of its bins; pairs: (a, b, grid over coarse bins)."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    bias: float
    coarse: int
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)])

    def grid(self, b: np.ndarray, f: int) -> np.ndarray:
        return b[:, f] * self.coarse // (len(self.edges[f]) + 1)

    def total(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.bias)
        for f, t in enumerate(self.tables):
            out += t[b[:, f]]
        for i, j, t in self.pairs:
            out += t[self.grid(b, i), self.grid(b, j)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.total(self.bins(x)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.15, leaves: int = 3, n_pairs: int = 6, pair_rounds: int = 40, coarse: int = 8) -> Additive:
    """Cyclic boosting of the log-likelihood. Without rows of both labels the score is a constant."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    p = (y.sum() + 1) / (len(y) + 2)
    model = Additive(edges, [np.zeros(len(e) + 1) for e in edges], float(np.log(p / (1 - p))), coarse)
    if not len(y) or y.min() == y.max():
        return model
    b, least = model.bins(x), max(1.0, 0.0005 * len(y))
    f = model.total(b)

    def slopes(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        return np.bincount(key, q - y, n), np.bincount(key, q * (1 - q), n)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            step, _gain = _tree(*slopes(b[:, k], len(table)), leaves, least * 0.05)
            step = rate * np.clip(step, -4, 4)
            table += step
            f += step[b[:, k]]
    grids = [model.grid(b, k) for k in range(x.shape[1])]

    def pair(i: int, j: int) -> tuple[np.ndarray, float]:
        return _pair_tree(*(s.reshape(coarse, coarse) for s in slopes(grids[i] * coarse + grids[j], coarse * coarse)), least * 0.05)

    ranked = sorted(((-pair(i, j)[1], i, j) for i in range(len(edges)) for j in range(i)))[:n_pairs]
    model.pairs = [(i, j, np.zeros((coarse, coarse))) for _, i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            step = rate * np.clip(pair(i, j)[0], -4, 4)
            table += step
            f += step[grids[i], grids[j]]
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(True))


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(data, offsets) for _, data, offsets in K.pieces(batch.column("text"))]
        if x:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *map(pa.array, np.concatenate(x).T)], ["doc_id", "quality", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Additive:
    """Fits the model on at most `most` rows of docs (doc_id, text) that labels (doc_id, quality) mark,
    never on held-out ones. A document marked twice counts with its lower mark."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = map_arrow(text.join(F.broadcast(known), "doc_id"), _numbers, "doc_id long, quality int, " + ", ".join(f"{f} double" for f in FEATURES))
    # one row for each labelled id, however often documents repeat it: at most `most` rows
    one = rows.groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("x"), F.first("quality").alias("quality"))
    got = one.select("doc_id", "quality", "x.*").toPandas().sort_values("doc_id")
    return fit(got[FEATURES].to_numpy(float).reshape(-1, len(FEATURES)), got["quality"].to_numpy(float))


def _batch_scores(model: Additive, column: pa.Array) -> pa.Array:
    s = [model.score(features(data, offsets)) for _, data, offsets in K.pieces(column)]
    return pa.array(np.concatenate(s) if s else np.zeros(0))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every row of docs (doc_id, text): doc_id, held_out, score (0 to 1, higher: label 1 is
    likelier), predicted (1 if score >= 0.3).

    A null text counts as empty; empty texts are scored like others, by features that are zero. A null
    doc_id is held out. Rows that repeat a doc_id are scored each by its own text. Other columns are
    ignored. Without labels all scores are one half.
    """
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _batch_scores(model, batch.column("text"))], ["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = map_arrow(rows, run, rows.select("doc_id").schema.add("score", "double"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def good_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with their columns, whatever these are named."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pc.greater_equal(_batch_scores(model, batch.column("text")), KEEP_FROM)
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(keep)], ["row"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].cast("string").alias("text"))
    return map_arrow(rows, run, rows.select("row").schema).select("row.*")
