"""Scoring documents by a gated recurrent language model and by a smoothed unigram base.

1. Documents become blocks of some MB: a block's distinct words with their counts, and its tokens as
   numbers into them. Only blocks, never texts, are shuffled afterwards.
2. Word counts over all training documents give the base, the shortlist of the most frequent words and
   the shares of all others.
3. The model starts as the unigram model. In each round every block trains a copy on its share of its own
   training documents, and the copies' parameters are averaged by their tokens. The rounds' shares are
   disjoint and together hold every training document, so each training token is learnt from once.
4. Each block gets its words' counts back and scores all its documents, state carried from window to
   window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from . import textkit as K
from .common import map_arrow, written

HELD_OUT_OF, SMOOTH = 10, 0.1
#: Words with an output of their own; one row for each comes to the driver.
SHORTLIST = 1024
BLOCK_BYTES = 8 << 20
#: Every training document belongs to one of so many rounds.
ROUNDS = 2

_TABLE = K.byte_table(K.BLANKS, lower=True)
_END = K.U(0x5851F42D4C957F2D)
_BLOCKS = "block long, doc_id array<long>, held array<boolean>, n array<int>, tokens binary, words array<long>, counts array<int>, tail array<tinyint>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 24
    parts, size = [], 0  # of the block that is being filled
    for batch in batches:
        for part, data, offsets in K.pieces(batch.column("text")):
            w = K.split(data, offsets, _TABLE)
            # The last two bytes of a word tell its tail class; endings differ between languages.
            ending = _lower(data[w.end - 1]) * 31 + _lower(data[np.maximum(w.end - 2, w.start)]) * 7 if len(w.end) else w.end
            texts = slice(part.start, part.stop)
            parts.append((
                np.insert(w.hash, w.first[1:], _END), np.insert((ending % gru.TAIL).astype(np.int8), w.first[1:], 0), w.counts + 1,
                batch.column("held").to_numpy(zero_copy_only=False)[texts], batch.column("doc_id").slice(part.start, part.stop - part.start),
            ))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield _block(number, parts)
                number, parts, size = number + 1, [], 0
    if parts:
        yield _block(number, parts)


def _block(number: int, parts: list[tuple]) -> pa.RecordBatch:
    h, tail, n, held = (np.concatenate(x) for x in list(zip(*parts))[:4])
    words, at, tokens = np.unique(h, return_index=True, return_inverse=True)
    # The most frequent words of a block have the smallest numbers, so the upper bytes of tokens are mostly zero.
    rank = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
    words, at = words[rank], at[rank]
    tokens = np.argsort(rank)[tokens]
    counts = np.bincount(tokens[np.repeat(~held, n)], minlength=len(words))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number]), _one(pa.concat_arrays([p[4] for p in parts])), _one(pa.array(held)), _one(pa.array(n.astype(np.int32))),
            pa.array([_planes(tokens)], pa.binary()), _one(pa.array(words.view(np.int64))),
            _one(pa.array(counts.astype(np.int32))), _one(pa.array(tail[at])),
        ],
        ["block", "doc_id", "held", "n", "tokens", "words", "counts", "tail"],
    )


def _planes(tokens: np.ndarray) -> bytes:
    """All low bytes, then all second bytes and so on: runs that compress well."""
    return np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int32)


def _lower(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.int64)


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class Vocabulary:
    """Shortlist hashes by rank, with their counts, and the smoothed counts of the tail classes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, mass: np.ndarray, total: int, distinct: int) -> None:
        self.words, self.counts, self.mass, self.total, self.distinct = words, counts, mass, total, distinct
        self.order = np.argsort(words)

    def ids(self, hashes: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """The model's numbers: rank of a shortlist word, else SHORTLIST-wide offset plus tail class."""
        n = len(self.words)
        if not n:
            return tail.astype(np.int64)
        ranked = self.words[self.order]
        at = np.minimum(np.searchsorted(ranked, hashes), n - 1)
        return np.where(ranked[at] == hashes, self.order[at], n + tail.astype(np.int64))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))


def _block_rows(table) -> Iterator[tuple]:
    """words, tail, n, held, tokens of each row."""
    for i in range(table.num_rows):
        words, tail, n, held = (table.column(k)[i].values.to_numpy(zero_copy_only=False) for k in ("words", "tail", "n", "held"))
        tokens = _from_planes(table.column("tokens")[i].as_buffer())
        yield words, tail, n, held.astype(bool), tokens


def _trainer(flat: np.ndarray, vocabulary: Vocabulary, turn: int, rounds: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens_seen = np.zeros(len(flat)), 0
        for batch in batches:
            for words, tail, n, held, tokens in _block_rows(batch):
                ids, first = vocabulary.ids(words, tail)[tokens], np.r_[0, np.cumsum(n)]
                texts = np.random.default_rng(1).permutation(np.flatnonzero(~held))[turn::rounds]
                if len(texts):
                    model, size = gru.Model(flat.copy(), len(vocabulary.words)), int(n[texts].sum())
                    model.train(np.concatenate([ids[first[t] : first[t + 1]] for t in texts]), np.r_[0, np.cumsum(n[texts])])
                    if not np.isfinite(model.flat).all():  # Adam's steps are bounded, so this is a fault, not a block to pass over
                        raise ArithmeticError("training left the range of numbers")
                    total += model.flat.astype(float) * size
                    tokens_seen += size
        if tokens_seen:
            at = pa.array(np.arange(len(flat), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([at, pa.array(total), pa.array(np.full(len(flat), tokens_seen))], ["at", "total", "tokens"])

    return train


def _scorer(flat: np.ndarray, vocabulary: Vocabulary):
    def score(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        model, out = gru.Model(flat.copy(), len(vocabulary.words)), []
        blocks = blocks.combine_chunks()
        for i, (words, tail, n, held, tokens) in enumerate(_block_rows(blocks)):
            c = np.zeros(len(words))
            c[counts.column("at").to_numpy()] = counts.column("c").to_numpy(zero_copy_only=False)
            ids, first = vocabulary.ids(words, tail), np.r_[0, np.cumsum(n)]
            rest = np.where(ids < len(vocabulary.words), 0.0, np.log10((c + SMOOTH) / vocabulary.mass[tail]))
            lp = model.score(ids[tokens], first) / np.log(10) + rest[tokens]
            of = np.repeat(np.arange(len(n)), n)

            def per_text(of_word: np.ndarray, of: np.ndarray = of, tokens: np.ndarray = tokens, texts: int = len(n)) -> np.ndarray:
                return np.bincount(of, of_word[tokens], minlength=texts)

            out.append(pa.table({
                "doc_id": blocks.column("doc_id")[i].values, "held_out": pa.array(held), "n_tokens": pa.array(n.astype(np.int64)),
                "n_known": pa.array(per_text((c > 0).astype(float)).astype(np.int64)), "train_tokens": pa.array(np.full(len(n), vocabulary.total, np.int64)),
                "base_score": pa.array(per_text(vocabulary.base(c))), "score": pa.array(np.bincount(of, lp, minlength=len(n))),
            }))
        return pa.concat_tables(out)

    return score


def score_documents(docs: DataFrame, shortlist: int = SHORTLIST, rounds: int = ROUNDS) -> DataFrame:
    """Log10 probabilities of the texts of docs (doc_id, text): a row for each row of docs with

    doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score (unigram),
    score (the recurrent model).

    Tokens are words in lower case (A-Z only) and one end. Documents whose crc32(doc_id as text) mod 10 is
    not 0 train both; a null doc_id is held out. A null text counts as empty and has the end alone. Rows
    that repeat a doc_id are scored each by its own text, and count each. Without training documents the
    model is uniform over its classes.

    The model's probabilities of a text's tokens sum to one over shortlist words, known words and one
    unknown word for each tail class.
    """
    spark = docs.sparkSession
    id_ = F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(id_.cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(True))
    rows = docs.select(id_.alias("doc_id"), held.alias("held"), F.col("text").cast("string").alias("text"))
    blocks, _ = written(map_arrow(rows, _blocks, _BLOCKS), "blocks")
    counts, _ = written(
        blocks.select(F.inline(F.arrays_zip("words", "counts", "tail"))).where("counts > 0").groupBy("words").agg(F.sum("counts").alias("c"), F.first("tail").alias("tail")), "counts"
    )
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    top = counts.orderBy(F.desc("c"), "words").limit(shortlist).collect()
    words = np.array([r["words"] for r in top], np.int64)
    own = spark.createDataFrame([(int(w),) for w in words], "words long")
    tails = {r["tail"]: r["m"] for r in counts.join(F.broadcast(own), "words", "left_anti").groupBy("tail").agg(F.sum(F.col("c") + F.lit(SMOOTH)).alias("m")).collect()}
    mass = np.array([float(tails.get(t, 0.0)) + SMOOTH for t in range(gru.TAIL)])
    vocabulary = Vocabulary(words, np.array([r["c"] for r in top], float), mass, int(total), int(distinct))
    flat = gru.start(vocabulary.counts, mass)
    for turn in range(rounds):
        mean = (
            blocks.select("held", "n", "tokens", "words", "tail").mapInArrow(_trainer(flat, vocabulary, turn, rounds), "at int, total double, tokens long")
            .groupBy("at").agg((F.sum("total") / F.sum("tokens")).alias("value")).orderBy("at").collect()
        )
        if mean:
            flat = np.array([r["value"] for r in mean], np.float32)
    # A task scores one block, or the few that hash alike, so its memory doesn't grow with the corpus.
    tasks = max(1, blocks.count())
    known = (
        blocks.select(F.col("block").alias("of"), F.posexplode("words").alias("at", "words"))
        .join(counts.select("words", "c"), "words").select("of", "at", "c").repartition(tasks, "of")
    )
    return (
        blocks.select("block", "doc_id", "held", "n", "tokens", "words", "tail").repartition(tasks, "block").groupBy("block")
        .cogroup(known.groupBy("of"))
        .applyInArrow(_scorer(flat, vocabulary), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
