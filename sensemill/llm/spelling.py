"""Groups of spelling variants: words at one edit, found by blocked Gram matrices.

One edit changes a word's letter counts by a vector of squared length one (a letter more or less) or two (one
letter for another), or by none if only words of the same letters were compared. So words are dealt to
blocks by their length and by how many of their letters fall into each of a few groups of letters, and only blocks
that one edit can lead between are paired: the same, one letter more, one letter moved to another group. In a
pair of blocks a matrix product of the letter counts gives all squared distances at once; pairs at two or
less are verified from both ends. Blocks are cut to chunks of bounded size, each pair of chunks is a row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, written

LEAST_CHARS, LEAST_N, ODDS = 5, 3, 97
#: Words, and their bytes, of one chunk; a product is of two chunks.
CHUNK, CHUNK_BYTES = 2048, 1 << 16
#: Distinct words that a counting task holds before it hands them on.
HELD = 200_000
_SLICE = 1 << 20

#: Byte by byte of Latin-1: letters as they are but A-Z lowered, all else blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str) -> Counter:
    """How often a text holds each run of letters, A-Z lowered, in Latin-1."""
    found, open_run = Counter(), b""
    for a in range(0, len(text), _SLICE):
        raw = open_run + text[a : a + _SLICE].encode("latin-1", "replace").translate(_LETTERS)  # what Latin-1 lacks becomes a question mark, then blank
        cut = raw.rfind(b" ") + 1 if a + _SLICE < len(text) else len(raw)
        open_run = raw[cut:]
        found.update(raw[:cut].split())
    return found


def _mutated(run: bytes, prefix: int) -> bytes:
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % ODDS:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counter(least: int):
    def give(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column("name"), batch.column("text")):
                prefix = zlib.crc32(f"{name.as_py()}:".encode())
                for r, k in runs_of(text.as_py()).items():
                    if len(r) >= least and len(r := _mutated(r, prefix)) >= least:
                        total[r] += k
                if len(total) >= HELD:
                    yield give(total)
                    total = Counter()
        yield give(total)

    return run


def vocabulary(docs: DataFrame, least: int = LEAST_CHARS, at_least: int = LEAST_N) -> DataFrame:
    """word, n: runs of Latin letters in docs (doc_id, text), as the contract of group_variants has them."""
    rows = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("name"), docs["text"].cast("string").alias("text")).where("text is not null")
    return map_arrow(rows, _counter(least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)


def groups_for(n: int) -> int:
    """Groups of letters, so many that blocks of eight-letter words hold some dozens of words each. Only work depends on it."""
    g = 3
    while g < 10 and comb(8 + g - 1, g - 1) * 8 * 64 < n:
        g += 1
    return g


def _sums(words: list[bytes], groups: int) -> np.ndarray:
    """Letters of each group, by code modulo `groups`, in each word."""
    data = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * groups + data % groups, minlength=len(words) * groups).reshape(-1, groups)


def _block_names(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = _sums([w.encode("latin-1") for w in batch.column("word").to_pylist()], groups)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([",".join(map(str, s)) for s in sums.tolist()], pa.string())], [*batch.schema.names, "block"])

    return run


def reached(block: str) -> list[str]:
    """The block itself and, of each two blocks that one edit leads between, the other one, from one of them only."""
    s = [int(x) for x in block.split(",")]
    out = [s]
    for i in range(len(s)):
        out.append([x + (k == i) for k, x in enumerate(s)])
        if s[i]:
            out += [[x - (k == i) + (k == j) for k, x in enumerate(s)] for j in range(i)]
    return [",".join(map(str, x)) for x in out]


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column("block").to_pylist():
            others = reached(block)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(others)), pa.array(others)], ["block", "other"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block and word; gives block, id of the chunk, its words (joined by blanks) and their counts."""
    open_block, words, n, size = None, [], [], 0

    def give() -> pa.RecordBatch:
        name = f"{zlib.crc32(words[0].encode()):08x}{words[0][:64]}"  # a word is in one chunk only
        columns = [pa.array([open_block]), pa.array([f"{open_block}/{name}"]), pa.array([" ".join(words)]), pa.array([n], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["block", "id", "words", "n"])

    for batch in batches:
        for block, word, k in zip(*(batch.column(c).to_pylist() for c in ("block", "word", "n"))):
            if words and (block != open_block or len(words) >= CHUNK or size >= CHUNK_BYTES):
                yield give()
                words, n, size = [], [], 0
            open_block = block
            words.append(word)
            n.append(k)
            size += len(word)
    if words:
        yield give()


def _padded(words: list[bytes], width: int, right: bool = False) -> np.ndarray:
    return np.frombuffer(b"".join(w.rjust(width, b"\0") if right else w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def one_edit(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of all pairs a[i], b[j] at exactly one edit. The words of a, and those of b, are of one length each."""
    n, m = len(a[0]), len(b[0])
    letters = np.unique(np.frombuffer(b"".join(a) + b"".join(b), np.uint8))
    kind = np.float32 if max(n, m) <= 2000 else np.float64  # so that all sums are exact
    code = np.zeros(256, np.int64)
    code[letters] = np.arange(len(letters))

    def counts(words: list[bytes], size: int) -> np.ndarray:
        at = np.repeat(np.arange(len(words)) * len(letters), size) + code[np.frombuffer(b"".join(words), np.uint8)]
        return np.bincount(at, minlength=len(words) * len(letters)).reshape(len(words), -1).astype(kind)

    x, y = counts(a, n), counts(b, m)
    far = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(far <= 2)
    found: list[tuple[np.ndarray, np.ndarray]] = [(i[:0], j[:0])]
    width = max(n, m)
    left, right = [(_padded(a, width, r), _padded(b, width, r)) for r in (False, True)]
    step = max(1, (1 << 22) // width)
    for s in range(0, len(i), step):
        p, q = i[s : s + step], j[s : s + step]
        low = min(n, m)
        before = np.cumprod(left[0][p, :low] == left[1][q, :low], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
        after = np.cumprod((right[0][p] == right[1][q])[:, ::-1][:, :low], axis=1, dtype=np.uint8).sum(1, dtype=np.int64)
        near = (before + after >= width - 1) & ((n != m) | (before < n))
        found.append((p[near], q[near]))
    return tuple(np.concatenate(z) for z in zip(*found))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two chunks: for each word with near words in the other, their number and the most frequent, smallest of them."""
    for batch in batches:
        out: list[list[pa.Array]] = []
        for same, *row in zip(*(batch.column(c).to_pylist() for c in ("same", "words_a", "n_a", "words_b", "n_b"))):
            names = [row[0].split(" "), row[2].split(" ")]
            i, j = one_edit(*([w.encode("latin-1") for w in x] for x in names))
            for k, (p, q) in enumerate(((i, j), (j, i))):
                if k and same or not len(p):  # within a chunk the product holds both directions
                    continue
                weight = np.array(row[3 - 2 * k], np.int64)[q]
                order = np.lexsort((q, -weight, p))  # words of a chunk are sorted
                first = np.r_[True, p[order][1:] != p[order][:-1]]
                at, best = p[order][first], q[order][first]
                size = np.diff(np.r_[np.flatnonzero(first), len(order)])
                mine, theirs = pa.array(names[k]), pa.array(names[1 - k])
                out.append([mine.take(pa.array(at)), pa.array(size), pa.array(weight[order][first]), theirs.take(pa.array(best))])
        if out:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out)], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best, best_n: for each word of words (word, n; distinct) that has near words, their number, and the most frequent
    of them (ties: the smallest) with its n. Words are Latin letters without blanks."""
    words, _ = written(words.select("word", "n"), "words")
    groups = groups_for(words.count())
    named = words.mapInArrow(_block_names(groups), "word string, n long, block string")
    # by ranges of (block, word), so that a block may lie in several partitions
    chunks = named.repartitionByRange("block", "word").sortWithinPartitions("block", "word").mapInArrow(_chunks, "block string, id string, words string, n array<long>")
    chunks, _ = written(chunks, "chunks")
    ids = chunks.select("block", "id")
    blocks = ids.select("block").distinct().mapInArrow(_reached, "block string, other string")
    # Pairs of ids, then the chunks themselves. All sides grow with the vocabulary while Spark takes them for small (a block reaches
    # dozens of others, files hold words compressed), so every join is told to shuffle.
    pairs = ids.join(blocks.hint("merge"), "block").select(F.col("block").alias("from"), F.col("id").alias("a"), F.col("other").alias("block"))
    pairs = pairs.join(ids.withColumnRenamed("id", "b").hint("merge"), "block").where((F.col("from") != F.col("block")) | (F.col("a") <= F.col("b"))).select("a", "b")
    rows = pairs.join(chunks.select(F.col("id").alias("a"), F.col("words").alias("words_a"), F.col("n").alias("n_a")).hint("merge"), "a")
    rows = rows.join(chunks.select(F.col("id").alias("b"), F.col("words").alias("words_b"), F.col("n").alias("n_b")).hint("merge"), "b")
    rows = rows.select((F.col("a") == F.col("b")).alias("same"), "words_a", "n_a", "words_b", "n_b")
    found = map_arrow(rows, _near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("x")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("x.best").alias("best"), (-F.col("x.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form, acyclic): the end of each word's chain, by doubling the step in each round."""
    now, _ = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new, _ = written(now.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")
        now = new.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """Words of docs (doc_id, text) with the more frequent spelling each leads to: word, form, root, n, n_near, form_n.

    Runs of A-Z, a-z and U+00C0 to U+00FF are taken as they are but for A-Z in lower case; where ODDS divides the CRC-32 of
    `<doc_id>:<run>`, a code point is deleted. Words are the distinct results of at least LEAST_CHARS code
    points and LEAST_N occurrences. Two are near at exactly one edit. A word's form is its near word of largest n (ties:
    smallest) if that has at least twice the word's n, else null. root is the end of the chain of forms, the word itself
    if it has none. A null text has no words; a null doc_id counts as the empty string. Repeated rows count each. Other columns
    are ignored.
    """
    words, _ = written(vocabulary(docs), "vocabulary")
    rows = words.join(near_words(words).hint("merge"), "word", "left").withColumn("is_form", F.coalesce(F.col("best_n") >= 2 * F.col("n"), F.lit(False)))
    rows = rows.select("word", F.when(F.col("is_form"), F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("is_form"), F.col("best_n")).alias("form_n"))
    rows, _ = written(rows, "forms")
    ends = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
