"""MinHash near-duplicate detection with ProbMinHash signatures.

Each text's distinct shingles (runs of five words) carry equal weights, since links are decided by
plain sets. A shingle is a Poisson process whose rate is its weight: its arrivals fall on random
registers, and a register keeps the shingle that arrived first. A shingle stops once its next arrival comes later than every register's holder, so most shingles
of a long text are drawn once. Equal registers estimate the probability Jaccard similarity,
which for equal weights is the sets' Jaccard similarity.

Bands of registers meet in buckets. Every member of a bucket is compared with the bucket's
smallest member, and then with every member of another class whose registers agree often enough;
exact comparison of the shingle sets decides. Large buckets are dealt to blocks, and every block
meets every other. Equal texts meet by digest before that, so large groups of copies cost one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as K
from .common import map_arrow, written
from .graph import components

SHINGLE, REGISTERS, ROWS, SIMILAR = 5, 80, 4, 0.8
#: A task compares members of one bucket up to this load; a larger bucket is dealt to blocks of half of it, and
#: every pair of blocks is a task. A text's load is 1, and one more for each LOAD shingles.
BUCKET, LOAD = 2048, 512
#: Pairs whose registers agree less often than the wanted similarity less this margin (four standard deviations
#: of the estimate) aren't compared.
MARGIN = 0.2


def distinct(text: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle) pairs in order."""
    key = np.unique((text.astype(K.U) << K.U(32)) | shingle)
    return (key >> K.U(32)).astype(np.int64), key & K.U(0xFFFFFFFF)


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """ProbMinHash registers, texts x m; a text without shingles has zeros."""
    first = np.full(texts * m, np.inf)
    held = np.zeros(texts * m, K.U)
    state, t = K.mix(shingle + K.U(0x632BE59BD9B4E019)), np.zeros(len(text))
    while len(text):
        state = K.mix(state + K.U(K._BASE))
        t = t - np.log(((state >> K.U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        place = text * m + (K.mix(state ^ K.U(K._STEP)) % K.U(m)).astype(np.int64)
        np.minimum.at(first, place, t)
        won = t == first[place]
        held[place[won]] = shingle[won]
        on = t < first.reshape(texts, m).max(1)[text]
        text, shingle, weight, state, t = text[on], shingle[on], weight[on], state[on], t[on]
    return held.reshape(texts, m)


def sketcher(shingle: int, m: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in K.pieces(batch.column("text")):
                words = K.split(data, offsets)
                run, at = K.runs(words, shingle, short=True)
                texts = len(offsets) - 1
                text, s = distinct(words.text_of_word()[at], run >> K.U(32))
                held = signatures(text, s, np.ones(len(s)), texts, m)
                n = np.bincount(text, minlength=texts)
                ends = np.r_[0, np.cumsum(np.where(n > 0, 2 * m, 0))].astype(np.int32)
                registers = (held & K.U(0xFFFF)).astype("<u2")[n > 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.start, texts),
                        batch.column("digest").slice(part.start, texts),
                        pa.Array.from_buffers(pa.binary(), texts, [None, pa.py_buffer(ends), pa.py_buffer(registers.tobytes())]),
                        K.lists(s.astype(np.uint32).view(np.int32), np.r_[0, np.cumsum(n)], pa.int32()),
                    ],
                    ["doc_id", "digest", "registers", "shingles"],
                )

    return sketch


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Of (u, v), those whose shingle sets have at least that Jaccard similarity."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return (
        pairs.join(a, "u").join(b, "v")
        .withColumn("both", both)
        .where(F.col("both") >= similar * (F.size("a") + F.size("b") - F.col("both")))
        .select("u", "v").distinct()
    )


def _candidates(t: pa.Table, width: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the members of one or two blocks of a bucket: row numbers (i, j) of all pairs of different classes whose
    registers agree `least` times and that share no earlier bucket. i is in order.

    Side 0 meets side 1; members of a block that meets itself have side 2.
    """
    side, root = t.column("side").to_numpy(), t.column("root").to_numpy()
    r = np.frombuffer(b"".join(t.column("registers").to_pylist()), "<u2").reshape(len(side), -1)
    columns, no = np.ascontiguousarray(r.T), t.column("no")[0].as_py()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for a in range(0, len(left), 64):
        x = left[a : a + 64]
        agree = np.zeros((len(x), len(right)), np.int16)
        for c in columns:
            agree += c[x, None] == c[None, right]
        fits = (agree >= least) & (root[x, None] != root[None, right])
        if side[x[0]] == 2:
            fits &= x[:, None] < right[None, :]
        i, j = np.nonzero(fits)
        i, j = x[i], right[j]
        for band in range(no):
            at = slice(band * width, (band + 1) * width)
            new = (r[i, at] != r[j, at]).any(1)
            i, j = i[new], j[new]
        if len(i):
            yield i, j


def _touched(width: int, least: int):
    """Members that have a candidate."""

    def run(t: pa.Table) -> pa.Table:
        some = np.zeros(t.num_rows, bool)
        for i, j in _candidates(t, width, least):
            some[i] = some[j] = True
        return t.select(["g", "side", "no", "node", "root"]).filter(pa.array(some))

    return run


def _links(width: int, least: int, similar: float):
    """Links (u, v) of members whose shingle sets are similar, without those that earlier ones of the task imply."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node, sets = t.column("node").to_numpy(), t.column("shingles").combine_chunks()
        n = sets.value_lengths().to_numpy()
        first = np.r_[0, np.cumsum(n)]
        label = np.unique(t.column("root").to_numpy(), return_inverse=True)[1]
        names, shingle = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        mine, out = np.zeros(len(names), bool), []
        for i, j in _candidates(t, width, least):
            starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            for u, others in zip(i[starts], np.split(j, starts[1:])):
                others = others[label[others] != label[u]]
                if not len(others):
                    continue
                mine[shingle[first[u] : first[u + 1]]] = True
                size = n[others]
                begin = np.r_[0, np.cumsum(size)[:-1]]
                both = np.add.reduceat(mine[shingle[np.repeat(first[others] - begin, size) + np.arange(size.sum())]].astype(np.int64), begin)
                mine[shingle[first[u] : first[u + 1]]] = False
                for v in others[both >= similar * (n[u] + size - both)]:
                    if label[v] != label[u]:
                        out.append((node[u], node[v]))
                        label[label == label[v]] = label[u]
        u, v = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    return run


def _meetings(rows: DataFrame) -> DataFrame:
    """(g, side, no, node, root) of the members (key, no, node, root, load) of buckets that hold more than one class.

    Each group g is a bucket, or two blocks of it. Blocks are dealt by hash; a class of more than a block has
    blocks of its own, which do not meet each other.
    """
    half = F.lit(max(BUCKET // 2, 1))
    classes = rows.groupBy("key", "root").agg(F.sum("load").alias("load"))
    large = F.col("load") > half
    bucket = classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.sum("load").alias("all"), F.sum(F.when(~large, F.col("load"))).alias("rest")).where("classes > 1")
    split = F.col("all") > BUCKET
    dealt = classes.join(bucket, "key").select(
        "key", "root",
        F.when(split & large, F.col("root")).alias("own"),
        F.when(~split, 1).when(large, F.ceil(F.col("load") / half)).otherwise(F.ceil(F.col("rest") / half)).alias("parts"),
    )
    block = F.xxhash64("own", "part")
    blocks = dealt.select("key", "own", "parts").distinct().select("key", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("key", "own", block.alias("block"))
    a, b = (blocks.select("key", F.col("own").alias(f"own_{x}"), F.col("block").alias(x)) for x in "ab")
    sides = (
        a.join(b, "key").where("a < b and not (own_a <=> own_b and own_a is not null) or a = b and own_a is null")
        .withColumn("g", F.xxhash64("key", "a", "b"))
        .select("key", "g", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("block"), F.lit(2).alias("side")))).otherwise(
            F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b").alias("block"), F.lit(1).alias("side"))))).alias("s"))
        .select("key", "g", "s.block", "s.side")
    )
    placed = rows.join(dealt, ["key", "root"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    return placed.select("key", block.alias("block"), "no", "node", "root").join(sides, ["key", "block"]).select("g", "side", "no", "node", "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, registers: int = REGISTERS, rows: int = ROWS, similar: float = SIMILAR) -> DataFrame:
    """Classes of near duplicates: a row for every row of docs (doc_id, text) with

    doc_id, class_id (the smallest doc_id of its class), copy_of (the smallest doc_id with an equal text).

    Two texts link if the Jaccard similarity of their sets of `shingle`-word runs is at least
    `similar`; a text with fewer words is one run. Null texts and null doc_ids: the row is its own
    class (class_id and copy_of are its doc_id). Empty or blank texts link only
    with equal texts. Rows that repeat a doc_id count as one document. Other columns are ignored.
    """
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched, _ = written(
        map_arrow(
            rows_in.where("text is not null and doc_id is not null").withColumn("digest", F.md5("text")),
            sketcher(shingle, registers),
            "doc_id long, digest string, registers binary, shingles array<int>",
        ),
        "sketches",
    )
    member, _ = written(
        sketched.select("doc_id", "digest").distinct()
        .join(sketched.groupBy("digest").agg(F.min("doc_id").alias("node")), "digest"),
        "members",
    )
    # Rows that repeat an id with its text stand once from here on.
    again, _ = written(sketched.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "digest"), "repeated")
    once = sketched.join(again, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    sketched = sketched.join(again, ["doc_id", "digest"], "left_anti").select(*sketched.columns).unionByName(once)
    sets = sketched.where(F.size("shingles") > 0).select(F.col("doc_id").alias("node"), "shingles")
    first_copy = member.where("doc_id = node").select("doc_id", "digest")
    kept, _ = written(
        sketched.where(F.size("shingles") > 0).join(first_copy, ["doc_id", "digest"])
        .select(F.col("doc_id").alias("node"), "registers", (F.lit(1) + F.floor(F.size("shingles") / LOAD)).alias("load"))
        .dropDuplicates(["node", "registers"]),
        "nodes",
    )
    # Registers are two bytes each, and those of a band stand together.
    band = kept.select("node", "load", F.expr(f"inline(transform(sequence(0, {registers // rows - 1}), i -> struct(i as no, xxhash64(i, substring(registers, i * {2 * rows} + 1, {2 * rows})) as key)))"))
    bucket = band.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star, _ = written(
        band.join(bucket.select("key", "centre"), "key").where("node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct(), "stars"
    )
    found, _ = written(_verified(star, sets, similar), "links")
    same = member.where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    root = components(found)
    # Members of buckets with more than one class meet twice: by registers, then those with a candidate by their sets.
    members = band.join(root, "node", "left").select("key", "no", "node", F.coalesce("root", "node").alias("root"), "load")
    met, least = kept.select("node", "registers"), int((similar - MARGIN) * registers)
    some, _ = written(
        _meetings(members).join(met, "node").groupBy("g").applyInArrow(_touched(rows, least), "g long, side int, no int, node long, root long"), "some"
    )
    more, _ = written(
        some.join(met, "node").join(sets, "node").groupBy("g").applyInArrow(_links(rows, least, similar), "u long, v long"), "links"
    )
    root = components(root.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more).unionByName(same))
    of_doc = (
        member.groupBy("doc_id").agg(F.min("node").alias("node"))
        .join(root.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
        .select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.col("node").alias("copy_of"))
    )
    return rows_in.select("doc_id", F.col("text").isNull().alias("none")).join(of_doc, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("none"), F.col("doc_id")).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("none"), F.col("doc_id")).otherwise(F.coalesce("copy_of", "doc_id")).alias("copy_of"),
    )


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """docs without the near duplicates: of each class the document with the smallest doc_id stays, once.

    Rows with a null doc_id or a null text all stay. Columns may have any names.
    """
    gone = near_duplicates(docs, **parameters).where("class_id <> doc_id").select("doc_id").distinct()
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.md5(docs["text"].cast("string")).alias("digest")
    )
    once = Window.partitionBy("doc_id", "digest").orderBy(F.lit(0))
    left = rows.where("doc_id is not null").join(gone, "doc_id", "left_anti").withColumn("n", F.row_number().over(once)).where("n = 1 or digest is null")
    return left.select("row.*").unionByName(rows.where("doc_id is null").select("row.*"))
