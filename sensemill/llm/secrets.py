"""Secret scans with corpus-wide ownership, in DataFrame operations only.

Patterns give candidate spans. Positions come from the pieces of text between the matches, whose
lengths add up. Over the whole corpus the hash of each candidate value is counted by distinct
owners and distinct repositories: a value that several owners or many repositories hold is a copied
example, a value of one owner and few repositories looks live. Spans of known credential kinds always
stay; opaque strings, which only their ownership makes suspicious, are added where they are no examples
and few owners hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Kinds in order, their pattern, the group that holds the value, and its least length.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"(AKIA[A-Z0-9]{12,})", 1, 16),
    ("hex", r"([0-9a-f]{32,})", 1, 32),
    ("provider", r"(gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})", 1, 1),
    ("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1),
    ("opaque", r"([A-Za-z0-9+/_=-]{32,})", 1, 32),
]
BASE = ("assign", "access", "hex")
#: From EXAMPLE owners or WIDELY repositories on a value is a copied example. Another opaque value is added if at
#: most FEW_OWNERS hold it.
FEW_OWNERS, EXAMPLE, WIDELY = 2, 3, 10

#: Spans are gathered in chunks, as adding to an array copies it: a text with n matches costs n * _CHUNK + (n / _CHUNK)**2.
_CHUNK = 64
_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _spans(text: Column, no: int) -> Column:
    """All spans of one kind: leftmost matches that don't overlap, less those whose value is too short."""
    kind, pattern, group, least = KINDS[no]
    found = F.struct(
        F.split(text, pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def placed(f: Column) -> Column:
        none = F.array().cast(_SPAN)

        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.length(F.get(f["between"], i))
            end = begin + F.length(F.get(f["match"], i))
            span = F.struct(F.lit(no).alias("kind"), begin.alias("start"), end.alias("end"), F.get(f["value"], i).alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        def chunk(acc: Column, c: Column) -> Column:
            some = F.sequence(c * _CHUNK, F.least(c * _CHUNK + (_CHUNK - 1), F.size(f["match"]) - 1))
            begin = F.struct(acc["at"].alias("at"), none.alias("out"))
            return F.aggregate(some, begin, step, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        chunks = F.sequence(F.lit(0), ((F.size(f["match"]) - 1) / _CHUNK).cast("int"))
        return F.aggregate(chunks, start, chunk, lambda acc: F.flatten(acc["out"]))

    spans = F.get(F.transform(F.array(found), placed), F.lit(0))
    spans = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    if kind == "opaque":
        spans = F.filter(spans, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _candidates(docs: DataFrame, owner: str, repository: str, keep: str) -> DataFrame:
    """Each row of docs with a number of its own and all candidate spans, written: keep ("doc_id", or "row" for all
    columns in one struct), owner, repository, no, spans."""
    whole = F.struct(*[docs[c] for c in docs.columns]) if keep == "row" else docs[keep]
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*[_spans(text, no) for no, k in enumerate(KINDS) if k[0] in BASE])
    more = F.concat(*[_spans(text, no) for no, k in enumerate(KINDS) if k[0] not in BASE])
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    hashed = F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    rows, _ = written(
        docs.select(whole.alias(keep), docs["text"].cast("string").alias("text"), docs[owner].alias("owner"), docs[repository].alias("repository"))
        .select(keep, "owner", "repository", base.alias("base"), more.alias("more"))
        .withColumn("more", apart)
        .select(keep, "owner", "repository", F.monotonically_increasing_id().alias("no"), F.array_sort(hashed).alias("spans")),
        "candidates",
    )
    return rows


def _judged(rows: DataFrame) -> DataFrame:
    """Of the written candidates: no and each span that stays (start, kind, end), with live and example."""
    each = rows.where(F.size("spans") > 0).select("no", "owner", "repository", F.inline("spans"))
    owners = (
        each.select("hash", "owner", "repository").distinct()
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    )
    known = F.col("kind") < [k[0] for k in KINDS].index("opaque")
    example = (F.col("owners") >= EXAMPLE) | (F.col("repositories") >= WIDELY)
    return (
        each.select("no", "hash", "start", "kind", "end").join(owners, "hash")
        .withColumn("example", example).withColumn("live", ~F.col("example") & (F.col("owners") == 1))
        .where(known | (~F.col("example") & (F.col("owners") <= FEW_OWNERS)))
        .select("no", "start", "kind", "end", "live", "example")
    )


def find_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Secrets in docs (doc_id, text and the owner and repository columns): a row for each row of docs with

    doc_id, n_assign, n_access, n_hex, base_sha256 (of the spans of these three kinds), spans (all
    spans, kind:start:end in code points, by start and then kind), n_live (spans whose value one owner
    holds, in fewer than WIDELY repositories), n_example (spans whose value EXAMPLE owners or WIDELY
    repositories hold).

    A null text counts as empty. A null owner is one owner, a null repository one repository. Rows
    that repeat a doc_id are judged each by its own text. No span gives an empty text and its hash.
    """
    rows = _candidates(docs, owner, repository, "doc_id")
    judged = _judged(rows).groupBy("no").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"), F.count_if("live").alias("n_live"), F.count_if("example").alias("n_example")
    )
    spans = F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    basic = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def n(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{BASE[kind]}")

    return (
        rows.select("doc_id", "no").join(judged, "no", "left")
        .select("doc_id", spans.alias("spans"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))
        .select("doc_id", n(0), n(1), n(2), F.sha2(_text_of(basic), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"), "n_live", "n_example")
    )


def without_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """docs with each secret in text replaced by <kind>; spans that overlap give way to one mark, that
    of the first. Other rows and columns stay as they are, whatever their names.

    A text is taken apart in about sqrt(n) stretches for n marks, since a substring is counted off from its string's start.
    """
    found = _candidates(docs, owner, repository, "row")
    order = Window.partitionBy("no").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    marks = (
        _judged(found).withColumn("at", F.coalesce(F.max("end").over(order), F.lit(0))).withColumn("covered", F.col("start") < F.col("at"))
        .groupBy("no").agg(F.array_sort(F.collect_list(F.when(~F.col("covered"), F.struct("start", "at", "kind")))).alias("marks"), F.max("end").alias("to"))
    )
    names = F.array(*[F.lit(f"<{k[0]}>") for k in KINDS])

    def rebuilt(x: Column) -> Column:
        text, marks = x["text"], x["marks"]
        stretch = F.ceil(F.sqrt(F.size(marks))).cast("int")

        def of_stretch(k: Column) -> Column:
            own = F.slice(marks, k * stretch + 1, stretch)
            begin = F.get(own, F.lit(0))["at"]
            part = F.substring(text, begin + 1, F.element_at(own, -1)["start"] - begin)
            return F.get(F.transform(F.array(part), lambda p: F.array_join(F.transform(own, lambda m: F.concat(F.substring(p, m["at"] - begin + 1, m["start"] - m["at"]), F.get(names, m["kind"]))), "")), F.lit(0))

        last = F.floor((F.size(marks) - 1) / stretch).cast("int")
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), last), of_stretch), ""), F.substring(text, x["to"] + 1, F.length(text)))

    text = F.col("row.text").cast("string")
    both = F.struct(text.alias("text"), F.col("marks"), F.col("to"))
    clean = F.when(F.col("marks").isNull(), F.col("row.text")).otherwise(F.get(F.transform(F.array(both), rebuilt), F.lit(0)))
    plain = found.where(F.size("spans") == 0).select("row.*")
    marked = found.where(F.size("spans") > 0).join(marks, "no", "left").withColumn("row", F.col("row").withField("text", clean))
    return plain.unionByName(marked.select("row.*"))
