"""A browse, a search, an export: how filters, channels, sorts and pages are put together."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensemill.operators import search as channels
from sensemill.operators.composer import Filters, Tables, normalised
from sensemill.operators.filters import page

#: Candidates that a channel of a search gives, and rows that an export holds.
CANDIDATES, MOST_EXPORTED = 200, 50_000


def with_total(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows, each with the exact number of rows of `of`."""
    return rows.join(F.broadcast(of.agg(F.count(F.lit(1)).alias("total"))), F.lit(True))  # one row


def browse(t: Tables, filters: Filters, sorts: dict[str, Column], sort: str = "headword", offset: int = 0, limit: int = 50, as_of: Column | None = None) -> DataFrame:
    """One page of the senses that pass all filters, in the order of the request, with their exact total.

    Every filter stands before the sort; ties go by headword and key.
    """
    _, sort, limit, offset = normalised("lexical", sort, "", limit, offset, filters.student)
    kept = filters.apply(t, as_of)
    return with_total(page(kept, sorts[sort], F.col("headword"), F.col("sense_id"), offset=offset, limit=limit), kept)


def exported(t: Tables, filters: Filters) -> DataFrame:
    """The senses of an export. Filters about a student are refused; the availability of translations is not passed on."""
    if filters._about_student() or filters.student is not None:
        raise ValueError("an export knows no student")
    return Filters(**{**vars(filters), "availability": None}).apply(t)


def scoped(rows: DataFrame, tenant: str, value, status: str = "status") -> DataFrame:
    """Rows of one tenant that are not deleted; every read of a tenant's table begins here."""
    return rows.where((F.col(tenant) == value) & (F.col(status) != "DELETED"))


@dataclass(frozen=True)
class Children:
    """A list of a detail: its rows, whose key names the root, their order (nulls last) and what is shown of each."""

    rows: DataFrame
    key: Column
    order: list[Column | str]
    shown: Column


def detail(roots: DataFrame, key: str, active: Column, children: dict[str, Children]) -> DataFrame:
    """Active roots, each with every child list as an array in its own order, empty without rows.

    Child rows of all lists meet their roots in one shuffle by the key, whatever the number of lists. A list is one
    value of its root's row. Rows that nothing is to be shown of (null) show as null.
    """

    def packed(name: str, c: Children) -> DataFrame:
        order = [x for o in c.order for x in (F.isnull(o), F.col(o) if isinstance(o, str) else o)]
        fields = [x.alias(f"o{i}") for i, x in enumerate(order)]
        return c.rows.select(c.key.alias("of"), F.struct(*fields, c.shown.alias("shown")).alias(name)).where("of is not null")

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [packed(name, c) for name, c in children.items()])
    lists = rows.groupBy("of").agg(*[F.transform(F.array_sort(F.collect_list(name)), lambda s: s["shown"]).alias(name) for name in children])
    names = [F.coalesce(lists[name], F.array()).alias(name) for name in children]
    kept = roots.where(active)
    return kept.join(lists, kept[key] == lists["of"], "left").select(*[kept[c] for c in kept.columns if c not in children], *names)


def disjunction(entities: DataFrame, key: str, found: DataFrame, prefix: Column) -> DataFrame:
    """Entities that an index found (key, score), by a field of their own or a row of a child table, or that the prefix takes;
    with their score, 0 for the prefix alone."""
    hits = found.select(F.col("key").alias("of"), F.col("score").alias("lexical"))
    return entities.join(hits, entities[key] == hits["of"], "left").where(prefix | F.col("of").isNotNull()).withColumn("lexical", F.coalesce("lexical", F.lit(0.0))).drop("of")


def search(entities: DataFrame, key: str, name: str, found: dict[str, tuple[DataFrame, list[Column]]], prefix: Column, meta: Column, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of a fused search. found: by channel (lex, sem, top; those left out are empty) its matches and their order.

    Each channel gives its first CANDIDATES, these are merged, scored, sorted by score, name and key, later hits
    of a name put behind all first ones, and cut to the page; total is the largest number of matches of a channel.
    """
    ranked = [channels.ranked(rows, key, channel, *order, most=CANDIDATES) for channel, (rows, order) in found.items()]
    merged = channels.merged(key, *ranked)
    for channel in ("lex", "sem", "top"):
        if channel not in found:
            merged = merged.withColumn(channel, F.lit(None).cast("long"))
    scored = channels.fused(merged.join(entities, key), "lex", "sem", "top", prefix, meta)
    # at most CANDIDATES rows for each channel meet in these windows
    placed = scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), F.lower(name), F.col(key))))
    tiered = placed.withColumn("tier", F.row_number().over(Window.partitionBy(F.lower(name)).orderBy("place")))
    totals = reduce(lambda a, b: a.unionByName(b), [rows.agg(F.count(F.lit(1)).alias("n")) for rows, _ in found.values()])
    total = totals.agg(F.max("n").alias("total"))
    return page(tiered, F.col("tier"), F.col("place"), offset=offset, limit=limit).join(F.broadcast(total), F.lit(True))  # one row


@dataclass
class _Word:
    words: list[str]
    negated: bool


@dataclass(frozen=True)
class QueryText:
    """A query string taken apart: alternatives of words and phrases that must, or must not, occur."""

    either: list[list[_Word]]

    def condition(self, has: Callable[[list[str]], Column]) -> Column:
        """A predicate made of has(words), which says whether the words stand in a row. Without a word it is false."""

        def one(w: _Word) -> Column:
            return ~has(w.words) if w.negated else has(w.words)

        every = [reduce(lambda a, b: a & b, map(one, group)) for group in self.either]
        return reduce(lambda a, b: a | b, every, F.lit(False))

    def __call__(self, tokens: Column) -> Column:
        """The predicate on an array of tokens."""

        def has(words: list[str]) -> Column:
            hit = F.array_contains(tokens, words[0])
            return hit & F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(f" {' '.join(words)} ")) if len(words) > 1 else hit

        return self.condition(has)

    def rank(self) -> list[str]:
        """Words that may occur in a match."""
        return list(dict.fromkeys(x for group in self.either for w in group if not w.negated for x in w.words))

    def terms(self) -> list[str]:
        if any(all(w.negated for w in group) for group in self.either):
            raise ValueError("an index answers no alternative without a word that must occur")
        return list(dict.fromkeys(x for group in self.either for w in group for x in w.words))


def query_text(text: str) -> QueryText:
    """A query string: words all occur, "…" stand in a row, -x does not occur, and OR parts alternatives. Empty strings match nothing."""
    either: list[list[_Word]] = [[]]
    for sign, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word == "OR" and not sign:
            either.append([])
        elif parts := re.findall(r"[^\W_]+", (phrase or word).lower()):
            either[-1].append(_Word(parts, bool(sign)))
    return QueryText([group for group in either if group])
