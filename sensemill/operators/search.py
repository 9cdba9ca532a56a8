"""Search channels over token arrays and vectors, and their fusion.

A full-text request is four lists instead of a query string: words that all occur, words of which one
occurs, phrases, words that must not occur. Tokens are letters and digits in lower case, without
stemming or stop words.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensemill.functions import score as S


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


@dataclass
class Request:
    all_of: list[str] = field(default_factory=list)
    any_of: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    none_of: list[str] = field(default_factory=list)

    def loose(self) -> Request:
        """The same words, any of which will do."""
        return Request(any_of=[*self.all_of, *self.any_of], none_of=self.none_of)

    def matches(self, words: Column) -> Column:
        has = [F.array_contains(words, w) for w in self.all_of]
        if self.any_of:
            has.append(F.arrays_overlap(words, F.array(*[F.lit(w) for w in self.any_of])))
        text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        has += [F.contains(text, F.lit(f" {p} ")) for p in self.phrases]
        has += [~F.array_contains(words, w) for w in self.none_of]
        return reduce(lambda a, b: a & b, has, F.lit(True))

    def condition(self, has: Callable[[list[str]], Column]) -> Column:
        """The same predicate for an index: has(words) says whether they stand in a row."""
        if not self.words():
            raise ValueError("an index answers no request without a word that must occur")
        each = [has([w]) for w in self.all_of]
        if self.any_of:
            each.append(reduce(lambda a, b: a | b, [has([w]) for w in self.any_of]))
        each += [has(p.split()) for p in self.phrases] + [~has([w]) for w in self.none_of]
        return reduce(lambda a, b: a & b, each)

    def terms(self) -> list[str]:
        return list(dict.fromkeys([*self.words(), *self.none_of]))

    def words(self) -> list[str]:
        return [*self.all_of, *self.any_of, *(w for p in self.phrases for w in p.split())]


def matched(docs: DataFrame, request: Request, text: str = "text") -> DataFrame:
    """Exact matches; a request for several words that none matches falls back to any of them."""
    found = docs.where(request.matches(tokens(F.col(text))))
    if len(request.all_of) > 1 and found.isEmpty():
        return docs.where(request.loose().matches(tokens(F.col(text))))
    return found


def lexical_score(request: Request, fields: list[tuple[Column, float]]) -> Column:
    """Sum over fields and words of the field's weight times the word's count: more and heavier matches rank higher."""
    words = F.array(*[F.lit(w) for w in request.words()])
    return sum((F.lit(w) * F.size(F.filter(tokens(c), lambda t: F.array_contains(words, t))) for c, w in fields), F.lit(0.0))


def ranked(df: DataFrame, key: str, name: str, *order: Column, most: int) -> DataFrame:
    """(key, name): the first `most` rows of an order with ranks from 1. The limit is a top-k, so no task gets more than that."""
    top = df.orderBy(*order).limit(most)
    return top.select(key, F.row_number().over(Window.orderBy(*order)).cast("long").alias(name))


def merged(key: str, *channels: DataFrame) -> DataFrame:
    """Full outer merge of channels by one grouping; a channel without a row gives null."""
    names = [[c for c in d.columns if c != key][0] for d in channels]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), channels)
    return every.groupBy(key).agg(*[F.max(n).alias(n) for n in names])


def fused(df: DataFrame, lexical: str, semantic: str, topic: str, prefix: Column, meta: Column) -> DataFrame:
    return df.withColumn("score", F.round(S.hybrid_score(F.col(lexical), F.col(semantic), F.col(topic), prefix, meta), 10))
