"""The review queue: cards that are due or new, narrowed, in order, and the first card of every student."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensemill.functions.score import day_end

#: A request's limit is one of these.
LEAST, MOST = 1, 200


@dataclass
class Narrowing:
    """What a queue is narrowed to; all that is given holds together, an empty part narrows nothing."""

    cards: list = field(default_factory=list)  # card ids
    members: DataFrame | None = None  # sense_id of a set, already scoped to its owner
    states: list[str] = field(default_factory=list)  # learning states
    difficult: bool = False  # only cards with lapses
    search: str = ""  # part of the headword, in any case; % and _ stand for any text and any character


def due(cards: DataFrame, states: DataFrame, senses: DataFrame, as_of: Column, only: Narrowing | None = None) -> DataFrame:
    """Active cards of all students that are overdue (bucket 0), due before the day of as_of ends (1) or new (2, without a state).

    cards: student_id, card_id, sense_id, learning_state, is_active; states: card_id, due_at, repetitions, lapses; senses: sense_id,
    headword. A null is_active is not active; a state without due_at is not due; cards without a sense are left out. Gives
    student_id, card_id, sense_id, headword, learning_state, repetitions, lapses, due_at, bucket and is_overdue (null if new).
    Filters of cards and senses stand before the joins.
    """
    only = only or Narrowing()
    c = cards.where("is_active").select("student_id", "card_id", "sense_id", "learning_state")
    if only.cards:
        c = c.where(F.col("card_id").isin(only.cards))
    if only.states:
        c = c.where(F.col("learning_state").isin(only.states))
    if only.members is not None:
        c = c.join(only.members.select("sense_id"), "sense_id", "left_semi")
    words = senses.select("sense_id", "headword")
    if only.search:
        words = words.where(F.col("headword").ilike(f"%{only.search}%"))
    held = states.select("card_id", "due_at", "repetitions", "lapses", F.lit(True).alias("__held"))
    late = F.col("due_at") < as_of
    if only.difficult:
        c = c.join(held.where("lapses > 0"), "card_id")
    else:
        c = c.join(held, "card_id", "left")
    bucket = F.when(F.col("__held").isNull(), 2).when(late, 0).when(F.col("due_at") <= day_end(as_of), 1)
    c = c.withColumn("bucket", bucket).where("bucket is not null").join(words, "sense_id")
    return c.select("student_id", "card_id", "sense_id", "headword", "learning_state", "repetitions", "lapses", "due_at", "bucket", F.when(F.col("bucket") < 2, late).alias("is_overdue"))


def queue(rows: DataFrame, student: object, limit: int = 50) -> DataFrame:
    """A student's page of due(): by bucket, due_at, headword, card."""
    mine = rows.where(F.col("student_id") == student)
    return mine.orderBy("bucket", F.col("due_at").asc_nulls_last(), "headword", "card_id").limit(min(MOST, max(LEAST, limit)))


def next_up(rows: DataFrame) -> DataFrame:
    """The first card of each student's queue, for all students at once: one aggregate, combined before its shuffle. Only
    new cards have no due_at, so nulls never meet dates in a bucket."""
    order = ["bucket", "due_at", "headword", "card_id"]
    rest = [c for c in rows.columns if c not in [*order, "student_id"]]
    return rows.groupBy("student_id").agg(F.min(F.struct(*order, *rest)).alias("x")).select("student_id", "x.*").select(rows.columns)


def with_first(rows: DataFrame, children: DataFrame, value: str, name: str) -> DataFrame:
    """rows (a page: its sense_id) with the value of the first child by position, then value, of each sense; null without any."""
    mine = children.join(rows.select("sense_id").distinct(), "sense_id", "left_semi").where(F.col(value).isNotNull())
    first = mine.groupBy("sense_id").agg(F.min(F.struct("position", value)).alias("x")).select("sense_id", F.col(f"x.{value}").alias(name))
    return rows.join(first, "sense_id", "left")
