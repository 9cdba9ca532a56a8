"""All filters of a search request, composed with AND over the sense table and its child tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensemill.functions.score import BANDS, PRIORITIES
from sensemill.operators.filters import Evidence, at_least, prefixed, subtree

LEVEL_ORDER = [name for name, _ in PRIORITIES]


@dataclass
class Tables:
    """senses: sense_id, headword, pos, cefr, priority_level, is_active. The others have sense_id and what their filter needs."""

    senses: DataFrame
    categories: DataFrame | None = None  # sense_id, key
    category_tree: DataFrame | None = None  # key, parent
    frequency: DataFrame | None = None  # sense_id, rank
    flags: DataFrame | None = None  # sense_id, flag
    forms: DataFrame | None = None  # sense_id, form
    translations: DataFrame | None = None  # sense_id, confidence
    assignments: DataFrame | None = None  # sense_id, student_id, is_active, state, due_at, lapses
    overrides: DataFrame | None = None  # sense_id, student_id


@dataclass
class Filters:
    cefr: list[str] = field(default_factory=list)
    pos: list[str] = field(default_factory=list)
    priority: list[str] = field(default_factory=list)
    priority_at_least: str | None = None
    category: str | None = None
    bands: list[str] = field(default_factory=list)
    max_rank: int | None = None
    flags: list[str] = field(default_factory=list)
    availability: str | None = None
    prefix: str = ""
    student: int | None = None
    assigned: bool | None = None
    states: list[str] = field(default_factory=list)
    due: bool = False
    difficult: bool = False
    overridden: bool = False

    def row_predicate(self) -> Column:
        out = F.col("is_active")
        for name, column in (("cefr", "cefr"), ("pos", "pos"), ("priority", "priority_level")):
            if values := getattr(self, name):
                out &= F.col(column).isin(values)
        if self.priority_at_least:
            out &= at_least(F.col("priority_level"), self.priority_at_least, LEVEL_ORDER)
        return out

    def _about_student(self) -> bool:
        return self.assigned is not None or bool(self.states) or self.due or self.difficult or self.overridden

    def apply(self, t: Tables, as_of: Column | None = None) -> DataFrame:
        """The senses that pass; every membership is one semi or anti join on sense_id."""
        if self._about_student() and self.student is None:
            raise ValueError("a student is needed")
        out = t.senses.where(self.row_predicate())
        keep: list[DataFrame] = []
        if self.category:
            keep.append(t.categories.join(subtree(t.category_tree, self.category), "key", "left_semi"))
        if self.bands:  # bands add up: the widest counts, an unknown one has no words
            keep.append(t.frequency.where(F.col("rank") <= max(BANDS.get(b, 0) for b in self.bands)))
        if self.max_rank is not None:
            keep.append(t.frequency.where(F.col("rank") <= self.max_rank))
        if self.flags:
            keep.append(t.flags.where(F.col("flag").isin(self.flags)))
        if self._about_student():
            own = t.assignments.where(F.col("student_id") == self.student)
            if self.assigned is False:  # inactive rows count as assigned here
                out = out.join(own.select("sense_id"), "sense_id", "left_anti")
            wanted = F.lit(True)
            if self.assigned:
                wanted &= F.col("is_active")
            if self.states:
                wanted &= F.col("state").isin(self.states)
            if self.due:
                wanted &= F.col("due_at").isNotNull() & (F.col("due_at") <= as_of)
            if self.difficult:
                wanted &= F.col("lapses") > 0
            if self.assigned or self.states or self.due or self.difficult:
                keep.append(own.where(wanted))
            if self.overridden:
                keep.append(t.overrides.where(F.col("student_id") == self.student))
        for k in keep:
            out = out.join(k.select("sense_id"), "sense_id", "left_semi")
        if self.availability:
            out = Evidence("sense_id", t.translations).select(out, self.availability)
        return prefixed(out, "sense_id", "headword", t.forms, "form", self.prefix) if self.prefix else out


#: Sorts and modes of a request; anything else falls back to the first.
MODES, SORTS = ["hybrid", "lexical", "semantic"], ["relevance", "headword", "polish", "cefr", "topic", "pos", "student_status", "priority", "frequency"]


def normalised(mode: str, sort: str, text: str, limit: int, offset: int, student: int | None = None) -> tuple[str, str, int, int]:
    """(mode, sort, limit, offset) as they will be used: a sort other than relevance browses lexically, an empty text sorts
    by priority, a student's status needs a student."""
    mode, sort = mode if mode in MODES else MODES[0], sort if sort in SORTS else SORTS[0]
    if not text.strip() and sort == "relevance":
        sort = "priority"
    if sort == "student_status" and student is None:
        sort = "priority"
    if sort != "relevance":
        mode = "lexical"
    return mode, sort, min(200, max(1, limit)), max(0, offset)
