"""Import of rows into senses: what each row is, and what a commit appends. Nothing held is changed or deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensemill.functions.text import blank_to_null
from sensemill.operators.build import appended

MASTER = ["pos", "cefr", "definition"]


def _same(a: str, b: str) -> Column:
    """Equal fields of two structs, where null and empty are the same."""
    empty = F.lit("")
    return F.forall(F.array(*[F.coalesce(f"{a}.{c}", empty) == F.coalesce(f"{b}.{c}", empty) for c in MASTER]), lambda x: x)


def classified(rows: DataFrame, senses: DataFrame) -> DataFrame:
    """Rows in the order of line, each with status and sense_key (null for errors): new founds the sense, existing_match is one
    of a sense with equal master fields, conflict one of a sense with others (it is skipped), error names a key that is not there.

    rows: line, sense_key (blank: none), derived_key, headword, pos, cefr, definition; senses: sense_key, pos, cefr, definition. A row
    goes by the key it names, else by its derived key. The first row of a derived key that nothing holds is new, and rows
    after it meet its fields as if it had been there. pos compares in lower case, cefr in upper case.
    """
    r = rows.withColumn("named", blank_to_null(F.col("sense_key"))).withColumn("key", F.coalesce("named", "derived_key"))
    r = r.withColumn("own", F.struct(F.lower("pos").alias("pos"), F.upper("cefr").alias("cefr"), "definition"))
    held = senses.groupBy(F.col("sense_key").alias("key")).agg(F.first(F.struct(*MASTER)).alias("held"))  # keys are unique
    found = r.where("named is null").groupBy("key").agg(F.min(F.struct("line", "own")).alias("founder"))
    j = r.join(held, "key", "left").join(found, "key", "left")
    before = F.col("founder.line") < F.col("line")
    status = (
        F.when(F.col("held").isNotNull(), F.when(_same("own", "held"), "existing_match").otherwise("conflict"))
        .when(F.coalesce(before, F.lit(False)), F.when(_same("own", "founder.own"), "existing_match").otherwise("conflict"))
        .when(F.col("named").isNull() & F.col("key").isNotNull(), "new").otherwise("error")
    )
    j = j.withColumn("status", status)
    return j.select("line", "status", F.when(F.col("status") != "error", F.col("key")).alias("sense_key"), "headword", F.col("own.pos").alias("pos"), F.col("own.cefr").alias("cefr"), "definition")


def inserted(marked: DataFrame) -> DataFrame:
    """The senses that classified rows found: sense_key, headword, pos, cefr and definition, with null for empty ones."""
    return marked.where("status = 'new'").select("sense_key", "headword", *[blank_to_null(F.col(c)).alias(c) for c in MASTER])


def children(marked: DataFrame, values: DataFrame, held: DataFrame) -> DataFrame:
    """Child rows that a commit appends: sense_key, value, norm and position after those the sense holds (from 0).

    values: line, place, value, norm of the rows' multi-values; held: sense_key, norm, position. A norm that the sense holds, a
    second one of a sense and empty or null ones are passed over; rows in conflict or error append nothing.
    """
    ok = marked.where("status in ('new', 'existing_match')").select("line", "sense_key")
    new = values.where("norm <> ''").join(ok, "line")
    first = new.groupBy("sense_key", "norm").agg(F.min(F.struct("line", "place", "value")).alias("x")).select("sense_key", "norm", "x.*")
    left = first.join(held.select("sense_key", "norm"), ["sense_key", "norm"], "left_anti")
    return appended(held.withColumnRenamed("sense_key", "of"), left.withColumnRenamed("sense_key", "of"), "of", "line", "place").select(F.col("of").alias("sense_key"), "value", "norm", "position")


def report(marked: DataFrame, added: DataFrame) -> DataFrame:
    """One row: senses inserted and met, rows skipped, children added."""
    counts = [F.count_if(F.col("status") == s).alias(n) for n, s in (("inserted_senses", "new"), ("existing_senses_touched", "existing_match"))]
    skipped = F.count_if(F.col("status").isin("conflict", "error")).alias("skipped_count")
    return marked.agg(*counts, skipped).crossJoin(added.agg(F.count(F.lit(1)).alias("children_added")))  # one row each
