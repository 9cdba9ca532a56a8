"""Composable filters. Row predicates are Columns; memberships are semi and anti joins, which all
stand before any sort or limit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensemill.functions.score import ordinal
from sensemill.tables import delete, staged


def at_least(c: Column, level: str, order: list[str]) -> Column:
    """order runs from the highest level down; accepts "HIGH" and "HIGH+". A null or unknown value never matches."""
    level = level.removesuffix("+")
    if level not in order:
        raise ValueError(f"unknown level: {level}")
    return F.coalesce(ordinal(c, order) <= order.index(level) + 1, F.lit(False))


@dataclass
class Evidence:
    """Counts of an entity's rows in a child table, and how many of them are reliable."""

    key: str
    rows: DataFrame  # key, confidence

    def counted(self, reliable_from: float = 0.5) -> DataFrame:
        return self.rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= reliable_from).alias("reliable"))

    def select(self, entities: DataFrame, availability: str) -> DataFrame:
        """missing: no rows; multiple: more than one; reliable: one with confidence 0.5 or more; uncertain: some, none reliable."""
        if availability == "missing":
            return entities.join(self.rows.select(self.key), self.key, "left_anti")
        conditions = {"multiple": "n > 1", "reliable": "reliable > 0", "uncertain": "reliable = 0"}
        if availability not in conditions:
            raise ValueError(f"unknown availability: {availability}")
        return entities.join(self.counted().where(conditions[availability]), self.key, "left_semi")


def prefixed(entities: DataFrame, key: str, headword: str, forms: DataFrame, form: str, prefix: str) -> DataFrame:
    """Entities whose headword or any form starts with the prefix, taken literally; all for an empty one."""
    if not prefix:
        return entities
    of_form = forms.where(F.startswith(F.col(form), F.lit(prefix))).select(key).distinct().withColumn("__form", F.lit(True))
    return entities.join(of_form, key, "left").where(F.startswith(F.col(headword), F.lit(prefix)) | F.col("__form").isNotNull()).drop("__form")


def subtree(nodes: DataFrame, root: str, key: str = "key", parent: str = "parent") -> DataFrame:
    """Keys of a node and of all below it, however deep, each once; cycles end by themselves.

    Round r takes in the nodes up to 2**r - 1 levels down, by links to the ancestor 2**(r - 1) levels up, so a deep
    tree takes few rounds; it ends when a round finds nothing new. Each round's tables are written and those before it
    deleted; only the keys found stay, in the session's folder.
    """
    spark = nodes.sparkSession
    links = nodes.select(F.col(key).alias("key"), F.col(parent).alias("above")).where("key is not null and above is not null")
    up, up_path = staged(links.distinct(), "links")
    found, path = staged(nodes.where(F.col(key) == root).select(F.col(key).alias("key")).distinct(), "subtree")
    n = found.count()
    while n:
        more, more_path = staged(up.join(found.withColumnRenamed("key", "above"), "above").select("key").unionByName(found).distinct(), "subtree")
        delete(spark, path)
        found, path = more, more_path
        before, n = n, found.count()
        if n == before:
            break
        higher = up.select(F.col("key").alias("above"), F.col("above").alias("higher"))
        far, far_path = staged(up.join(higher, "above").select("key", F.col("higher").alias("above")).distinct(), "links")
        delete(spark, up_path)
        up, up_path = far, far_path
    delete(spark, up_path)
    return found


def page(df: DataFrame, *order: Column, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of an order that ends in a key; 1 to 200 rows, as the bounds of a request are."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit)))
