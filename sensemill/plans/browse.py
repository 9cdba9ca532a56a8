"""Filters, sorts, pages, facets and details over the driver's tables.

Orders stand for entries with an ordered level (o_orderpriority), parts for entries with headwords,
regions and nations for the category tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensemill.functions.score import ordinal
from sensemill.operators.filters import Evidence, at_least, page, prefixed, subtree
from sensemill.operators.requests import Children, detail
from sensemill.registry import query
from sensemill.tables import table

PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_SQL_PRIORITY = "['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW']"
TYPES = ["PROMO", "STANDARD", "MEDIUM", "LARGE"]  # ECONOMY and SMALL have no place and sort last


@query("filter_in_lists", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('O','P') AND o_orderpriority IN ('1-URGENT','5-LOW')")
def filter_in_lists(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return o.where(F.col("o_orderstatus").isin("O", "P") & F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))


@query("filter_ordinal_min", f"SELECT o_orderkey, o_orderpriority FROM orders WHERE list_position({_SQL_PRIORITY}, o_orderpriority) <= 2")
def filter_ordinal_min(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders", "o_orderkey", "o_orderpriority").where(at_least(F.col("o_orderpriority"), "2-HIGH+", PRIORITY))


@query(
    "filter_subtree",
    """WITH RECURSIVE tree(key, parent) AS (SELECT r_name, NULL::VARCHAR FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
       below(key) AS (SELECT key FROM tree WHERE key = 'ASIA' UNION SELECT t.key FROM below b JOIN tree t ON t.parent = b.key)
       SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT key FROM below)""",
)
def filter_subtree(spark: SparkSession, sf: str) -> DataFrame:
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    tree = r.select(F.col("r_name").alias("key"), F.lit(None).cast("string").alias("parent")).unionByName(
        n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("key"), F.col("r_name").alias("parent"))
    )
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey").join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(subtree(tree, "ASIA"), F.col("n_name") == F.col("key"), "left_semi").select("c_custkey", "n_name")


@query(
    "filter_rank_band",
    """WITH r AS (SELECT l_partkey, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_partkey)
       SELECT p_partkey, p_name, rank FROM part JOIN r ON p_partkey = l_partkey WHERE rank <= greatest(100, 200)""",
)
def filter_rank_band(spark: SparkSession, sf: str) -> DataFrame:
    """Bands add up: the widest of them counts. The rank is a top-k, so no full order is made."""
    sold = table(spark, sf, "lineitem", "l_partkey", "l_quantity").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    top = sold.orderBy(F.desc("q"), "l_partkey").limit(max(100, 200))
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("q"), "l_partkey")).cast("long"))
    return table(spark, sf, "part", "p_partkey", "p_name").join(top, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name", "rank")


_AVAILABLE = {
    "missing": "NOT EXISTS (SELECT 1 FROM e WHERE e.c = c_custkey)",
    "multiple": "(SELECT count(*) FROM e WHERE e.c = c_custkey) > 1",
    "reliable": "EXISTS (SELECT 1 FROM e WHERE e.c = c_custkey AND conf >= 0.5)",
    "uncertain": "EXISTS (SELECT 1 FROM e WHERE e.c = c_custkey) AND NOT EXISTS (SELECT 1 FROM e WHERE e.c = c_custkey AND conf >= 0.5)",
}


def _available(name: str):
    sql = f"WITH e AS (SELECT o_custkey AS c, CASE WHEN o_orderpriority <= '2-HIGH' THEN 1.0 ELSE 0.35 END AS conf FROM orders) SELECT c_custkey, c_name FROM customer WHERE {_AVAILABLE[name]}"

    @query(f"filter_availability_{name}", sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        conf = F.when(at_least(F.col("o_orderpriority"), "2-HIGH", PRIORITY), 1.0).otherwise(0.35)
        rows = table(spark, sf, "orders", "o_custkey", "o_orderpriority").select(F.col("o_custkey").alias("c_custkey"), conf.alias("confidence"))
        return Evidence("c_custkey", rows).select(table(spark, sf, "customer", "c_custkey", "c_name"), name)


for _name in _AVAILABLE:
    _available(_name)


def _viewpoint(name: str, how: str, negate: str):
    @query(name, f"SELECT p_partkey, p_name FROM part WHERE p_partkey {negate} IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 7)")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        own = table(spark, sf, "lineitem", "l_partkey", "l_suppkey").where("l_suppkey = 7").select(F.col("l_partkey").alias("p_partkey"))
        return table(spark, sf, "part", "p_partkey", "p_name").join(own, "p_partkey", how)


_viewpoint("viewpoint_not_assigned", "left_anti", "NOT")
_viewpoint("viewpoint_assigned", "left_semi", "")


@query("prefix_or_form", "SELECT p_partkey, p_name, p_brand FROM part WHERE starts_with(p_name, 'red') OR starts_with(p_brand, 'red') OR starts_with(lower(p_brand), 'brand#1')")
def prefix_or_form(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_brand")
    forms = p.select("p_partkey", F.lower("p_brand").alias("form"))
    return prefixed(p, "p_partkey", "p_name", forms, "form", "red").unionByName(prefixed(p, "p_partkey", "p_name", forms, "form", "brand#1")).distinct()


def _sorted(name: str, sql_order: str, build):
    """The first 100 of an order, with their places."""

    @query(f"sort_{name}", f"SELECT * FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY {sql_order}, p_name, p_partkey) AS place FROM {_BASE}) WHERE place <= 100")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df, first = build(spark, sf)
        order = (first, F.col("p_name"), F.col("p_partkey"))
        top = page(df, *order, limit=100)
        return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("p_partkey", "p_name", "place")


_BASE = """(SELECT part.*, m.brand, m.first, s.rank, a.state FROM part
    LEFT JOIN (SELECT p_name AS n, min(p_brand) AS brand, first(p_brand ORDER BY p_size, p_partkey) AS first FROM part WHERE p_size > 45 GROUP BY p_name) m ON n = p_name
    LEFT JOIN (SELECT l_partkey AS k, min(l_linenumber) AS rank FROM lineitem WHERE l_quantity > 45 GROUP BY 1) s ON k = p_partkey
    LEFT JOIN (SELECT l_partkey AS ak, min(l_returnflag) AS state FROM lineitem WHERE l_suppkey = 7 GROUP BY 1) a ON ak = p_partkey)"""


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_size", "p_retailprice")


def _with_brand(spark: SparkSession, sf: str) -> DataFrame:
    """brand: the least of a headword's brands (a topic's key); first: that which stands first by position (a translation)."""
    large = table(spark, sf, "part", "p_name", "p_brand", "p_size", "p_partkey").where("p_size > 45")
    per = large.groupBy("p_name").agg(F.min("p_brand").alias("brand"), F.min_by("p_brand", F.struct("p_size", "p_partkey")).alias("first"))
    return _parts(spark, sf).join(per, "p_name", "left")


def _with_lines(spark: SparkSession, sf: str, where: str, column: str, name: str) -> DataFrame:
    best = table(spark, sf, "lineitem").where(where).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min(column).alias(name))
    return _parts(spark, sf).join(best, "p_partkey", "left")


_sorted("headword", "p_name", lambda s, d: (_parts(s, d), F.col("p_name").asc_nulls_last()))
_sorted("polish", "first NULLS LAST", lambda s, d: (_with_brand(s, d), F.col("first").asc_nulls_last()))
_sorted("cefr", "list_position(['PROMO','STANDARD','MEDIUM','LARGE'], p_type) NULLS LAST", lambda s, d: (_parts(s, d), ordinal(F.col("p_type"), TYPES).asc_nulls_last()))
_sorted("topic", "brand NULLS LAST", lambda s, d: (_with_brand(s, d), F.col("brand").asc_nulls_last()))
_sorted("pos", "p_type NULLS LAST", lambda s, d: (_parts(s, d), F.col("p_type").asc_nulls_last()))
_sorted("priority", "p_retailprice DESC NULLS LAST", lambda s, d: (_parts(s, d), F.col("p_retailprice").desc_nulls_last()))
_sorted("frequency", "rank NULLS LAST", lambda s, d: (_with_lines(s, d, "l_quantity > 45", "l_linenumber", "rank"), F.col("rank").asc_nulls_last()))
_sorted(
    "status", "list_position(['R','A','N'], state) NULLS LAST",
    lambda s, d: (_with_lines(s, d, "l_suppkey = 7", "l_returnflag", "state"), ordinal(F.col("state"), ["R", "A", "N"]).asc_nulls_last()),
)


@query(
    "page_with_total",
    f"""WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'O' AND list_position({_SQL_PRIORITY}, o_orderpriority) <= 3)
        SELECT o_orderkey, o_orderpriority, o_totalprice, (SELECT count(*) FROM f) AS total FROM f
        ORDER BY list_position({_SQL_PRIORITY}, o_orderpriority) NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40""",
)
def page_with_total(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a filtered, ordinally sorted listing, with the exact number of all matches."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    o = o.where((F.col("o_orderstatus") == "O") & at_least(F.col("o_orderpriority"), "3-MEDIUM", PRIORITY)).drop("o_orderstatus")
    top = page(o, ordinal(F.col("o_orderpriority"), PRIORITY).asc_nulls_last(), F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey"), offset=40, limit=20)
    total = o.agg(F.count(F.lit(1)).alias("total"))
    return top.join(F.broadcast(total), F.lit(True)).select("o_orderkey", "o_orderpriority", "o_totalprice", "total")  # one row


@query(
    "facets",
    """SELECT * FROM (SELECT DISTINCT 'segment' AS facet, c_mktsegment AS value FROM customer UNION ALL SELECT DISTINCT 'priority', o_orderpriority FROM orders
       UNION ALL SELECT DISTINCT 'status', o_orderstatus FROM orders UNION ALL SELECT DISTINCT 'type', p_type FROM part)""",
)
def facets(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, source, column in (("segment", "customer", "c_mktsegment"), ("priority", "orders", "o_orderpriority"), ("status", "orders", "o_orderstatus"), ("type", "part", "p_type")):
        one = table(spark, sf, source, column).distinct().select(F.lit(name).alias("facet"), F.col(column).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "detail_nested",
    """SELECT c_custkey, c_name,
         (SELECT coalesce(string_agg(o_orderkey || ':' || o_orderpriority, ',' ORDER BY o_orderdate, o_orderkey), '') FROM orders WHERE o_custkey = c_custkey) AS orders,
         (SELECT coalesce(string_agg(l_partkey || 'x' || CAST(l_quantity AS BIGINT), ',' ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity), '') FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS lines
       FROM customer""",
)
def detail_nested(spark: SparkSession, sf: str) -> DataFrame:
    """One row per entity with its ordered child lists."""

    def listed(df: DataFrame, name: str, value, *order: str) -> DataFrame:
        packed = F.array_sort(F.collect_list(F.struct(*order, value.alias("value"))))
        return df.groupBy("c_custkey").agg(F.array_join(F.transform(packed, lambda s: s["value"]), ",").alias(name))

    c = table(spark, sf, "customer", "c_custkey", "c_name")
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").join(c.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(o.select("o_orderkey", "c_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = c.join(listed(o, "orders", F.concat_ws(":", "o_orderkey", "o_orderpriority"), "o_orderdate", "o_orderkey"), "c_custkey", "left")
    out = out.join(listed(lines, "lines", F.concat_ws("x", "l_partkey", F.col("l_quantity").cast("long")), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "c_custkey", "left")
    return out.select("c_custkey", "c_name", F.coalesce("orders", F.lit("")).alias("orders"), F.coalesce("lines", F.lit("")).alias("lines"))


_LISTS = {  # name: value, rows, order
    "forms": ("o_orderpriority", "(SELECT DISTINCT o_custkey, o_orderpriority FROM orders)", "o_orderpriority"),
    "definitions": ("o_orderkey", "orders WHERE o_orderstatus = 'F'", "o_orderdate, o_orderkey"),
    "translations": ("o_orderkey || ':' || o_orderpriority", "orders WHERE o_orderstatus = 'O'", "o_orderpriority, o_orderkey"),
    "examples": ("o_orderkey", "orders WHERE o_orderstatus = 'P'", "o_orderdate, o_orderkey"),
    "frequency": (
        "s_name || ':' || coalesce(rank::VARCHAR, '')",
        "(SELECT o_custkey, o_orderkey, s_name, CASE WHEN l_linenumber < 4 THEN l_linenumber END AS rank FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey)",
        "rank NULLS LAST, o_orderkey, s_name",
    ),
    "priorities": ("o_orderstatus || ':' || n", "(SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)", "o_orderstatus"),
}


@query(
    "sense_detail",
    "WITH "
    + ", ".join(f"{name}_ AS (SELECT o_custkey, string_agg({value}, ',' ORDER BY {order}) AS v FROM {rows} GROUP BY 1)" for name, (value, rows, order) in _LISTS.items())
    + f"""SELECT c_custkey, c_name, {', '.join(f"coalesce({name}_.v, '') AS {name}" for name in _LISTS)}, coalesce(n_name || ':' || r_name, '') AS categories
       FROM customer {' '.join(f'LEFT JOIN {name}_ ON {name}_.o_custkey = c_custkey' for name in _LISTS)}
       LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 0""",
)
def sense_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Customers stand for senses, active with a balance; orders, lines and their suppliers, nation and region for the seven lists."""
    c = table(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal", "c_nationkey").withColumn("active", F.col("c_acctbal") > 0)
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber")
    evidence = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf, "supplier", "s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    rank = F.when(F.col("l_linenumber") < 4, F.col("l_linenumber"))
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    classes = c.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    key, number = F.col("o_custkey"), F.col("o_orderkey").cast("string")
    lists = {
        "forms": Children(o.select("o_custkey", "o_orderpriority").distinct(), key, ["o_orderpriority"], F.col("o_orderpriority")),
        "definitions": Children(o.where("o_orderstatus = 'F'"), key, ["o_orderdate", "o_orderkey"], number),
        "translations": Children(o.where("o_orderstatus = 'O'"), key, ["o_orderpriority", "o_orderkey"], F.concat_ws(":", "o_orderkey", "o_orderpriority")),
        "examples": Children(o.where("o_orderstatus = 'P'"), key, ["o_orderdate", "o_orderkey"], number),
        "categories": Children(classes, F.col("c_custkey"), ["n_regionkey", "n_name"], F.concat_ws(":", "n_name", "r_name")),
        "frequency": Children(evidence, key, [rank, "o_orderkey", "s_name"], F.concat("s_name", F.lit(":"), F.coalesce(rank.cast("string"), F.lit("")))),
        "priorities": Children(o.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")), key, ["o_orderstatus"], F.concat_ws(":", "o_orderstatus", "n")),
    }
    out = detail(c, "c_custkey", F.col("active"), lists)
    return out.select("c_custkey", "c_name", *[F.array_join(name, ",").alias(name) for name in lists])


@query(
    "diversify_tiers",
    """SELECT p_partkey, p_name, tier, row_number() OVER (ORDER BY tier, place) AS new_place FROM (
         SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY place) - 1 AS tier FROM (
           SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 200)""",
)
def diversify_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """The first 200 by score; second and later hits of a headword go behind all first ones."""
    order = (F.desc("p_retailprice"), F.col("p_partkey"))
    top = table(spark, sf, "part", "p_partkey", "p_name", "p_retailprice").orderBy(*order).limit(200)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    top = top.withColumn("tier", (F.row_number().over(Window.partitionBy(F.lower("p_name")).orderBy("place")) - 1).cast("long"))
    return top.select("p_partkey", "p_name", "tier", F.row_number().over(Window.orderBy("tier", "place")).cast("long").alias("new_place"))
