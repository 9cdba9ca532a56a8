"""Due queues, dashboards, bulk reports and the scheduler over the events table: user is student,
event type is rating, value the item, and the day after the last event is "now"."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensemill.functions import score as S
from sensemill.operators import imports as I
from sensemill.operators import learning as L
from sensemill.operators import queue as Q
from sensemill.registry import query
from sensemill.tables import table

AS_OF = "2024-02-12 12:00:00"
_DUE = "ts + to_days(CAST(1 + CAST(floor(value) AS INTEGER) % 20 AS INTEGER))"
_STATE = f"(SELECT user_id, event_type, max(ts) AS last, max({_DUE}) AS due_at, count(*) AS reps, count(*) FILTER (WHERE event_type = 'error') AS lapses FROM events GROUP BY user_id, event_type)"
_NOW = f"TIMESTAMP '{AS_OF}'"


def _state(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events", "user_id", "event_type", "ts", "value")
    due = F.expr("ts + make_dt_interval(cast(1 + cast(floor(value) as int) % 20 as int))")
    return e.groupBy("user_id", "event_type").agg(
        F.max("ts").alias("last"), F.max(due).alias("due_at"), F.count(F.lit(1)).alias("reps"), F.count_if(F.col("event_type") == "error").alias("lapses")
    )


def _now():
    return F.lit(AS_OF).cast("timestamp")


@query(
    "due_queue",
    f"""SELECT user_id, event_type, bucket, due_at FROM (SELECT *, CASE WHEN due_at < {_NOW} THEN 0 WHEN due_at <= date_trunc('day', {_NOW}) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND THEN 1 END AS bucket FROM {_STATE})
        WHERE bucket IS NOT NULL ORDER BY bucket, due_at NULLS LAST, event_type, user_id LIMIT 100""",
)
def due_queue(spark: SparkSession, sf: str) -> DataFrame:
    q = _state(spark, sf).withColumn("bucket", L.due_bucket(F.col("due_at"), _now())).where("bucket is not null")
    return q.orderBy("bucket", F.col("due_at").asc_nulls_last(), "event_type", "user_id").limit(100).select("user_id", "event_type", "bucket", "due_at")


@query(
    "dashboard_counts",
    f"SELECT count(*) AS cards, count(*) FILTER (WHERE due_at < {_NOW}) AS overdue, count(*) FILTER (WHERE lapses > 0) AS difficult, count(*) FILTER (WHERE reps = 1) AS encountered, sum(reps)::BIGINT AS reviews FROM {_STATE}",
)
def dashboard_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _state(spark, sf).agg(
        F.count(F.lit(1)).alias("cards"), F.count_if(F.col("due_at") < _now()).alias("overdue"), F.count_if(F.col("lapses") > 0).alias("difficult"),
        F.count_if(F.col("reps") == 1).alias("encountered"), F.sum("reps").alias("reviews"),
    )


@query(
    "dashboard_overview",
    f"""SELECT c_custkey, c_name, count(s.user_id) AS cards, count(*) FILTER (WHERE s.due_at < {_NOW}) AS overdue FROM customer LEFT JOIN {_STATE} s ON user_id = c_custkey GROUP BY ALL""",
)
def dashboard_overview(spark: SparkSession, sf: str) -> DataFrame:
    """A row for every student, those without cards too."""
    s = _state(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("cards"), F.count_if(F.col("due_at") < _now()).alias("overdue"))
    c = table(spark, sf, "customer", "c_custkey", "c_name").join(s, F.col("user_id") == F.col("c_custkey"), "left")
    return c.select("c_custkey", "c_name", F.coalesce("cards", F.lit(0)).cast("long").alias("cards"), F.coalesce("overdue", F.lit(0)).cast("long").alias("overdue"))


@query(
    "difficult_top5",
    f"""SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events WHERE ts >= {_NOW} - INTERVAL 30 DAY AND ts <= {_NOW}
        GROUP BY user_id HAVING errors > 0 ORDER BY errors DESC, n DESC, user_id LIMIT 5""",
)
def difficult_top5(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events", "user_id", "event_type", "ts").where((F.col("ts") >= _now() - F.expr("interval 30 days")) & (F.col("ts") <= _now()))
    g = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).where("errors > 0")
    return g.orderBy(F.desc("errors"), F.desc("n"), "user_id").limit(5)


@query("recent_reviews", "SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 10")
def recent_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events", "event_id", "user_id", "ts").orderBy(F.desc("ts"), "event_id").limit(10)


@query(
    "assign_report",
    """WITH r AS (SELECT l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 0 END AS id FROM lineitem WHERE l_suppkey = 7), d AS (SELECT DISTINCT id FROM r),
        h AS (SELECT l_partkey AS id, max(l_returnflag) <> 'A' AS active FROM lineitem WHERE l_suppkey = 8 GROUP BY 1)
        SELECT CASE WHEN p_partkey IS NULL THEN 'not_found' WHEN active IS NULL THEN 'new' WHEN active THEN 'already' ELSE 'reactivated' END AS status, count(*) AS n
        FROM d LEFT JOIN part ON p_partkey = d.id LEFT JOIN h ON h.id = d.id GROUP BY 1""",
)
def assign_report(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", "l_partkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_orderkey")
    wanted = li.where("l_suppkey = 7").select((F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 1_000_000).otherwise(0)).alias("id"), F.col("l_orderkey").alias("position"))
    held = li.where("l_suppkey = 8").groupBy(F.col("l_partkey").alias("id")).agg((F.max("l_returnflag") != "A").alias("active"))
    known = table(spark, sf, "part", "p_partkey").withColumnRenamed("p_partkey", "id")
    return L.classified_assignments(wanted, known, held, "id", "active").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "import_classify",
    """WITH i AS (SELECT o_orderkey AS id, o_custkey, o_totalprice, o_orderpriority FROM orders)
        SELECT id, CASE WHEN o_totalprice < 20000 THEN 'error' WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'new' WHEN o_orderpriority = '5-LOW' THEN 'conflict' ELSE 'existing_match' END AS status FROM i""",
)
def import_classify(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")  # the imported file
    known = table(spark, sf, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    status = F.when(F.col("o_totalprice") < 20_000, "error").when(F.col("known").isNull(), "new").when(F.col("o_orderpriority") == "5-LOW", "conflict").otherwise("existing_match")
    return rows.join(known, "o_custkey", "left").select(F.col("o_orderkey").alias("id"), status.alias("status"))


@query("set_counts", "SELECT s_suppkey, s_name, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS items FROM supplier")
def set_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem", "l_suppkey", "l_partkey").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("items"))
    s = table(spark, sf, "supplier", "s_suppkey", "s_name").join(n, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return s.select("s_suppkey", "s_name", F.coalesce("items", F.lit(0)).cast("long").alias("items"))


_GRADE = "CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END"


@query(
    "learning_state",
    f"""WITH g AS (SELECT user_id, count(*) AS reps, last({_GRADE} ORDER BY ts, event_id) AS grade FROM events GROUP BY user_id)
        SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 'NEW' WHEN grade = 1 THEN 'LEARNING' WHEN reps <= 1 THEN 'ENCOUNTERED' ELSE 'REVIEWING' END AS state FROM g""",
)
def learning_state(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events", "user_id", "event_type", "ts", "event_id").withColumn("grade", _grade())
    g = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("reps"), F.max_by("grade", F.struct("ts", "event_id")).alias("grade"))
    return g.select("user_id", S.learning_state(F.col("user_id") % 10 != 0, F.col("reps"), F.col("grade")).alias("state"))


def _grade():
    return F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 3).otherwise(4)


def _sql_fold() -> str:
    w, dec, fac = L.W, L.DECAY, L.FACTOR
    e4, e8, e1718 = w[4] - math.exp(w[5] * 3) + 1, math.exp(w[8]), math.exp(w[17] * w[18])
    s0 = "[" + ",".join(f"{x}::DOUBLE" for x in w[:4]) + "][e.g]"
    gain = f"exp({w[17]}::DOUBLE * (e.g - 3 + {w[18]}::DOUBLE)) * pow(f.s, {-w[19]}::DOUBLE)"
    r = f"pow(1 + {fac}::DOUBLE * (e.t - f.t) / 86400.0::DOUBLE / f.s, {dec}::DOUBLE)"
    lapse = f"least({w[11]}::DOUBLE * pow(f.d, {-w[12]}::DOUBLE) * (pow(f.s + 1, {w[13]}::DOUBLE) - 1) * exp({w[14]}::DOUBLE * (1 - {r})), f.s / {e1718}::DOUBLE)"
    grow = f"{e8}::DOUBLE * (11 - f.d) * pow(f.s, {-w[9]}::DOUBLE) * (exp({w[10]}::DOUBLE * (1 - {r})) - 1) * CASE e.g WHEN 2 THEN {w[15]}::DOUBLE WHEN 4 THEN {w[16]}::DOUBLE ELSE 1 END"
    s = f"CASE WHEN (e.t - f.t) / 86400.0::DOUBLE < 1 THEN f.s * CASE WHEN e.g >= 3 THEN greatest({gain}, 1) ELSE {gain} END WHEN e.g = 1 THEN {lapse} ELSE f.s * (1 + {grow}) END"
    d = f"least(10, greatest(1, {w[7]}::DOUBLE * {e4}::DOUBLE + (1 - {w[7]}::DOUBLE) * (f.d + (10 - f.d) * (-{w[6]}::DOUBLE * (e.g - 3)) / 9)))"
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_type IS NOT NULL AS ok, epoch_us(ts) / 1e6::DOUBLE AS t, {_GRADE} AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        f(user_id, n, t, s, d, lapses) AS (
          SELECT user_id, n, t, {s0}, least(10, greatest(1, {w[4] + 1}::DOUBLE - exp({w[5]}::DOUBLE * (g - 1)))), 0 FROM e WHERE n = 1
          UNION ALL SELECT e.user_id, e.n, e.t, greatest({s}, 0.001::DOUBLE), {d}, f.lapses + CASE WHEN e.g = 1 THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
        SELECT user_id, n AS reps, lapses, round(s, 5) AS stability, round(d, 5) AS difficulty FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS last FROM f) WHERE n = last""".replace("e AS (SELECT user_id, event_type IS NOT NULL AS ok,", "e AS (SELECT user_id,").replace("[e.g], least", "[g], least")


@query("fsrs_state", _sql_fold())
def fsrs_state(spark: SparkSession, sf: str) -> DataFrame:
    """The scheduler's state of every user's history, folded inside Spark."""
    e = table(spark, sf, "events", "user_id", "event_type", "ts", "event_id")
    rows = e.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("seq"), _grade().alias("grade"))
    out = L.folded(rows, "user_id")
    return out.select("user_id", F.col("reps").cast("long").alias("reps"), "lapses", F.round("stability", 5).alias("stability"), F.round("difficulty", 5).alias("difficulty"))


@query(
    "rate_limit_windows",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts::TIMESTAMP) AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        r AS (SELECT user_id, event_id, u AS start, 1 AS n, k FROM e WHERE k = 1
          UNION ALL SELECT e.user_id, e.event_id, CASE WHEN e.u - start >= 86400000000 THEN e.u ELSE start END, CASE WHEN e.u - start >= 86400000000 THEN 1 ELSE n + 1 END, e.k FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
        SELECT user_id, event_id, make_timestamp(start) AS window_start, n <= 20 AS allowed FROM r""",
)
def rate_limit_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Requests in fixed windows that start at a client's first request after the last window: which are over the limit."""
    rows = table(spark, sf, "events", "user_id", "event_id", "ts").select("user_id", F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = L.windowed(rows, "user_id", width=86_400_000_000)
    return out.select("user_id", F.col("seq").alias("event_id"), F.timestamp_micros("window_start").cast("timestamp_ntz").alias("window_start"), (F.col("number") <= 20).alias("allowed"))


@query(
    "profile_order",
    "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, event_type) AS place FROM " + _STATE,
)
def profile_order(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last"), "event_type")).cast("long")
    return _state(spark, sf).select("user_id", "event_type", place.alias("place"))


@query(
    "student_vocabulary",
    """SELECT l_suppkey, l_partkey, p_name, max(l_shipdate) AS assigned_at, row_number() OVER (PARTITION BY l_suppkey ORDER BY max(l_shipdate) DESC, p_name, l_partkey) AS place
       FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, l_partkey, p_name""",
)
def student_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Each student's items, the latest assigned first."""
    own = table(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_shipdate").groupBy("l_suppkey", "l_partkey").agg(F.max("l_shipdate").alias("assigned_at"))
    named = own.join(table(spark, sf, "part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("assigned_at"), "p_name", "l_partkey")).cast("long")
    return named.select("l_suppkey", "l_partkey", "p_name", "assigned_at", place.alias("place"))


@query(
    "export_rows",
    """SELECT p_partkey, p_name, list_aggregate(list_transform(list(l_linenumber ORDER BY l_linenumber), lambda x: x::VARCHAR), 'string_agg', ' | ') AS positions
       FROM part JOIN (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem) ON l_partkey = p_partkey GROUP BY p_partkey, p_name ORDER BY p_name, p_partkey LIMIT 50000""",
)
def export_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of an export in order, multi-values joined; 50,000 is the most that an export holds."""
    lines = table(spark, sf, "lineitem", "l_partkey", "l_linenumber").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("n"))
    p = table(spark, sf, "part", "p_partkey", "p_name").join(lines, F.col("l_partkey") == F.col("p_partkey"))
    out = p.select("p_partkey", "p_name", F.array_join(F.transform("n", lambda x: x.cast("string")), " | ").alias("positions"))
    return out.orderBy("p_name", "p_partkey").limit(50_000)


_CARDS = """(SELECT l_suppkey AS student_id, l_suppkey * 10000000 + l_partkey AS card_id, l_partkey AS sense_id, CASE WHEN min(l_linestatus) = 'F' THEN 'review' ELSE 'learning' END AS learning_state,
    max(l_linenumber) > 2 AS is_active, max(l_shipdate + to_days(CAST(l_quantity AS INTEGER))) FILTER (WHERE l_returnflag <> 'N') AS due_at, count(*) FILTER (WHERE l_returnflag <> 'N') AS repetitions,
    count(*) FILTER (WHERE l_returnflag = 'R') AS lapses FROM lineitem GROUP BY l_suppkey, l_partkey)"""
_QUEUE_AT = "2000-01-01 12:00:00"
_DUE_CARDS = f"""(SELECT student_id, card_id, sense_id, p_name AS headword, learning_state, CASE WHEN repetitions > 0 THEN repetitions END AS repetitions, CASE WHEN repetitions > 0 THEN lapses END AS lapses, due_at,
    CASE WHEN repetitions = 0 THEN 2 WHEN due_at < TIMESTAMP '{_QUEUE_AT}' THEN 0 ELSE 1 END AS bucket, CASE WHEN repetitions > 0 THEN due_at < TIMESTAMP '{_QUEUE_AT}' END AS is_overdue
    FROM {_CARDS} JOIN part ON p_partkey = sense_id WHERE is_active AND (repetitions = 0 OR due_at <= date_trunc('day', TIMESTAMP '{_QUEUE_AT}') + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND))"""


def _queue_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cards of suppliers as students in parts as senses, their states, and the senses."""
    li = table(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    student, card, sense = F.col("l_suppkey").alias("student_id"), (F.col("l_suppkey") * 10000000 + F.col("l_partkey")).alias("card_id"), F.col("l_partkey").alias("sense_id")
    state = F.when(F.min("l_linestatus") == "F", "review").otherwise("learning").alias("learning_state")
    cards = li.groupBy(student, card, sense).agg(state, (F.max("l_linenumber") > 2).alias("is_active"))
    reviewed = li.where("l_returnflag <> 'N'").groupBy(card).agg(
        F.expr("max(l_shipdate + make_dt_interval(cast(l_quantity as int)))").alias("due_at"), F.count(F.lit(1)).alias("repetitions"), F.count_if(F.col("l_returnflag") == "R").alias("lapses")
    )
    return cards, reviewed, table(spark, sf, "part", "p_partkey", "p_name").toDF("sense_id", "headword")


@query(
    "due_queue_narrowed",
    f"""SELECT d.*, t.translation FROM {_DUE_CARDS} d LEFT JOIN (SELECT l_partkey AS sense_id, arg_min(l_returnflag || l_linestatus, (l_orderkey, l_linenumber, l_returnflag || l_linestatus)) AS translation FROM lineitem GROUP BY 1) t USING (sense_id)
        WHERE student_id = 3 AND learning_state IN ('learning', 'review') AND lapses > 0 AND headword ILIKE '%RI%' AND sense_id IN (SELECT p_partkey FROM part WHERE p_size <= 40)
        ORDER BY bucket, due_at NULLS LAST, headword, card_id LIMIT 50""",
)
def due_queue_narrowed(spark: SparkSession, sf: str) -> DataFrame:
    """A student's page of 50: lapsed cards of a set, in two states, with part of a headword, and each one's first translation."""
    cards, states, senses = _queue_tables(spark, sf)
    members = table(spark, sf, "part", "p_partkey", "p_size").where("p_size <= 40").select(F.col("p_partkey").alias("sense_id"))
    only = Q.Narrowing(members=members, states=["learning", "review"], difficult=True, search="RI")
    page = Q.queue(Q.due(cards, states, senses, F.lit(_QUEUE_AT).cast("timestamp"), only), 3)
    li = table(spark, sf, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    children = li.select(F.col("l_partkey").alias("sense_id"), F.struct("l_orderkey", "l_linenumber").alias("position"), F.concat("l_returnflag", "l_linestatus").alias("translation"))
    return Q.with_first(page, children, "translation", "translation")


@query(
    "next_up",
    f"""SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY bucket, due_at NULLS LAST, headword, card_id) AS n FROM {_DUE_CARDS}) WHERE n = 1""",
)
def next_up(spark: SparkSession, sf: str) -> DataFrame:
    """Every student's first card."""
    cards, states, senses = _queue_tables(spark, sf)
    return Q.next_up(Q.due(cards, states, senses, F.lit(_QUEUE_AT).cast("timestamp")))


#: An import of documents into labels as held senses: every fifth row names its key, others derive it from their text's length.
_IMPORT = """WITH r AS (SELECT doc_id AS line, CASE WHEN doc_id % 5 = 0 THEN 'k' || (doc_id % 700) ELSE ' ' END AS named, 'k' || (length(text) % 900) AS derived, lang AS pos, CASE WHEN doc_id % 3 = 0 THEN 'a1' ELSE 'B2' END AS cefr,
      list_filter(string_split(text, ' ')[1:4], lambda w: w <> '') AS w FROM documents),
    h AS (SELECT 'k' || doc_id AS key, CASE WHEN doc_id % 4 = 0 THEN 'en' ELSE 'fr' END AS pos, 'B2' AS cefr FROM documents WHERE doc_id % 2 = 0),
    k AS (SELECT *, CASE WHEN trim(named) <> '' THEN named ELSE derived END AS key, trim(named) <> '' AS has FROM r),
    f AS (SELECT key, min(line) AS first, arg_min(struct_pack(pos := lower(pos), cefr := upper(cefr)), line) AS own FROM k WHERE NOT has GROUP BY key),
    c AS (SELECT k.*, CASE WHEN h.key IS NOT NULL THEN CASE WHEN lower(k.pos) = h.pos AND upper(k.cefr) = h.cefr THEN 'existing_match' ELSE 'conflict' END
        WHEN coalesce(first < line, false) THEN CASE WHEN struct_pack(pos := lower(k.pos), cefr := upper(k.cefr)) = own THEN 'existing_match' ELSE 'conflict' END WHEN NOT has THEN 'new' ELSE 'error' END AS status
      FROM k LEFT JOIN h ON h.key = k.key LEFT JOIN f ON f.key = k.key)"""


def _import_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = table(spark, sf, "documents", "doc_id", "text", "lang")
    number = F.col("doc_id")
    rows = d.select(
        number.alias("line"), F.when(number % 5 == 0, F.concat(F.lit("k"), number % 700)).otherwise(" ").alias("sense_key"), F.concat(F.lit("k"), F.length("text") % 900).alias("derived_key"),
        F.lit("").alias("headword"), F.upper("lang").alias("pos"), F.when(number % 3 == 0, "a1").otherwise("B2").alias("cefr"), F.lit("").alias("definition"),
    )
    held = d.where("doc_id % 2 = 0").select(F.concat(F.lit("k"), "doc_id").alias("sense_key"), F.when(number % 4 == 0, "en").otherwise("fr").alias("pos"), F.lit("B2").alias("cefr"), F.lit(None).cast("string").alias("definition"))
    words = F.filter(F.slice(F.split("text", " "), 1, 4), lambda w: w != "")
    values = d.select(number.alias("line"), F.posexplode(words).alias("place", "value")).withColumn("norm", F.lower("value"))
    return I.classified(rows, held), values, d


@query("import_preview", _IMPORT + " SELECT line, status, CASE WHEN status <> 'error' THEN key END AS sense_key FROM c")
def import_preview(spark: SparkSession, sf: str) -> DataFrame:
    return _import_parts(spark, sf)[0].select("line", "status", "sense_key")


@query(
    "import_children",
    _IMPORT + """, v AS (SELECT key, line, unnest(w) AS value, generate_subscripts(w, 1) AS place FROM c WHERE status IN ('new', 'existing_match')),
    o AS (SELECT key, lower(value) AS norm, arg_min(value, (line, place)) AS value, min((line, place)) AS met FROM v GROUP BY 1, 2),
    g AS (SELECT 'k' || doc_id AS key, lower(string_split(text, ' ')[1]) AS norm, doc_id % 4 AS position FROM documents WHERE doc_id % 2 = 0),
    n AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.key = o.key AND g.norm = o.norm))
    SELECT n.key AS sense_key, value, norm, coalesce((SELECT max(position) FROM g WHERE g.key = n.key), -1) + row_number() OVER (PARTITION BY n.key ORDER BY met) AS position FROM n""",
)
def import_children(spark: SparkSession, sf: str) -> DataFrame:
    """The first words of the imported texts as values; each held sense has one value already."""
    marked, values, d = _import_parts(spark, sf)
    held = d.where("doc_id % 2 = 0").select(F.concat(F.lit("k"), "doc_id").alias("sense_key"), F.lower(F.get(F.split("text", " "), F.lit(0))).alias("norm"), (F.col("doc_id") % 4).alias("position"))
    return I.children(marked, values, held)
