"""The review queue and what it is narrowed to."""

import datetime as dt

from pyspark.sql import functions as F

from sensemill.operators import queue as Q

NOW = dt.datetime(2024, 5, 1, 12)


def at(**delta):
    return NOW + dt.timedelta(**delta)


def tables(spark):
    cards = [(1, 1, 10, "new", True), (1, 2, 20, "learning", True), (1, 3, 30, "review", True), (1, 4, 40, "review", False), (1, 5, 50, "review", None),
             (1, 6, 99, "new", True), (1, 7, 20, "review", True), (2, 8, 10, "new", True), (1, 9, 30, "review", True), (1, 11, 10, "review", True)]
    states = [(2, at(days=-1), 3, 1), (3, at(hours=11), 1, 0), (4, at(days=-9), 1, 1), (7, at(days=-1), 2, 0), (9, at(hours=12), 2, 2), (11, None, 2, 2)]
    senses = [(10, "Bank"), (20, "apple"), (30, "bark"), (40, "z"), (50, "z")]
    return (
        spark.createDataFrame(cards, "student_id int, card_id int, sense_id int, learning_state string, is_active boolean"),
        spark.createDataFrame(states, "card_id int, due_at timestamp_ntz, repetitions int, lapses int").withColumn("due_at", F.col("due_at").cast("timestamp")),
        spark.createDataFrame(senses, "sense_id int, headword string"),
    )


def ids(df):
    return [r["card_id"] for r in df.collect()]


def test_queue(spark):
    cards, states, senses = tables(spark)
    now = F.lit(NOW.isoformat(" ")).cast("timestamp")
    rows = Q.due(cards, states, senses, now)
    assert ids(Q.queue(rows, 1)) == [2, 7, 3, 1]  # overdue by headword and id, due today, new; 9 is due at midnight, 11 has no date
    assert [(r["bucket"], r["is_overdue"]) for r in Q.queue(rows, 1).collect()] == [(0, True), (0, True), (1, False), (2, None)]
    assert ids(Q.queue(rows, 1, limit=0)) == [2] and ids(Q.queue(rows, 5)) == []
    assert sorted((r["student_id"], r["card_id"]) for r in Q.next_up(rows).collect()) == [(1, 2), (2, 8)]

    def narrowed(**only):
        return ids(Q.queue(Q.due(cards, states, senses, now, Q.Narrowing(**only)), 1))

    assert narrowed(search="BA") == [3, 1] and narrowed(search="b_nk") == [1] and narrowed(difficult=True) == [2]
    assert narrowed(states=["review"]) == [7, 3] and narrowed(cards=[1, 7, 4]) == [7, 1]
    members = spark.createDataFrame([(20,), (20,), (None,)], "sense_id int")
    assert narrowed(members=members) == [2, 7] and narrowed(members=members.limit(0)) == []
    assert narrowed(members=members, states=["learning"], difficult=True, search="app") == [2]
    children = spark.createDataFrame([(20, 2, "b"), (20, 1, "c"), (20, 1, "a"), (30, 1, None)], "sense_id int, position int, text string")
    got = {r["card_id"]: r["first"] for r in Q.with_first(Q.queue(rows, 1), children, "text", "first").collect()}
    assert got == {2: "a", 7: "a", 3: None, 1: None}
    assert not Q.next_up(Q.due(cards.limit(0), states, senses, now)).collect()
