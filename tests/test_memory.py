"""What Python workers hold: each key made once, long texts in small batches."""

import pandas as pd
from pyspark.sql import functions as F

from sensemill.plans import resolution
from sensemill.sources import adapters

from .conftest import SF


def test_target_keys_are_made_once(spark):
    rows = spark.createDataFrame([("A/b c/Ł", "processed"), ("Łódź/b  C", "processed"), ("no", "failed"), (None, "processed"), ("!", "processed")], "headword string, verdict string")
    out = adapters.target_keys(rows, rows)
    assert sorted(r["key"] for r in out.collect()) == ["b c", "lodz"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # the two steps of a key


def test_long_texts_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    resolution.text_search_key(spark, SF)

    @F.pandas_udf("long")
    def size(s: pd.Series) -> pd.Series:
        return pd.Series([int(s.str.len().sum())] * len(s))

    most = spark.range(0, 300, 1, 1).select(size(F.repeat(F.lit("x"), 100_000)).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 5 << 20
