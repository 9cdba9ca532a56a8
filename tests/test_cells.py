"""Range search by cells against a scan; embedding runs that stop halfway."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensemill.functions import score as S
from sensemill.operators import embed
from sensemill.operators.cells import Cells


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 16)) * 2
    x = np.concatenate([m + rng.normal(size=(150, 16)) * 0.4 for m in middles] + [rng.normal(size=(200, 16))])
    rows = [(i, int(i % 5), v.tolist()) for i, v in enumerate(x)] + [(9000, 1, None), (9001, 1, [0.0] * 16), (9002, 1, [float("nan")] * 16), (9003, 1, [1.0] * 3), (9004, 1, x[0].tolist()), (9005, 1, (x[0] * 5).tolist())]
    return spark.createDataFrame(rows, "id long, label int, v array<double>").repartition(5)


@pytest.fixture(scope="module")
def cells(spark, vectors, tmp_path_factory):
    return Cells(spark, f"file://{tmp_path_factory.mktemp('cells')}").build(vectors, "id", "v", cells=20)


@pytest.mark.parametrize("cutoff", [0.0, 0.02, 0.1, 0.4, 1.0, 2.0])
def test_within_equals_a_scan(spark, vectors, cells, cutoff):
    good = vectors.where("size(v) = 16 and id not in (9001, 9002)")
    for i in (0, 700, 1900):
        q = vectors.where(F.col("id") == i).first()["v"]
        for scope in (None, F.col("label").isin(1, 3)):
            d = S.cosine_distance(F.col("v"), F.array(*[F.lit(x) for x in q]))
            want = good.withColumn("distance", d).where(F.col("distance") <= cutoff)
            want = want if scope is None else want.where(scope)
            got = cells.within(q, "v", cutoff, scope)
            assert sorted((r["id"], r["distance"]) for r in got.collect()) == sorted((r["id"], r["distance"]) for r in want.collect())


def test_few_cells_are_read(spark, vectors, cells):
    q = vectors.where("id = 0").first()["v"]
    near, every = cells.reached(q, 0.02), cells.reached(q, 2.0)
    assert len(near) < len(every) / 2
    plan = cells.within(q, "v", 0.02)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "id long, v array<double>")
    cells = Cells(spark, f"file://{tmp_path}/c").build(none, "id", "v")
    assert cells.reached([1.0, 0.0], 2.0) == [] and cells.within([1.0, 0.0], "v", 2.0).count() == 0


def test_a_stopped_run_goes_on(spark, tmp_path):
    """The run stops after a batch is stored and before the checkpoint advances; started again, it leaves the store of a run
    that was never stopped. Failed batches are counted, found again and made good."""
    encode, source = embed.hashing_encoder(8), str(tmp_path / "in")
    for i in range(4):
        rows = [(f"k{j}", f"text {j} of {i}") for j in range(i * 5, i * 5 + 8)]
        spark.createDataFrame(rows, "key string, text string").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("key string, text string").option("maxFilesPerTrigger", 1).parquet(source)

    def poor(texts):
        if any(t.startswith("text 3 ") for t in texts):
            raise RuntimeError("no")
        return encode(texts)

    whole = embed.Store(spark, str(tmp_path / "whole"))
    embed.generated_stream(stream(), whole, str(tmp_path / "c1"), encode, 8).start().awaitTermination()

    class Stopped(embed.Store):
        def put(self, recipes, batch, *rest):
            super().put(recipes, batch, *rest)
            if batch == 1 and not stopped:
                stopped.append(batch)
                raise RuntimeError("stopped")

    stopped: list = []
    broken = Stopped(spark, str(tmp_path / "broken"))
    with pytest.raises(Exception):
        embed.generated_stream(stream(), broken, str(tmp_path / "c2"), poor, 8, 1).start().awaitTermination()
    assert stopped and broken.vectors().count() < whole.vectors().count()
    embed.generated_stream(stream(), broken, str(tmp_path / "c2"), poor, 8, 1).start().awaitTermination()
    missed = {r["key"] for r in broken.failures().collect()}
    assert missed == {"k3"}
    broken.put(spark.createDataFrame([], "key string, text string"), 100, encode, 8)
    assert broken.failures().count() == 0
    show = lambda s: {r["key"]: (r["sha"], tuple(r["embedding"])) for r in s.vectors().collect()}
    assert show(broken).keys() == show(whole).keys() and len(show(whole)) == 23
