"""Fitted pipelines: saved, loaded, scored; test rows never change the state."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tessera.operators import stages as st
from tessera.plans import evaluation as ev
from tessera.session import scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(i, [rng.gauss(2.0 * (i % 3), 1.0), None if i % 11 == 0 else rng.gauss(0, 5), 4.0], "abc"[i % 3] if i % 5 else "a") for i in range(240)]
    return spark.createDataFrame(data, "id long, vec array<double>, label string").repartition(4)


@pytest.mark.parametrize("model,kw", [("logistic", {}), ("boosted", {"max_iter": 2, "max_depth": 2, "balance": False})])
def test_saved_pipeline_scores_alike(spark, rows, model, kw):
    train, test = rows.where("id % 4 != 0"), rows.where("id % 4 = 0")
    fitted = ev.fit_pipeline(train, model, "id", "vec", "label", **kw)
    path = scratch_path(spark, "pipeline")
    fitted.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    plain = test.drop("label")
    scored = {r.id: r.y_pred for r in loaded.transform(plain).collect()}
    assert scored == {r.id: r.y_pred for r in fitted.transform(test).collect()} and len(scored) == test.count()
    assert [type(s).__name__ for s in loaded.stages][:3] == ["ArrayMedianImputerModel", "SortedLabelEncoderModel", "ArrayPopulationScalerModel"]
    assert not any(getattr(s, "train_only", False) for s in loaded.stages)


def test_state_comes_from_the_training_rows_only(spark, rows):
    train = rows.where("id % 4 != 0")
    fitted = ev.fit_pipeline(train, "logistic", "id", "vec", "label", balance=False)
    state = [(p.name, s.getOrDefault(p)) for s in fitted.stages[:3] for p in s.params if s.isSet(p)]
    odd = spark.createDataFrame([(9000, [1e9, None, -1e9], "c")], rows.schema)
    fitted.transform(odd).collect()
    assert state == [(p.name, s.getOrDefault(p)) for s in fitted.stages[:3] for p in s.params if s.isSet(p)]
    other = ev.fit_pipeline(train.unionByName(odd), "logistic", "id", "vec", "label", balance=False)
    assert other.stages[2].getOrDefault("means") != fitted.stages[2].getOrDefault("means")
    with pytest.raises(Exception, match="unknown label"):
        fitted.transform(spark.createDataFrame([(1, [0.0, 0.0, 0.0], "z")], rows.schema)).select("_target").collect()


def test_only_training_rows_are_balanced(rows):
    seen = []

    class Look(st.Transformer):
        train_only = True

        def _transform(self, df):
            seen.append({r["_target"]: r["count"] for r in df.groupBy("_target").count().collect()})
            return df

    pipe = st.TrainingPipeline(stages=[st.ArrayMedianImputer(inputCol="vec"), st.SortedLabelEncoder(inputCol="label", outputCol="_target"),
                                       st.SmoteBalancer(inputCol="vec", labelCol="_target"), Look(), st.ArrayPopulationScaler(inputCol="vec")])
    fitted = pipe.fit(rows)
    assert len(set(seen[0].values())) == 1 and len(seen[0]) == 3
    assert fitted.transform(rows).count() == rows.count()


def test_stage_values(spark):
    df = spark.createDataFrame([([1.0, None],), ([3.0, float("nan")],), ([8.0, 2.0],)], "v array<double>")
    filled = st.ArrayMedianImputer(inputCol="v").fit(df)
    assert filled.getOrDefault("medians") == [3.0, 2.0]
    assert [r.v for r in filled.transform(df).collect()] == [[1.0, 2.0], [3.0, 2.0], [8.0, 2.0]]
    z = st.ArrayPopulationScaler(inputCol="v", outputCol="z").fit(filled.transform(df)).transform(filled.transform(df))
    assert [[round(x, 6) for x in r.z] for r in z.collect()] == [[-1.019049, 0.0], [-0.339683, 0.0], [1.358732, 0.0]]
    scorer = st.LinearScorer(inputCol="v", weights=[1.0, 0.0, 0.0, 1.0], biases=[0.0, 1.0])
    got = scorer.transform(spark.createDataFrame([([2.0, 1.0],), ([0.0, 5.0],)], "v array<double>")).collect()
    assert [(r.scores, r.prediction) for r in got] == [([2.0, 2.0], 0.0), ([0.0, 6.0], 1.0)]


def test_solver_rows_in_few_partitions(spark):
    """Rows by the thousand in hundreds of partitions: a solver gets as many as cores or size ask for, and every row."""
    from tessera.session import SOLVER_PARTITIONS, for_solver
    df = spark.range(0, 3000, 1, 240).selectExpr("id", "array(cast(id as double), 1.0D) as vec")
    got = for_solver(df)
    most = max(SOLVER_PARTITIONS, spark.sparkContext.defaultParallelism)
    assert got.rdd.getNumPartitions() <= most
    assert sorted((r.id, r.vec) for r in got.collect()) == [(i, [float(i), 1.0]) for i in range(3000)]
    assert for_solver(df.coalesce(3)).rdd.getNumPartitions() == 3 and for_solver(df.where("id < 0")).count() == 0
