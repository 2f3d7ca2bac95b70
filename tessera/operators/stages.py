"""Preprocessing and balancing as Spark ML stages with saved state.

The estimators fit on the rows they are given and keep what they learnt as
parameters, so ``PipelineModel.save`` and ``load`` carry it.  ``TrainingPipeline``
fits like ``Pipeline`` but applies its train-only stages (balancing, checkpoint)
to the training rows alone and leaves them out of the fitted model: rows scored
later are never resampled, and no row outside ``fit`` changes the state.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import balance, prep
from tessera.operators.metrics import argmax_index
from tessera.session import for_solver

MAX_CLASSES = 1 << 16


class _Stage(HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A stage from one column to another, by default in place."""

    def _init(self, kwargs: dict) -> None:
        self._set(**{k: v for k, v in kwargs.items() if v is not None})

    def _out(self) -> str:
        return self.getOrDefault("outputCol") if self.isSet("outputCol") else self.getInputCol()

    def _cols(self) -> dict:
        return {"inputCol": self.getInputCol(), "outputCol": self._out()}


def _floats(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toListFloat)


class ArrayMedianImputer(Estimator, _Stage):
    """Fills missing elements of an array column with the median of their position."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ArrayMedianImputerModel:
        col = self.getInputCol()
        got = prep.params_dict(prep.array_impute_fit(dataset, col), "pos", "median")
        width = dataset.agg(F.max(F.size(col))).first()[0] or 0
        return ArrayMedianImputerModel(**self._cols(), medians=[float(got.get(i) or 0.0) for i in range(max(width, 0))])


class ArrayMedianImputerModel(Model, _Stage):
    medians = _floats("medians", "median of every position")

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, medians=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fill = F.array(*[F.lit(m) for m in self.getOrDefault("medians")]).cast("array<double>")
        filled = F.zip_with(F.col(self.getInputCol()), fill, lambda x, m: F.when(x.isNull() | F.isnan(x.cast("double")), m).otherwise(x.cast("double")))
        return dataset.withColumn(self._out(), filled)


class ArrayPopulationScaler(Estimator, _Stage):
    """Subtracts the mean of every position and divides by its population deviation (1 where that is 0)."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ArrayPopulationScalerModel:
        rows = sorted(prep._bounded_collect(prep.array_scale_fit(dataset, self.getInputCol())), key=lambda r: r["pos"])
        return ArrayPopulationScalerModel(**self._cols(), means=[float(r["mean"]) for r in rows], scales=[float(r["scale"]) for r in rows])


class ArrayPopulationScalerModel(Model, _Stage):
    means = _floats("means", "mean of every position")
    scales = _floats("scales", "divisor of every position")

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, means=None, scales=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        mean, scale = (F.array(*[F.lit(x) for x in self.getOrDefault(c)]).cast("array<double>") for c in ("means", "scales"))
        z = F.zip_with(F.zip_with(F.col(self.getInputCol()), mean, lambda x, m: x.cast("double") - m), scale, lambda d, s: d / s)
        return dataset.withColumn(self._out(), z)


class SortedLabelEncoder(Estimator, _Stage):
    """Classes in sorted order to 0, 1, ... (doubles).  A class that was not
    there to learn is an error; rows without the column pass as they are."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SortedLabelEncoderModel:
        return SortedLabelEncoderModel(**self._cols(), labels=_classes(dataset, self.getInputCol()))


def _classes(dataset: DataFrame, col: str) -> list[str]:
    rows = prep._bounded_collect(dataset.select(F.col(col).cast("string").alias("c")).where("c is not null").distinct(), MAX_CLASSES)
    return sorted(r["c"] for r in rows)


class _Labels(_Stage):
    labels = Param(Params._dummy(), "labels", "classes in order", TypeConverters.toListString)

    def _array(self):
        return F.array(*[F.lit(x) for x in self.getOrDefault("labels")]).cast("array<string>")


class SortedLabelEncoderModel(Model, _Labels):
    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, labels=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        col = self.getInputCol()
        if col not in dataset.columns:
            return dataset
        at = F.array_position(self._array(), F.col(col).cast("string"))
        unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.col(col).cast("string"))).cast("double")
        return dataset.withColumn(self._out(), F.when(at == 0, unknown).otherwise((at - 1).cast("double")))


class PredictionDecoder(Estimator, _Stage, HasLabelCol):
    """Class numbers back to the classes of ``labelCol``."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, labelCol=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PredictionDecoderModel:
        return PredictionDecoderModel(**self._cols(), labels=_classes(dataset, self.getLabelCol()))


class PredictionDecoderModel(Model, _Labels):
    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, labels=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self._out(), F.get(self._array(), F.col(self.getInputCol()).cast("int")))


class ArrayToVector(Transformer, _Stage):
    """An array column as the vector that Spark ML's classifiers read."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._init(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self._out(), array_to_vector(F.col(self.getInputCol()).cast("array<double>")))


class LinearScorer(Model, _Stage):
    """Class scores weights x + bias of an array column (JVM expressions), and
    the number of the first highest one as ``outputCol``."""

    weights = _floats("weights", "rows of weights, one after another, a row per class")
    biases = _floats("biases", "bias of every class")
    digits = Param(Params._dummy(), "digits", "decimals that scores are rounded to", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, weights=None, biases=None, digits=None):
        super().__init__()
        self._setDefault(outputCol="prediction", digits=6)
        self._init(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, biases = self.getOrDefault("weights"), self.getOrDefault("biases")
        width = len(weights) // len(biases)

        def score(c: int):
            row = F.array(*[F.lit(w) for w in weights[c * width:(c + 1) * width]])
            return F.round(F.aggregate(F.zip_with(F.col(self.getInputCol()), row, lambda x, w: x * w), F.lit(biases[c]), lambda s, x: s + x), self.getOrDefault("digits"))

        scored = dataset.withColumn("scores", F.array(*[score(c) for c in range(len(biases))]))
        return scored.withColumn(self.getOrDefault("outputCol"), argmax_index(F.col("scores")).cast("double"))


class SmoteBalancer(Transformer, HasInputCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Training rows with every class raised to the largest (train-only)."""

    train_only = True
    idCol = Param(Params._dummy(), "idCol", "unique row id", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, labelCol=None, idCol=None, k=None):
        super().__init__()
        self._setDefault(idCol="id", k=5)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        vec, label = self.getInputCol(), self.getLabelCol()
        return balance.smote(dataset, self.getOrDefault("idCol"), vec, label, k=self.getOrDefault("k")).select(label, vec)


class Checkpoint(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Training rows written to the shared folder (train-only): solvers read them many times."""

    train_only = True

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return for_solver(dataset)


class TrainingPipeline(Pipeline):
    """A ``Pipeline`` whose train-only stages shape the training rows and are no part of the fitted ``PipelineModel``."""

    @keyword_only
    def __init__(self, *, stages=None):
        super().__init__(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        stages = self.getStages()
        last = max((i for i, s in enumerate(stages) if isinstance(s, Estimator)), default=-1)
        kept: list[Transformer] = []
        for i, stage in enumerate(stages):
            own = getattr(stage, "train_only", False)
            model = stage.fit(dataset) if isinstance(stage, Estimator) else stage
            if i < last:
                dataset = model.transform(dataset)
            if not own:
                kept.append(model)
        return PipelineModel(kept)
