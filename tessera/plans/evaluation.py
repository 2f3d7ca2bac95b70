"""Model evaluation flows: split -> scale (train) -> SMOTE (train) -> fit ->
score -> macro metrics; model comparison; leak-safe cross-validation; the
end-to-end run over fused modalities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concurrent.futures import ThreadPoolExecutor

from tessera.operators import balance as bl, split as sp, stages as st, train as tr
from tessera.session import materialize


@dataclass
class Prepared:
    train: DataFrame      # ML frame: features, label (double), y_true
    test: DataFrame
    index: DataFrame      # (label, idx)
    n_features: int
    n_classes: int


def prepare(df: DataFrame, id_col: str, vec: str, label: str, balance: bool = True,
            split_col: str | None = None, test_value="test") -> Prepared:
    """Hash split (or a given split column); imputer and scaler fitted on
    training rows, SMOTE on the scaled training rows only."""
    # split, imputer, scaler and balancing all read this one checkpoint
    s = materialize(df if split_col else sp.train_test_split(df, id_col))
    split_col = split_col or "split"
    test = F.col(split_col) == F.lit(test_value)
    train, test = s.where(~test), s.where(test)
    labels = st.SortedLabelEncoder(inputCol=label).fit(s).getOrDefault("labels")
    fitted = st.TrainingPipeline(stages=[st.ArrayMedianImputer(inputCol=vec), st.ArrayPopulationScaler(inputCol=vec)]).fit(train)
    train, test = fitted.transform(train), fitted.transform(test)
    if balance:
        train = bl.smote(train, id_col, vec, label).select(label, vec)
    encode = st.SortedLabelEncoderModel(inputCol=label, outputCol="idx", labels=labels)
    train = tr.for_solver(tr.ml_frame(encode.transform(train), vec, "idx"))
    test = tr.ml_frame(encode.transform(test), vec, "idx")
    index = df.sparkSession.createDataFrame(list(enumerate(labels)), f"idx int, {label} string").select(label, "idx")
    return Prepared(train, test, index, len(fitted.stages[1].getOrDefault("means")), len(labels))


def classifier(name: str, n_train: int, n_features: int, n_classes: int, **kw):
    """The named classifier for training data of this size."""
    if name == "logistic":
        return tr.logistic(n_train, **kw)
    if name == "forest":
        return tr.forest(**kw)
    if name == "boosted":
        return tr.boosted(**kw)
    if name == "mlp":
        return tr.mlp(n_features, n_classes, **kw)
    raise ValueError(name)


def estimator(name: str, p: Prepared, n_train: int | None = None, **kw):
    return classifier(name, n_train or (p.train.count() if name == "logistic" else 0), p.n_features, p.n_classes, **kw)


def fit_score(name: str, p: Prepared, **kw):
    model = estimator(name, p, **kw).fit(p.train)
    pred = tr.decoded(tr.predict(model, p.test), p.index)
    return model, pred


def compare_models(p: Prepared, specs: dict[str, dict]) -> DataFrame:
    """One metrics row per model.  The fits read one checkpointed training
    frame and are submitted concurrently (independent Spark jobs)."""
    def run(item):
        name, kw = item
        _, pred = fit_score(name, p, **kw)
        return materialize(tr.evaluate(pred, name))

    with ThreadPoolExecutor(max_workers=max(1, len(specs))) as pool:
        parts = list(pool.map(run, specs.items()))
    out = parts[0]
    for m in parts[1:]:
        out = out.unionByName(m)
    return out


TARGET, FEATURES = "_target", "_features"


def training_pipeline(model, id_col: str, vec: str, label: str, balance: bool = True, k: int = 5) -> st.TrainingPipeline:
    """Median imputer, sorted label encoder, population scaler, SMOTE on the
    training rows only, the classifier ``model``, and decoded predictions
    (``y_pred``)."""
    stages = [st.ArrayMedianImputer(inputCol=vec), st.SortedLabelEncoder(inputCol=label, outputCol=TARGET), st.ArrayPopulationScaler(inputCol=vec),
              *([st.SmoteBalancer(inputCol=vec, labelCol=TARGET, idCol=id_col, k=k)] if balance else []),
              st.Checkpoint(), st.ArrayToVector(inputCol=vec, outputCol=FEATURES), model.copy({model.featuresCol: FEATURES, model.labelCol: TARGET})]
    return st.TrainingPipeline(stages=stages)


def fit_pipeline(df: DataFrame, model: str, id_col: str, vec: str, label: str, balance: bool = True, **kw) -> PipelineModel:
    """The training pipeline fitted on all rows of ``df``; it scores rows that have ``vec``."""
    n, width = df.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    classes = st.SortedLabelEncoder(inputCol=label).fit(df).getOrDefault("labels")
    if len(classes) < 2 and model == "boosted":
        raise ValueError("boosting needs two classes at least")
    fitted = training_pipeline(classifier(model, n, width, len(classes), **kw), id_col, vec, label, balance).fit(df)
    return PipelineModel([*fitted.stages, st.PredictionDecoderModel(inputCol="prediction", outputCol="y_pred", labels=classes)])


def cross_validate(df: DataFrame, id_col: str, vec: str, label: str, k: int = 5, model: str = "boosted",
                   **kw) -> DataFrame:
    """Stratified k-fold with one pipeline per fold: everything is fitted on
    the training folds only, and the fitted pipeline scores the held-out fold.
    (fold, n, accuracy)."""
    folds = tr.materialize(sp.stratified_folds(df, id_col, label, k))

    def one(i):
        fitted = fit_pipeline(folds.where(F.col("fold") != i), model, id_col, vec, label, **kw)
        pred = fitted.transform(folds.where(F.col("fold") == i))
        return materialize(pred.agg(F.lit(i).alias("fold"), F.count(F.lit(1)).alias("n"),
                                    F.avg((F.col(label).cast("string") == F.col("y_pred")).cast("double")).alias("accuracy")))

    # folds are independent: submit their Spark jobs concurrently
    with ThreadPoolExecutor(max_workers=k) as pool:
        parts = list(pool.map(one, range(k)))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


def fold_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("n_folds"), F.avg("accuracy").alias("mean_acc"),
                      F.stddev_pop("accuracy").alias("std_acc"))
