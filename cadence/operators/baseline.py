"""Linear baselines on static and channel features, and batch scoring with a fitted model.

The three outcome flags get a logistic regression each, the length of stay a ridge regression, all on one vector
of the static features (F18) and the pivoted channel statistics (A10), which is sparse where a patient has few
channels. The four models and the vector assembly are one ``PipelineModel``, saved and loaded in any
file system Spark writes. Fits are MLlib's (sums over partitions; the driver holds a matrix of the number of
features squared).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metrics import BINARY_TASKS, REGRESSION_TASK
from .ranking import checkpointed

STATISTICS = ("mean", "std", "max", "trend")
TASKS = (*BINARY_TASKS, REGRESSION_TASK)
#: Penalty of the squared weights of features scaled to unit deviation, beside the mean loss of a row.
PENALTY = 0.01
#: Patients that one call of a scorer gets.
SCORE_ROWS = 1024
#: Rows of the fit that a task holds: every task of every iteration sends the driver a few KB.
FIT_ROWS = 100_000


def channel_features(stats: DataFrame, channels: list[str]) -> tuple[DataFrame, list[str]]:
    """One row per patient of the A10 statistics of each channel, columns ``channel__statistic``; one aggregation."""
    cells = {f"{c}__{s}": F.max(F.when(F.col("channel") == c, F.col(s))) for c in channels for s in STATISTICS}
    return stats.groupBy("patient_id").agg(*[v.alias(n) for n, v in cells.items()]), list(cells)


def feature_table(patients: DataFrame, parts: list[tuple[DataFrame, list[str]]]) -> tuple[DataFrame, list[str]]:
    """``patient_id`` and all features of ``parts``; what a patient lacks (NULL, NaN, no row) is 0.

    Tables with a row per patient are merged, here and in the fit: a broadcast passes through the driver."""
    x, columns = patients.select("patient_id").distinct(), []
    for df, names in parts:
        x = x.join(df.select("patient_id", *[F.col(f"`{c}`").cast("double").alias(c) for c in names]).hint("merge"), "patient_id", "left")
        columns += names
    return x.na.fill(0.0, columns), columns


def fit_baselines(features: DataFrame, columns: list[str], labels: DataFrame, train: DataFrame, penalty: float = PENALTY,
                  max_iter: int = 50) -> PipelineModel:
    """The four models, fitted on the patients of ``train``; a patient without a label of a task is left out there.

    ``labels``: ``patient_id`` and a column for each of ``TASKS`` (flags 0 / 1, stay in hours). A task without any
    label gets no model; features that are the same for all these patients are left out of the vector.
    """
    known = features.join(train.select("patient_id").distinct().hint("merge"), "patient_id", "left_semi").join(
        labels.select("patient_id", *[F.col(t).cast("double").alias(f"label_{t}") for t in TASKS]).hint("merge"), "patient_id")
    known = checkpointed(known)  # counted and read
    known = known.coalesce(1 + known.count() // FIT_ROWS).persist()
    try:
        ends = known.agg(*[(F.max(f"`{c}`") > F.min(f"`{c}`")).alias(str(i)) for i, c in enumerate(columns)]).first()
        assemble = VectorAssembler(inputCols=[c for c, varied in zip(columns, ends) if varied] or columns[:1], outputCol="features")
        known_vectors = assemble.transform(known)
        stages = [assemble]
        for t in TASKS:
            mine = known_vectors.where(F.col(f"label_{t}").isNotNull())
            if mine.isEmpty():
                continue
            same = {"featuresCol": "features", "labelCol": f"label_{t}", "predictionCol": f"predicted_{t}", "maxIter": max_iter}
            if t == REGRESSION_TASK:
                # MLlib's penalty is of labels scaled to unit deviation
                spread = mine.agg(F.stddev_pop(f"label_{t}")).first()[0]
                model = LinearRegression(solver="normal", regParam=penalty * (spread or 1.0), **same)
            else:
                model = LogisticRegression(probabilityCol=f"probability_{t}", rawPredictionCol=f"raw_{t}", regParam=penalty, **same)
            stages.append(model.fit(mine))
        return PipelineModel(stages=stages)
    finally:
        known.unpersist()


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def scored_by(model: PipelineModel, features: DataFrame) -> DataFrame:
    """``patient_id`` and the four scores, by MLlib's own transformation; NULL for a task without a model."""
    out = model.transform(features)
    def of(t: str):
        if f"probability_{t}" in out.columns:
            return vector_to_array(f"probability_{t}")[1]
        return F.col(f"predicted_{t}") if f"predicted_{t}" in out.columns else F.lit(None).cast("double")
    return out.select("patient_id", *[of(t).alias(t) for t in TASKS])


def linear_weights(model: PipelineModel) -> tuple[list[str], dict[str, tuple[list[float], float]]]:
    """Feature names, and weights and intercept of each task: a few numbers per feature."""
    stages = model.stages
    return stages[0].getInputCols(), {
        m.getLabelCol()[len("label_"):]: ([float(w) for w in m.coefficients], float(m.intercept)) for m in stages[1:]}


def score_batches(features: DataFrame, columns: list[str], weights: dict[str, tuple[list[float], float]],
                  rows: int = SCORE_ROWS) -> DataFrame:
    """``patient_id`` and the four scores of linear models, whole batches at a time in Python workers.

    The weights (a few numbers per feature) travel with the function. Flags are probabilities, the stay is linear;
    a task without weights is NULL. A feature that is NULL or NaN counts as 0.
    """
    tasks = [t for t in TASKS if t in weights]
    if not tasks:
        return features.select("patient_id", *[F.lit(None).cast("double").alias(t) for t in TASKS])
    matrix = np.array([weights[t][0] for t in tasks], dtype=np.float64).reshape(len(tasks), len(columns))
    offset = np.array([weights[t][1] for t in tasks], dtype=np.float64)
    flags = [t in BINARY_TASKS for t in tasks]

    def make_predict():
        def predict(x: np.ndarray) -> dict[str, np.ndarray]:
            linear = np.nan_to_num(x.reshape(len(x), len(columns))) @ matrix.T + offset
            return {t: 1.0 / (1.0 + np.exp(-linear[:, i])) if flags[i] else linear[:, i] for i, t in enumerate(tasks)}
        return predict

    score = predict_batch_udf(make_predict, return_type=T.StructType([T.StructField(t, T.DoubleType()) for t in tasks]),
                              batch_size=rows, input_tensor_shapes=[[len(columns)]])
    vector = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns])
    out = features.select("patient_id", score(vector).alias("_s"))
    return out.select("patient_id", *[(F.col(f"_s.{t}") if t in tasks else F.lit(None).cast("double")).alias(t) for t in TASKS])
