"""Classifier pipelines: scale, bin, assemble, index labels, fit.

Trees see a row only by the bins of its values. So the bins are a stage of the pipeline, and rows alike in all of them and
in their label are counted once and fitted as one row with a weight: all rows take part, and a fit's passes cost what the
different rows cost.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.session import shared_dir
from tidewarden.training.evaluate import accuracy, mean_auc
from tidewarden.training.prepare import (
    LABEL_INDEX, SEED, WEIGHT, alike_rows, bin_stage, fold_numbers, label_stage, population_moments, scaling_stage, vector_stage,
)

# Estimator settings and search grids.
FOREST = {"numTrees": 200, "maxDepth": 20, "minInstancesPerNode": 2}
BOOSTING = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.1}
FOREST_GRID = {"numTrees": [100, 200, 300], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 5]}
BOOSTING_GRID = {"maxIter": [100, 200], "maxDepth": [4, 6, 8], "stepSize": [0.05, 0.1, 0.2]}


def checkpointing(spark: SparkSession) -> None:
    """Boosting and deep forests cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def random_forest(**settings) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=LABEL_INDEX, featuresCol="features", seed=SEED, checkpointInterval=10,
                                  cacheNodeIds=True, **{**FOREST, **settings})


def gradient_boosting(classes: int, **settings):
    """Boosted trees; more than two classes are fitted one against the rest."""
    gbt = GBTClassifier(labelCol=LABEL_INDEX, featuresCol="features", seed=SEED, checkpointInterval=10, **{**BOOSTING, **settings})
    return gbt if classes <= 2 else OneVsRest(classifier=gbt, labelCol=LABEL_INDEX, featuresCol="features")


def sampled_boosting(classes: int, **settings):
    """The second boosted model: row sampling and coarser bins."""
    return gradient_boosting(classes, **{"subsamplingRate": 0.8, "maxBins": 64, **settings})


def prepared_by(train: DataFrame, columns: list[str], label: str = "Label") -> PipelineModel:
    """The stages before an estimator: scaling, vector and label code, fitted on the training part."""
    return Pipeline(stages=[scaling_stage(population_moments(train, columns)), vector_stage(columns), label_stage(label)]).fit(train)


def fit(train: DataFrame, columns: list[str], estimator, label: str = "Label") -> PipelineModel:
    """Everything is fitted on the training part alone and saved as one model."""
    checkpointing(train.sparkSession)
    scaling, vector, codes = prepared_by(train, columns, label).stages
    trees = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    scaled = codes.transform(scaling.transform(train))
    bins = bin_stage(scaled, vector.getInputCols(), trees.getMaxBins())
    assembler = VectorAssembler(inputCols=bins.getOutputCols(), outputCol="features")
    total = train.count()
    drawn = isinstance(trees, RandomForestClassifier) or trees.getSubsamplingRate() < 1.0
    alike = alike_rows(bins.transform(scaled), bins.getOutputCols(), total, drawn)
    return PipelineModel(stages=[scaling, bins, assembler, codes, weighted(estimator, total).fit(assembler.transform(alike))])


def weighted(estimator, total: int):
    """The estimator for rows with weights that add up to ``total``; its least rows of a leaf are their weight."""
    if isinstance(estimator, OneVsRest):
        return estimator.copy({estimator.classifier: weighted(estimator.getClassifier(), total), estimator.weightCol: WEIGHT})
    settings, least = {estimator.weightCol: WEIGHT}, estimator.getMinInstancesPerNode()
    if least > 1 and total >= 4 * least:
        settings |= {estimator.minInstancesPerNode: 1, estimator.minWeightFractionPerNode: least / total}
    return estimator.copy(settings)


def class_probabilities(scored: DataFrame) -> Column:
    """Probabilities, or normalised margins where a model gives none."""
    if "probability" in scored.columns:
        return vector_to_array(F.col("probability"))
    weights = F.transform(vector_to_array(F.col("rawPrediction")), lambda m: 1.0 / (1.0 + F.exp(-m)))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(weights, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn("class_probabilities", class_probabilities(scored))


def evaluate(name: str, model: PipelineModel, test: DataFrame) -> DataFrame:
    """(model, metric, value) rows for accuracy and AUC."""
    scored = predict(model, test)
    parts = [
        accuracy(scored, LABEL_INDEX).select(F.lit(name).alias("model"), F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")),
        mean_auc(scored.withColumn(LABEL_INDEX, F.col(LABEL_INDEX).cast("int")), LABEL_INDEX, "class_probabilities").select(
            F.lit(name).alias("model"), F.lit("auc").alias("metric"), F.col("auc_score").alias("value")),
    ]
    return parts[0].unionByName(parts[1])


def grid_search(
    train: DataFrame, columns: list[str], estimator, grid: dict[str, list], row_id: str, label: str = "Label", folds: int = 3,
    parallelism: int = 4,
) -> tuple[CrossValidatorModel, PipelineModel]:
    """Cross-validated accuracy over a grid, with folds fixed by a hash of the row, and the best model as a pipeline
    with its scaling and label stages. ``parallelism`` fits run at a time."""
    checkpointing(train.sparkSession)
    target = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(target.getParam(name), values)
    preparation = prepared_by(train, columns, label)
    prepared = preparation.transform(fold_numbers(train, row_id, folds))
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=builder.build(), numFolds=folds, foldCol="fold", seed=SEED, parallelism=parallelism,
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy", labelCol=LABEL_INDEX),
    )
    found = search.fit(prepared.select("features", LABEL_INDEX, "fold"))
    return found, PipelineModel(stages=[*preparation.stages, found.bestModel])


def search_results(model: CrossValidatorModel) -> list[tuple[str, float]]:
    """(settings, mean accuracy) of every grid point; as many rows as the grid has."""
    def text(params) -> str:
        return ",".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda x: x[0].name))

    return [(text(p), float(m)) for p, m in zip(model.getEstimatorParamMaps(), model.avgMetrics)]
