"""Saved models, their manifest, their versions and the run metrics."""

from __future__ import annotations

import time

from pyspark.ml import PipelineModel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.training.stages import DECISION, DecisionStage

MODEL_SCHEMA = "name string, kind string, version string, path string"
LOAD_SCHEMA = "name string, version string, at double, seconds double"
MANIFEST_SCHEMA = "feature_columns array<string>, num_features int, model_names array<string>"
RUN_SCHEMA = "run_id string, experiment string, model string, metric string, value double"


def model_path(folder: str, name: str, version: str) -> str:
    """The one rule for where a model lies, for saving and for loading."""
    return f"{folder}/models/{name}/{version}"


def save_models(spark: SparkSession, folder: str, models: dict[str, PipelineModel], columns: list[str], version: str = "1") -> None:
    """Write every model with a row in the model table, and the feature manifest."""
    rows = []
    for name, model in models.items():
        path = model_path(folder, name, version)
        model.write().overwrite().save(path)
        rows.append((name, kind_of(model), version, path))
    spark.createDataFrame(rows, MODEL_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/model_table")
    manifest(spark, columns, list(models)).coalesce(1).write.mode("overwrite").json(f"{folder}/feature_info")


def kind_of(model: PipelineModel) -> str:
    """What a model's last stage adds: a ``decision`` or a ``prediction``."""
    return DECISION if isinstance(model.stages[-1], DecisionStage) else "prediction"


def manifest(spark: SparkSession, columns: list[str], models: list[str]) -> DataFrame:
    return spark.createDataFrame([(columns, len(columns), models)], MANIFEST_SCHEMA)


def model_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MODEL_SCHEMA).parquet(f"{folder}/model_table")


def load_model(spark: SparkSession, folder: str, name: str, version: str | None = None):
    """A saved model by name and version; by default the newest, with versions compared as numbers where they are.

    The seconds it took are added to the load table.
    """
    known = model_table(spark, folder).filter(F.col("name") == name)
    if version is not None:
        known = known.filter(F.col("version") == version)
    row = known.orderBy(F.col("version").try_cast("double").desc_nulls_last(), F.col("version").desc()).first()
    if row is None:
        raise ValueError(f"no model {name}" + (f" of version {version}" if version else ""))
    start = time.time()
    model = PipelineModel.load(row["path"])
    spent = spark.createDataFrame([(name, row["version"], start, time.time() - start)], LOAD_SCHEMA)
    spent.coalesce(1).write.mode("append").parquet(f"{folder}/model_loads")
    return model


def list_models(spark: SparkSession, folder: str) -> DataFrame:
    """Available models with version and the seconds the last load took; null for one that was never loaded.

    Nothing is loaded for it: the model table and the load table are joined.
    """
    loads = load_table(spark, folder).groupBy("name", "version").agg(F.max_by("seconds", "at").alias("load_seconds"))
    return model_table(spark, folder).join(loads, ["name", "version"], "left").select("name", "kind", "version", "path", "load_seconds")


def load_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every load of a model, empty as long as there was none."""
    try:
        return spark.read.schema(LOAD_SCHEMA).parquet(f"{folder}/model_loads")
    except AnalysisException:
        return spark.createDataFrame([], LOAD_SCHEMA)


def append_run(results: DataFrame, folder: str, run_id: str, experiment: str) -> None:
    """Add (model, metric, value) rows of one run to the run table."""
    stamped = results.withColumns({"run_id": F.lit(run_id), "experiment": F.lit(experiment)})
    stamped.select("run_id", "experiment", "model", "metric", F.col("value").cast("double")).write.mode("append").parquet(f"{folder}/runs")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(f"{folder}/runs")


def label_of(model: PipelineModel, prediction: str = "prediction") -> Column:
    """Predicted code back to its label."""
    labels = next(s.labels for s in model.stages if hasattr(s, "labels"))
    return F.get(F.array(*[F.lit(x) for x in labels]), F.col(prediction).cast("int"))
