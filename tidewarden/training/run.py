"""A whole training run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.session import materialize
from tidewarden.sources.labelled import numeric_columns, training_table
from tidewarden.training import classifiers as c
from tidewarden.training.nested_search import nested_search
from tidewarden.training.prepare import stratified_split
from tidewarden.training.registry import append_run, save_models
from tidewarden.training.stages import DECISION, anomaly_pipelines

EXPERIMENT = "flow-models"


def train_all(
    table: DataFrame,
    row_id: str,
    folder: str,
    label: str = "Label",
    experiment: str = EXPERIMENT,
    forest: dict | None = None,
    boosting: dict | None = None,
    forest_grid: dict | None = None,
    boosting_grid: dict | None = None,
    trees: int = 100,
    version: str = "1",
    search_rows: int | None = None,
) -> DataFrame:
    """Prepare, train, evaluate, search, save and record; returns (model, metric, value) rows.

    The defaults are the full-size settings; the arguments override single ones. Searches see all training rows,
    or ``search_rows`` of them if a caller asks for that;
    boosting of more than two classes, which is fitted one against the rest, is searched point by point.
    """
    spark = table.sparkSession
    ready = materialize(training_table(table, label, keep=(row_id,)))  # the split reads its table several times
    columns = [x for x in numeric_columns(ready, label) if x != row_id]
    split = materialize(stratified_split(ready, row_id, label))
    train, test = split.filter("not is_test"), split.filter("is_test")
    classes = train.select(label).distinct().count()

    estimators = {
        "random_forest": c.random_forest(**(forest or {})),
        "gradient_boosting": c.gradient_boosting(classes, **(boosting or {})),
        "sampled_boosting": c.sampled_boosting(classes, **(boosting or {})),
    }
    models = {name: c.fit(train, columns, e, label) for name, e in estimators.items()}
    results = c.evaluate("random_forest", models["random_forest"], test)
    for name in list(models)[1:]:
        results = results.unionByName(c.evaluate(name, models[name], test))

    for name, model in anomaly_pipelines(train, columns, row_id, label, trees).items():
        models[name] = model
        inside = model.transform(train).agg(F.avg((F.col(DECISION) >= 0).cast("double")).alias("value"))
        results = results.unionByName(inside.select(F.lit(name).alias("model"), F.lit("inside_share").alias("metric"), "value"))

    searches = {
        "random_forest_tuned": (c.random_forest(**(forest or {})), forest_grid or c.FOREST_GRID),
        "gradient_boosting_tuned": (c.gradient_boosting(classes, **(boosting or {})), boosting_grid or c.BOOSTING_GRID),
    }
    for name, (estimator, grid) in searches.items():
        if classes > 2 and name.startswith("gradient"):
            search, models[name] = c.grid_search(train, columns, estimator, grid, row_id, label)
            found = c.search_results(search)
        else:
            found, models[name] = nested_search(train, columns, estimator, grid, row_id, label, max_rows=search_rows)
        best = spark.createDataFrame([(name, "cv_accuracy", max(a for _, a in found))], "model string, metric string, value double")
        results = results.unionByName(best)

    results = materialize(results)
    save_models(spark, folder, models, columns, version)
    append_run(results, folder, uuid.uuid4().hex, experiment)
    return results
