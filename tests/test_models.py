import itertools

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tidewarden.catalog import QUERIES, models
from tidewarden.operators.running import sliced_totals
from tidewarden.operators.serving import decision_scorer
from tidewarden.session import run_dir
from tidewarden.training import classifiers as c
from tidewarden.training import evaluate, one_class, prepare, registry, stages
from tidewarden.training.isolation_forest import IsolationForestModel, fit_isolation_forest
from tidewarden.training import nested_search as nested_search_module
from tidewarden.training.nested_search import nested_search, settings_text, tree_table
from tidewarden.training.one_class import fit_one_class
from tidewarden.training.run import train_all


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    inner = rng.normal(0, 1, (600, 3))
    outer = rng.normal(8, 1, (20, 3))
    rows = [(i, [float(x) for x in v], "odd" if i >= 600 else "plain") for i, v in enumerate(np.vstack([inner, outer]))]
    return spark.createDataFrame(rows, "id long, vector array<double>, Label string").select("*", *[F.col("vector")[i].alias(f"x{i}") for i in range(3)]).cache()


def test_forest_separates_planted_outliers_and_is_stable(spark, points):
    model = fit_isolation_forest(points, "id", trees=50)
    scored = points.select("id", "Label", model.decision(F.col("vector")).alias("d")).toPandas()
    assert scored[scored.Label == "odd"].d.max() < scored[scored.Label == "plain"].d.median()
    assert 0.05 < (scored.d < 0).mean() < 0.15
    assert model.nodes.groupby("tree").size().max() <= 2 * 256 - 1
    path = run_dir(spark, "forest")
    model.save(spark, path)
    again = fit_isolation_forest(points, "id", trees=50)
    for other in (again, IsolationForestModel.load(spark, path)):
        same = points.select("id", other.decision(F.col("vector")).alias("d")).toPandas()
        assert np.allclose(scored.sort_values("id").d, same.sort_values("id").d)


def test_one_class_boundary(points):
    model = fit_one_class(prepare.standardize(points, ["x0", "x1", "x2"]).withColumn("v", F.array("x0", "x1", "x2")), "v", 3, nu=0.1)
    scaled = prepare.standardize(points, ["x0", "x1", "x2"]).withColumn("v", F.array("x0", "x1", "x2"))
    inside = scaled.select("Label", (model.decision(F.col("v")) >= 0).cast("int").alias("in")).toPandas()
    assert 0.85 < inside["in"].mean() < 0.95
    assert inside[inside.Label == "odd"]["in"].mean() < inside[inside.Label == "plain"]["in"].mean()


def test_one_class_steps_make_no_object_of_a_vector(spark, points, tmp_path, monkeypatch):
    """A step reads vectors as Arrow has them, and the anomaly models read the training table's scaled vectors as written once."""
    def none(*_):
        raise AssertionError("vectors were made objects")

    slim = points.select(F.col("vector").alias("v"))
    model = fit_one_class(slim, "v", 3, steps=1)
    monkeypatch.setattr(type(slim), "mapInPandas", none)
    count, outside, total = one_class._pass(slim.repartition(3), model)
    z = one_class.fourier(np.stack(points.toPandas()["vector"].to_numpy()), model.frequencies, model.phases)
    wrong = z @ model.weights <= model.threshold
    assert (count, outside) == (len(z), wrong.sum()) and np.allclose(total, z[wrong].sum(axis=0))

    points.drop("vector").write.parquet(str(tmp_path / "train"))
    read = []
    monkeypatch.setattr(stages, "fit_one_class", lambda df, *_: read.extend(df.inputFiles()) or model)
    stages.anomaly_pipelines(spark.read.parquet(str(tmp_path / "train")), ["x0", "x1", "x2"], "id", trees=5)
    assert read and not [f for f in read if "/train/" in f]


def test_split_keeps_label_shares(points):
    s = prepare.stratified_split(points, "id").groupBy("Label", "is_test").count().toPandas()
    counts = {(r.Label, r.is_test): r["count"] for _, r in s.iterrows()}
    assert counts == {("plain", True): 120, ("plain", False): 480, ("odd", True): 4, ("odd", False): 16}


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(5)
    rows = [(int(y), float(np.round(y * 0.3 + rng.normal(), 1))) for y in rng.integers(0, 2, 500)]
    df = spark.createDataFrame(rows, "label int, score double")
    ours = evaluate.mean_auc(df, "label", F.array(-F.col("score"), F.col("score"))).first()[0]
    up, down = [s for y, s in rows if y], [s for y, s in rows if not y]
    assert ours == pytest.approx(sum((a > b) + (a == b) / 2 for a in up for b in down) / len(up) / len(down))
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert ours == pytest.approx(theirs, abs=1e-3)


def test_classifier_is_saved_with_its_scaling_and_loaded_by_name(spark, points):
    columns = ["x0", "x1", "x2"]
    model = c.fit(points, columns, c.random_forest(numTrees=5, maxDepth=4))
    folder = run_dir(spark, "models")
    registry.save_models(spark, folder, {"random_forest": model}, columns)
    loaded = registry.load_model(spark, folder, "random_forest")
    hits = loaded.transform(points).select((registry.label_of(loaded) == F.col("Label")).cast("int").alias("hit")).agg(F.avg("hit")).first()[0]
    assert hits > 0.98
    with pytest.raises(ValueError):
        registry.load_model(spark, folder, "absent")


def test_nested_search_scores_prefixes_as_mllib_does(spark):
    """All points of a grid from one fit for each other axis; the prefixes' predictions are those of smaller models."""
    rows = [(i, float(i % 7), float(i % 5), float(i % 11), "attack" if (i % 7 >= 3) != (i % 5 >= 2) else "normal") for i in range(700)]
    df = spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, Label string")
    columns = ["x0", "x1", "x2"]
    found, best = nested_search(df, columns, c.random_forest(), {"numTrees": [1, 20], "maxDepth": [1, 8], "minInstancesPerNode": [1, 2]}, "id", max_rows=400)
    scores = {settings_text(s): a for s, a in found}
    assert len(scores) == 8 and scores["maxDepth=8,minInstancesPerNode=1,numTrees=20"] > 0.95 > 0.8 > scores["maxDepth=1,minInstancesPerNode=1,numTrees=20"]
    assert c.predict(best, df).filter(registry.label_of(best) != F.col("Label")).count() < 20
    found, _ = nested_search(df, columns, c.gradient_boosting(2), {"maxIter": [2, 12], "maxDepth": [4]}, "id")
    assert [s["maxIter"] for s, _ in found] == [2, 12] and found[1][1] > 0.95
    prepared = c.prepared_by(df, columns).transform(df)
    for estimator, sizes in ((c.random_forest(numTrees=9, maxDepth=5), [9]), (c.gradient_boosting(2, maxIter=6, maxDepth=3), [6])):
        model = estimator.fit(prepared)
        table = tree_table(spark, model, 2 if sizes == [9] else 0)
        vectors = np.array([r[0].toArray() for r in prepared.select("features").orderBy("id").collect()])
        theirs = [r[0] for r in model.transform(prepared).orderBy("id").select("prediction").collect()]
        assert table.predictions(vectors, sizes)[0].tolist() == [int(t) for t in theirs]


def repeated(spark, copies):
    rows = spark.range(700 * copies).withColumn("k", F.col("id") % 700)
    label = F.when((F.col("k") % 7 >= 3) != (F.col("k") % 5 >= 2), "attack").otherwise("normal")
    return rows.select("id", *[(F.col("k") % n).cast("double").alias(f"x{i}") for i, n in enumerate((7, 5, 11))], label.alias("Label"))


def test_boosting_search_runs_few_jobs_and_agrees_with_mllib(spark):
    """Rounds cost no job, and the accuracies are those of MLlib's boosting on the same folds."""
    df, columns = repeated(spark, 1).withColumn("x2", F.col("x2") + F.rand(3)), ["x0", "x1", "x2"]
    spark.sparkContext.setJobGroup("boosting-search", "")
    grid = {"maxIter": [1, 20], "maxDepth": [2, 4], "stepSize": [0.1]}
    found, _ = nested_search(df, columns, c.gradient_boosting(2, maxIter=1), grid, "id")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting-search"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 250  # the rest belongs to the one fit on all rows
    for settings, accuracy in found:
        search, _ = c.grid_search(df, columns, c.gradient_boosting(2), {n: [v] for n, v in settings.items()}, "id")
        assert accuracy == pytest.approx(search.avgMetrics[0], abs=0.03)


SEARCHES = [(lambda: c.random_forest(), {"numTrees": [1, 2], "maxDepth": [1, 2]}), (lambda: c.gradient_boosting(2), {"maxIter": [1, 2], "maxDepth": [1]})]


@pytest.mark.parametrize("estimator, grid", SEARCHES, ids=["forest", "boosting"])
@pytest.mark.parametrize("cells", [nested_search_module.TASK_CELLS, 0], ids=["tasks", "cluster"])
def test_search_counts_every_row(spark, monkeypatch, estimator, grid, cells):
    """With a label that no feature tells, every point is right for the plain rows of each fold: of all 24,000, ids or none."""
    monkeypatch.setattr(nested_search_module, "TASK_CELLS", cells)
    row = F.when(F.col("id") % 1000 != 7, F.col("id"))
    df = spark.range(24_000).select(row.alias("row"), (F.col("id") % 2).cast("double").alias("x0"), (F.col("id") % 3).cast("double").alias("x1"),
                                    F.when(F.xxhash64("id") % 10 == 0, "odd").otherwise("plain").alias("Label"))
    folds = prepare.fold_numbers(df, "row").groupBy(F.coalesce("fold", F.lit(0)).alias("fold")).agg(F.avg((F.col("Label") == "plain").cast("double")).alias("share"))
    share = folds.agg(F.avg("share")).first()[0]
    found, _ = nested_search(df, ["x0", "x1"], estimator(), grid, "row")
    assert len(found) == len(list(itertools.product(*grid.values())))
    assert [a for _, a in found] == pytest.approx([share] * len(found), abs=1e-12)


def test_registered_searches_ask_for_all_rows(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(models, "nested_search", lambda *a, **k: asked.append(k) or ([({"n": 1}, 1.0)], None))
    monkeypatch.setattr(models, "ready", lambda *_: (spark.range(1), []))
    for name in ("r10_forest_search", "r11_boosting_search"):
        QUERIES[name](spark, "")
    assert len(asked) == 2 and all(k.get("max_rows") is None for k in asked)


def test_search_in_tasks_agrees_with_the_cluster(spark, monkeypatch):
    """The same accuracies, up to other draws, whether a task fits all different rows or MLlib does."""
    noise = F.xxhash64("id") % 8 == 0
    df, columns = repeated(spark, 4).withColumn("x2", F.col("x2") + F.rand(3)), ["x0", "x1", "x2"]
    df = df.withColumn("Label", F.when(noise, "attack").otherwise(F.col("Label")))
    grid = {"numTrees": [5, 30], "maxDepth": [2, 5], "minInstancesPerNode": [1, 20]}
    tasks = nested_search(df, columns, c.random_forest(), grid, "id")[0]
    monkeypatch.setattr(nested_search_module, "TASK_CELLS", 0)
    cluster = nested_search(df, columns, c.random_forest(), grid, "id")[0]
    assert [s for s, _ in tasks] == [s for s, _ in cluster] and tasks[-1][1] > 0.85
    large = [i for i, (s, _) in enumerate(tasks) if s["numTrees"] == 30]
    assert [tasks[i][1] for i in large] == pytest.approx([cluster[i][1] for i in large], abs=0.04)


def test_alike_rows_are_fitted_as_one_with_their_weight(spark, monkeypatch):
    """300 times as many rows cost a fit no more rows, all of them count, and no task gets more than its share."""
    columns = ["x0", "x1", "x2"]
    few, many = repeated(spark, 1), repeated(spark, 300)
    scaled = many.withColumn(prepare.LABEL_INDEX, (F.col("Label") == "attack").cast("double"))
    bins = prepare.bin_stage(scaled, columns, 32)
    names, total = bins.getOutputCols(), 700 * 300
    whole = prepare.alike_rows(bins.transform(scaled), names, total, drawn=False)
    assert whole.count() <= 700 and whole.agg(F.sum(prepare.WEIGHT)).first()[0] == total
    assert prepare.alike_rows(bins.transform(scaled), names, total, drawn=True).count() == total
    monkeypatch.setattr(prepare, "LOTS", 2_000)
    monkeypatch.setattr(prepare, "TASK_ROWS", 500)
    lots = prepare.alike_rows(bins.transform(scaled), names, total, drawn=True)
    assert lots.count() <= 2_000 + 700 and lots.agg(F.max(prepare.WEIGHT)).first()[0] <= 105
    assert lots.agg(F.sum(prepare.WEIGHT)).first()[0] == pytest.approx(total)
    held = [r["count"] for r in lots.groupBy(F.spark_partition_id()).count().collect()]
    assert max(held) <= 510 and len(held) >= 4
    for estimator in (c.random_forest(numTrees=20, maxDepth=8), c.gradient_boosting(2, maxIter=5, maxDepth=4),
                      c.sampled_boosting(2, maxIter=5, maxDepth=4), c.gradient_boosting(3, maxIter=3, maxDepth=4)):
        model = c.fit(many, columns, estimator)
        assert c.predict(model, few).filter(registry.label_of(model) != F.col("Label")).count() == 0


def test_bins_keep_rare_values_apart(spark):
    """A value of one row in a thousand decides the label; quantiles alone would put it into its neighbour's bin."""
    df = spark.range(4000).select("id", F.when(F.col("id") % 1000 == 7, 1.0).otherwise(F.when(F.col("id") % 3 == 0, 0.0).otherwise(2.0)).alias("x"),
                                  F.lit(5.0).alias("constant"), (F.col("id") * 0.5).alias("spread"))
    df = df.withColumn("Label", F.when(F.col("x") == 1.0, "rare").otherwise("plain"))
    model = c.fit(df, ["x", "constant", "spread"], c.gradient_boosting(2, maxIter=3, maxDepth=3))
    assert c.predict(model, df).filter(registry.label_of(model) != F.col("Label")).count() == 0


def test_all_models_of_a_run_are_loaded_by_name_and_score(spark, points):
    folder = run_dir(spark, "training")
    small = {"numTrees": 5, "maxDepth": 4}
    train_all(points.drop("vector"), "id", folder, forest=small, boosting={"maxIter": 3, "maxDepth": 3}, trees=30, search_rows=500,
              forest_grid={"numTrees": [2, 4], "maxDepth": [3]}, boosting_grid={"maxIter": [2], "maxDepth": [2]})
    listed = registry.model_table(spark, folder).collect()
    assert len(listed) == 7 and {r["kind"] for r in listed} == {"prediction", "decision"}
    for row in listed:
        model = registry.load_model(spark, folder, row["name"])
        scored = model.transform(points)
        assert scored.filter(F.col(row["kind"]).isNull()).isEmpty()
        if row["kind"] == "decision":
            again = decision_scorer(model)(points)
            assert again.columns == [*points.columns, "_anomaly"]
            outer, inner = (again.filter(f"Label = '{x}'").agg(F.avg("_anomaly")).first()[0] for x in ("odd", "plain"))
            assert outer > inner
    assert registry.list_models(spark, folder).filter("load_seconds is null").isEmpty()


def test_scores_crowded_at_one_end_are_spread(spark):
    """All scores lie in [0.999, 1]; no slice holds more than its target and the area is exact."""
    rng = np.random.default_rng(8)
    rows = [(int(k), 0.999 + float(s) / 1000, int(p)) for k, s, p in zip(rng.integers(0, 2, 6000), rng.random(6000), rng.integers(0, 2, 6000))]
    df = spark.createDataFrame(rows, "class int, score double, positive int")
    sliced, _ = sliced_totals(df.withColumn("v", F.lit(1)), ["class"], ["score"], ["v"], 1, slice_rows=300)
    sizes = [r["count"] for r in sliced.groupBy("_key").count().collect()]
    assert max(sizes) <= 300 and len(sizes) >= 20
    got = {r["class"]: r["auc"] for r in evaluate.class_auc(df, slice_rows=300).collect()}
    for k in (0, 1):
        up, down = (np.array([s for c_, s, p in rows if c_ == k and p == y]) for y in (1, 0))
        assert got[k] == pytest.approx((up[:, None] > down[None, :]).mean())


def test_split_reads_a_written_table(spark, folder, monkeypatch):
    """The labelled records are derived once, not again by every step of the split."""
    from tidewarden.catalog import QUERIES, models

    read, original = [], prepare.stratified_split
    monkeypatch.setattr(prepare, "stratified_split", lambda df, *args: read.extend(df.inputFiles()) or original(df, *args))
    train, test, _ = models.split(spark, folder)
    assert read and not any("events" in name for name in read)
    assert train.count() + test.count() == spark.read.parquet(f"{folder}/events.parquet").count()
