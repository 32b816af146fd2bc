"""Grid search over all labelled rows in which the size of an ensemble costs no fit of its own.

For every fold and every point of the other axes one ensemble is fitted at the largest size; the smaller ones are its
first trees, and all sizes are scored in one pass over the held-out fold. Boosting with fewer rounds is exactly such a
prefix; a prefix of a forest is a forest of so many trees, grown from other draws than a smaller fit would make.

As in a fit (``classifiers.fit``), trees see a row by the bins of its values, which are taken from all rows of the search, and
rows alike in bins and label are one row with their number in each fold. No row is left out. Where the different rows
are few enough for one task (``TASK_CELLS``), every fit is a task (``small_boosting``, ``small_forest``; a forest's depths come
from one growth too), because MLlib runs jobs for every level of its trees. Where they are more, MLlib fits them on the cluster;
its ensembles are read from where it saves them, as a table of nodes, which goes to the tasks that score.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.session import materialize, run_dir
from tidewarden.training.classifiers import checkpointing, fit, prepared_by, weighted
from tidewarden.training.prepare import LABEL_INDEX, bin_stage, dealt_lots, fold_numbers, hash_order
from tidewarden.training.small_boosting import boosted_hits
from tidewarden.training.small_forest import forest_votes

# Bins of the different rows of a table, rows times columns, that one task takes whole.
TASK_CELLS = 4_000_000
# Rows of the MLlib fits that run at a time, at least one fit.
ROWS_AT_ONCE = 400_000


class TreeTable:
    """An ensemble's nodes as arrays, tree after tree; ``votes`` holds what a row in a node adds to each class's score."""

    def __init__(self, nodes: pd.DataFrame, weights: np.ndarray, classes: int):
        nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
        self.roots = np.searchsorted(nodes["tree"], np.arange(len(weights)))
        first = self.roots[nodes["tree"]]
        self.feature, self.cut = nodes["feature"].to_numpy(), nodes["cut"].to_numpy()
        self.left, self.right = (np.where(nodes[n] >= 0, nodes[n] + first, 0) for n in ("left", "right"))
        if classes:  # a forest: shares of the classes in a leaf
            counts = np.stack(nodes["counts"].to_numpy())[:, :classes]
            self.votes = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300)
        else:  # boosting: a margin for class 1
            margin = nodes["prediction"].to_numpy() * weights[nodes["tree"]]
            self.votes = np.stack([np.zeros(len(margin)), margin], axis=1)

    def predictions(self, rows: np.ndarray, sizes: list[int]) -> np.ndarray:
        """By size and row, the class that the first so many trees give."""
        score, out = np.zeros((len(rows), self.votes.shape[1])), []
        every = np.arange(len(rows))
        for done, root in enumerate(self.roots, start=1):
            at = np.full(len(rows), root)
            while True:
                inner = self.feature[at] >= 0
                if not inner.any():
                    break
                goes_left = rows[every, np.maximum(self.feature[at], 0)] <= self.cut[at]
                at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
            score += self.votes[at]
            if done in sizes:
                out.append(score.argmax(axis=1))
        return np.array(out)


def tree_table(spark: SparkSession, model, classes: int) -> TreeTable:
    """The saved form of a fitted ensemble: at most its number of trees times the nodes of one."""
    path = run_dir(spark, "ensemble")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.impurityStats").alias("counts"), F.col("nodeData.split.featureIndex").alias("feature"),
        F.coalesce(F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0)).alias("cut"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right")).toPandas()
    return TreeTable(nodes, np.array(model.treeWeights), classes)


def hits(held: DataFrame, table: TreeTable, sizes: list[int]) -> list[float]:
    """The accuracy of each size on the held-out rows (``v``, label, ``_n`` of each), in one pass."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = table.predictions(np.stack(batch["v"].to_numpy()), sizes)
                right = (found == batch[LABEL_INDEX].to_numpy()[None, :]) @ batch["_n"].to_numpy()
                yield pd.DataFrame({"size": sizes, "right": right, "rows": batch["_n"].sum()})

    summed = held.select("v", LABEL_INDEX, "_n").mapInPandas(count, "size long, right long, rows long")
    found = {r["size"]: r["r"] / r["n"] for r in summed.groupBy("size").agg(F.sum("right").alias("r"), F.sum("rows").alias("n")).collect()}
    return [found.get(s, 0.0) for s in sizes]


def alike_folds(binned: DataFrame, columns: list[str], folds: int) -> DataFrame:
    """The bins and label of rows alike in them, and how many of them each fold has: ``n0``, ``n1`` and so on."""
    numbers = [F.count(F.when(F.col("fold") == f, 1)).alias(f"n{f}") for f in range(folds)]
    plain = [F.col(c).cast("double").alias(c, metadata={}) for c in [*columns, LABEL_INDEX]]  # bins are no categories
    return materialize(binned.select(*plain, "fold").groupBy(*columns, LABEL_INDEX).agg(*numbers))


def gathered(alike: DataFrame, columns: list[str], folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, label and numbers by fold of all different rows, ordered; at most ``TASK_CELLS`` bins."""
    found = alike.toPandas().sort_values([*columns, LABEL_INDEX])
    return found[columns].to_numpy().astype(np.int16), found[LABEL_INDEX].to_numpy().astype(np.int64), found[[f"n{f}" for f in range(folds)]].to_numpy()


def boosting_jobs(
    spark: SparkSession, rows: np.ndarray, label: np.ndarray, numbers: np.ndarray, estimator: GBTClassifier, points: list[dict], sizes: list[int]
) -> list[list[float]]:
    """The accuracies of ``sizes`` for every point and fold, each a task that fits on all rows of the other folds."""
    shared = spark.sparkContext.broadcast((rows, label, numbers))
    fixed = {"least": estimator.getMinInstancesPerNode(), "rate": estimator.getSubsamplingRate(), "seed": estimator.getSeed() & (1 << 63) - 1}
    jobs = [(i, p.get("maxDepth", estimator.getMaxDepth()), p.get("stepSize", estimator.getStepSize()), fold)
            for i, (p, fold) in enumerate(itertools.product(points, range(numbers.shape[1])))]

    def work(job: tuple) -> tuple[int, list[float]]:
        number, depth, step, fold = job
        rows, label, numbers = shared.value
        held, others = numbers[:, fold], numbers.sum(axis=1) - numbers[:, fold]
        h, o = held > 0, others > 0
        return number, boosted_hits(rows[o], label[o], others[o], rows[h], label[h], held[h], sizes, depth, step, **fixed)

    found = dict(spark.sparkContext.parallelize(jobs, len(jobs)).map(work).collect())
    return [found[i] for i in range(len(jobs))]


def forest_jobs(
    spark: SparkSession, rows: np.ndarray, label: np.ndarray, numbers: np.ndarray, estimator: RandomForestClassifier, points: list[dict],
    sizes: list[int], classes: int
) -> list[list[float]]:
    """The accuracies of ``sizes`` for every point and fold. The trees between two sizes are a task, for all depths at once."""
    shared = spark.sparkContext.broadcast((rows, label, numbers))
    least_of = [p.get("minInstancesPerNode", estimator.getMinInstancesPerNode()) for p in points]
    depth_of = [p.get("maxDepth", estimator.getMaxDepth()) for p in points]
    depths, columns = sorted(set(depth_of)), rows.shape[1]
    fixed = {"classes": max(classes, int(label.max()) + 1), "rate": estimator.getSubsamplingRate(), "seed": estimator.getSeed() & (1 << 63) - 1,
             "tried": columns if sizes[-1] == 1 else int(np.ceil(np.sqrt(columns)))}
    spans = [range(a, b) for a, b in zip([0, *sizes], sizes)]
    jobs = [(least, fold, k) for least in sorted(set(least_of)) for fold in range(numbers.shape[1]) for k in range(len(spans))]

    def work(job: tuple) -> tuple[tuple, tuple]:
        least, fold, k = job
        rows, label, numbers = shared.value
        held, others = numbers[:, fold], numbers.sum(axis=1) - numbers[:, fold]
        o = others > 0
        return (least, fold), (k, forest_votes(rows[o], label[o], others[o], rows[held > 0], spans[k], depths, least=least, **fixed))

    def scored(item: tuple) -> tuple[tuple, list]:
        (least, fold), parts = item
        _, label, numbers = shared.value
        held, votes, out = numbers[:, fold], 0.0, []
        h = held > 0
        for _, more in sorted(parts, key=lambda x: x[0]):
            votes = votes + more.astype(np.float64)
            right = votes[:, :, :classes].argmax(axis=2) == label[h]
            out.append((right @ held[h] / max(held.sum(), 1)).tolist())
        return (least, fold), out

    found = dict(spark.sparkContext.parallelize(jobs, len(jobs)).map(work).groupByKey().map(scored).collect())
    return [[by_depth[depths.index(depth)] for by_depth in found[least, fold]]
            for least, depth in zip(least_of, depth_of) for fold in range(numbers.shape[1])]


def cluster_jobs(
    alike: DataFrame, columns: list[str], folds: int, estimator: RandomForestClassifier | GBTClassifier, points: list[dict], nested: str,
    sizes: list[int], classes: int, parallelism: int
) -> list[list[float]]:
    """The same by MLlib, whose fits see the rows of the other folds by their weights in many tasks."""
    spark = alike.sparkSession
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    drawn = bool(classes) or estimator.getSubsamplingRate() < 1.0
    ready, totals, most = [], [], 1
    for fold in range(folds):
        held = alike.filter(F.col(f"n{fold}") > 0).withColumn("_n", F.col(f"n{fold}"))
        others = alike.withColumn("_n", sum((F.col(f"n{f}") for f in range(folds) if f != fold), F.lit(0))).filter("_n > 0")
        totals.append(others.agg(F.sum("_n")).first()[0] or 0)
        rows = materialize(assembler.transform(dealt_lots(others, columns, totals[-1], drawn)))
        most = max(most, rows.count())
        ready.append((rows, assembler.transform(held).withColumn("v", vector_to_array("features"))))

    def run(job: tuple[dict, int]) -> list[float]:
        point, fold = job
        settings = {estimator.getParam(n): v for n, v in {**point, nested: sizes[-1]}.items()}
        fitted = weighted(estimator.copy(settings), totals[fold]).fit(ready[fold][0])
        return hits(ready[fold][1], tree_table(spark, fitted, classes), sizes)

    with ThreadPool(max(1, min(parallelism, ROWS_AT_ONCE // most))) as pool:
        return pool.map(inheritable_thread_target(spark)(run), list(itertools.product(points, range(folds))), chunksize=1)


def fits_in_tasks(estimator: RandomForestClassifier | GBTClassifier, others: set[str]) -> bool:
    """Whether the arrays' fits know all the settings; if not, MLlib fits, whatever the number of rows."""
    if isinstance(estimator, GBTClassifier):
        return others <= {"maxDepth", "stepSize"} and estimator.getFeatureSubsetStrategy() == "all" and not estimator.isDefined("validationIndicatorCol")
    return (others <= {"maxDepth", "minInstancesPerNode"} and estimator.getFeatureSubsetStrategy() == "auto" and estimator.getImpurity() == "gini"
            and estimator.getBootstrap())


def nested_search(
    train: DataFrame, columns: list[str], estimator: RandomForestClassifier | GBTClassifier, grid: dict[str, list], row_id: str,
    label: str = "Label", folds: int = 3, parallelism: int = 4, max_rows: int | None = None,
) -> tuple[list[tuple[dict, float]], PipelineModel]:
    """(settings, mean accuracy) of every grid point, and the best one fitted on all of ``train`` with its scaling and label stages.

    All rows are searched, unless a caller asks for ``max_rows`` of them. A row without an id is in the first fold. Ties go to
    the point that comes first in the grid. Boosting takes two classes.
    """
    spark = train.sparkSession
    checkpointing(spark)
    scaling, vector, codes = prepared_by(train, columns, label).stages
    searched = train if max_rows is None else train.orderBy(hash_order(row_id), row_id).limit(max_rows)
    folded = fold_numbers(searched, row_id, folds).withColumn("fold", F.coalesce("fold", F.lit(0)))
    scaled = codes.transform(scaling.transform(folded))
    bins = bin_stage(scaled, vector.getInputCols(), estimator.getMaxBins())
    names = bins.getOutputCols()
    alike = alike_folds(bins.transform(scaled), names, folds)
    classes = 0 if isinstance(estimator, GBTClassifier) else len(codes.labels)
    nested = "maxIter" if not classes else "numTrees"
    sizes = sorted(set(grid[nested]))
    others = {n: v for n, v in grid.items() if n != nested}
    points = [dict(zip(others, values)) for values in itertools.product(*others.values())]
    different = alike.count()
    if not different:
        found = [[0.0] * len(sizes)] * (len(points) * folds)
    elif different * len(names) > TASK_CELLS or not fits_in_tasks(estimator, set(others)):
        found = cluster_jobs(alike, names, folds, estimator, points, nested, sizes, classes, parallelism)
    elif classes:
        found = forest_jobs(spark, *gathered(alike, names, folds), estimator, points, sizes, classes)
    else:
        found = boosting_jobs(spark, *gathered(alike, names, folds), estimator, points, sizes)
    means = np.array(found).reshape(len(points), folds, len(sizes)).mean(axis=1)
    results = [({**p, nested: s}, float(means[i, k])) for i, p in enumerate(points) for k, s in enumerate(sizes)]
    best = max(results, key=lambda r: r[1])[0]
    return results, fit(train, columns, estimator.copy({estimator.getParam(n): v for n, v in best.items()}), label)


def settings_text(settings: dict) -> str:
    return ",".join(f"{n}={v}" for n, v in sorted(settings.items()))
