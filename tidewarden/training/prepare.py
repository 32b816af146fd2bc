"""Scaling, label codes and the stratified split."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.operators.running import running_totals
from tidewarden.session import materialize

SEED = 42
TEST_SHARE = 0.2
HASH_BITS = 60
HASH_SLICES = 1024
# Not "label": column names ignore case, and the table's own column is "Label".
LABEL_INDEX = "label_index"
# Rows that are alike in every bin and in their label are one row of a fit with this weight.
WEIGHT = "_weight"
# A fit that draws rows (bootstrap, subsampling) draws lots of alike rows, each at most this part of the table.
LOTS = 1_000_000
# Rows of one task in a fit, at most; and at least, where that leaves fewer tasks than cores.
TASK_ROWS = 50_000
MIN_TASK_ROWS = 5_000


def population_moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column in one aggregation; a constant column has deviation 1."""
    row = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 1.0) for i, c in enumerate(columns)}


def scaling_stage(moments: dict[str, tuple[float, float]], prefix: str = "scaled_") -> SQLTransformer:
    """A saved-with-the-model stage that adds the scaled columns, so scoring cannot leave it out."""
    terms = [f"(`{c}` - {mean!r}D) / {dev!r}D AS `{prefix}{c}`" for c, (mean, dev) in moments.items()]
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace columns by their scaled values."""
    moments = population_moments(df, columns)
    return df.withColumns({c: (F.col(c) - mean) / dev for c, (mean, dev) in moments.items()})


def label_codes(df: DataFrame, label: str = "Label") -> DataFrame:
    """Distinct labels in order with codes 0..k-1. Labels are few; their order needs one small task."""
    from pyspark.sql import Window

    distinct = df.select(label).distinct()
    return distinct.withColumn("code", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))


def label_stage(label: str = "Label") -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol=LABEL_INDEX, stringOrderType="alphabetAsc", handleInvalid="keep")


def vector_stage(columns: list[str], prefix: str = "scaled_") -> VectorAssembler:
    return VectorAssembler(inputCols=[prefix + c for c in columns], outputCol="features")


def bin_stage(df: DataFrame, columns: list[str], bins: int, prefix: str = "bin_") -> Bucketizer:
    """The number of each value's bin: its own for up to ``bins`` distinct values, else one of as many quantiles."""
    quantiles = df.approxQuantile(columns, [i / bins for i in range(1, bins)], 0.1 / bins)
    splits = []
    for column, cuts in zip(columns, quantiles):
        few = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(bins + 1).collect()]
        inner = sorted(few)[1:] or few if len(few) <= bins else sorted(set(cuts))
        splits.append([-float("inf"), *(inner or [0.0]), float("inf")])
    return Bucketizer(splitsArray=splits, inputCols=columns, outputCols=[prefix + c for c in columns], handleInvalid="keep")


def alike_rows(binned: DataFrame, columns: list[str], total: int, drawn: bool) -> DataFrame:
    """The bins, the label code and ``WEIGHT`` of rows alike in them: all ``total`` rows, in far fewer where they repeat.

    Without drawing all rows alike are one. With it they are cut into lots of at most a part in ``LOTS`` of the table, so a
    table of up to ``LOTS`` rows is drawn row by row. The rows are dealt to tasks of a bounded number.
    """
    # Without their metadata: trees would take numbered bins for categories without an order.
    plain = [F.col(c).cast("double").alias(c, metadata={}) for c in [*columns, LABEL_INDEX]]
    return dealt_lots(materialize(binned.select(*plain).groupBy(*columns, LABEL_INDEX).agg(F.count(F.lit(1)).alias("_n"))), columns, total, drawn)


def dealt_lots(alike: DataFrame, columns: list[str], total: int, drawn: bool) -> DataFrame:
    """The rows of a fit from a written table of different rows with their number ``_n``."""
    lot = -(-total // LOTS) if drawn else max(total, 1)
    lots = F.ceil(F.col("_n") / lot).cast("int")
    rows = alike.agg(F.sum(lots)).first()[0] or 0
    tasks = max(-(-rows // TASK_ROWS), min(-(-rows // MIN_TASK_ROWS), alike.sparkSession.sparkContext.defaultParallelism), 1)
    return alike.select(*columns, LABEL_INDEX, F.explode(F.array_repeat(F.col("_n") / lots, lots)).alias(WEIGHT)).repartition(tasks)


def hash_order(row_id: str, seed: int = SEED) -> Column:
    """A 60-bit order that any engine can compute: the first 15 hex digits of an md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def stratified_split(
    df: DataFrame, row_id: str, label: str = "Label", share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Add ``is_test``: per label, the first ``share`` of its rows by hash, rounded down.

    Ranks come from sliced running totals, so a label that holds most of the rows is ranked in many tasks.
    """
    slim = df.select(row_id, label).withColumn("_h", hash_order(row_id, seed))
    ranked = running_totals(slim, [label], ["_h", row_id], {"_pos": F.lit(1)}, 2**HASH_BITS // HASH_SLICES)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    marked = ranked.join(sizes, label).select(row_id, (F.col("_pos") <= F.floor(F.col("_n") * share)).alias("is_test"))
    return df.join(marked, row_id)


def fold_numbers(df: DataFrame, row_id: str, folds: int = 3, seed: int = SEED) -> DataFrame:
    return df.withColumn("fold", F.pmod(hash_order(row_id, seed + 1), F.lit(folds)).cast("int"))
