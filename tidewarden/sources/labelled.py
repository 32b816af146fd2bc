"""Labelled training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, label: str = "Label") -> list[str]:
    """The feature columns, in table order."""
    return [f.name for f in df.schema.fields if f.name != label and isinstance(f.dataType, T.NumericType)]


def fill_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL and NaN become 0."""
    real = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({
        c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)) if c in real else F.col(c), F.lit(0)) for c in columns
    })


def training_table(df: DataFrame, label: str = "Label", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, the label and the numeric columns, without missing values."""
    if label not in df.columns:
        raise ValueError(f"column {label} not found")
    columns = [c for c in numeric_columns(df, label) if c not in keep]
    return fill_missing(df.select(*keep, label, *columns), columns)


def read_labelled_csv(spark: SparkSession, path: str, label: str = "Label", schema: T.StructType | None = None) -> DataFrame:
    """A CSV with header. Give the schema where it is known: inferring it reads the file twice."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return training_table(reader.csv(path), label)


def table_shape(df: DataFrame, label: str = "Label") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("num_rows"), F.lit(len(numeric_columns(df, label))).alias("num_features"),
        F.count_distinct(label).alias("num_labels"),
    )
