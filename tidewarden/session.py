"""Session settings and the two helpers every distributed operator leans on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after a count proves it has at most this many rows.
BROADCAST_ROWS = 100_000


def build_session(master: str = "local[8]", app: str = "tidewarden", **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; cluster settings come from spark-submit."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master without the setting gets a temporary folder, which is the test case.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="tidewarden-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def run_dir(spark: SparkSession, kind: str) -> str:
    """A fresh folder under the shared one, for one stream's output or checkpoint."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write to a table in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and later steps read only the columns they need and see
    the true size.
    """
    path = run_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a bounded count proves the size; otherwise leave the join to AQE."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def broadcast_or_merge(df: DataFrame, max_rows: int = BROADCAST_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """The same, but a larger side is sorted and merged, and so is what it is joined with.

    Spark takes what is read or exploded from a written table for about as large as the file, where rows may be many
    times more, and broadcasts up to ten megabytes of that. ``counted`` has the rows of ``df`` or more and costs less.
    """
    rows = (df if counted is None else counted).limit(max_rows + 1).count()
    return F.broadcast(df) if rows <= max_rows else df.hint("merge")
