"""Sharding along a Hilbert curve over several metadata dimensions.

Three dimensions (source, language, length) are quantised to ``LEVELS`` steps each, so that a step holds about as many
rows as another; names are ranked whole, in string order, by the rows that come before them; the curve's index of the cell orders the rows, ties by a hash of the id. The order is cut into runs
of equal row counts (law ``rows``), so a shard covers a small box of metadata and files can be pruned by several
dimensions at once.

Ranks are exact without sorting in one place: rows are counted by (cell, part of the hash), the counts are summed along
the curve in two small steps, and only then rows are numbered within their part. A cell with a third of all rows has as
many parts as the row count asks for. Only ids and numbers move, never texts.

Defined cases: null or empty values are the first step of their dimension; a null text has size 1 and checksum 0; rows without an id are
ordered by the place they were written to; rows that repeat an id are told apart by size and checksum, and else are alike. With
fewer rows than shards the first shards get one each. Very long texts count whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.session import broadcast_if_small, materialize

BITS = 4
LEVELS = 1 << BITS
DIMENSIONS = 3
# Rows of a cell that are numbered together, at the least number of parts.
PART_ROWS = 100_000
MIN_PARTS = 64
# Text of one written file, if the caller names no number of files.
FILE_BYTES = 1 << 30
ROW_BITS = 33  # of a generated row number: its place in the partition


def hilbert_index(point: list[int], bits: int = BITS) -> int:
    """The place of a cell on the Hilbert curve through ``len(point)`` dimensions of ``bits`` bits.

    From the highest bit down, each dimension's lower bits are turned or swapped with the first dimension's as the
    curve's orientation asks; the Gray code of what is left, read across the dimensions, is the index.
    """
    x = list(point)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= low
            else:
                turned = (x[0] ^ x[i]) & low
                x[0] ^= turned
                x[i] ^= turned
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turned, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            turned ^= q - 1
        q >>= 1
    x = [v ^ turned for v in x]
    index = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | (v >> b & 1)
    return index


def curve(spark) -> DataFrame:
    """``point`` (the dimensions as one number) -> ``cell``: LEVELS ** DIMENSIONS rows, whatever the data."""
    rows = [(p, hilbert_index([p >> (BITS * d) & (LEVELS - 1) for d in range(DIMENSIONS)])) for p in range(LEVELS**DIMENSIONS)]
    return spark.createDataFrame(rows, "point int, cell int")


def _value_steps(rows: DataFrame, name: str) -> DataFrame:
    """``name`` and ``step`` of each distinct value: its place among all rows in the values' order, in ``LEVELS`` steps.

    Values are counted first; their running counts come from ranges of values and the ranges' sums.
    """
    counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    sorted_ = materialize(counts.repartitionByRange(name).sortWithinPartitions(name).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", ROW_BITS).alias("_part")
    sums = sorted_.groupBy(part).agg(F.sum("_n").alias("_n"))  # one row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sorted_.select(name, "_n", "_at", part).withColumn("_in", inside).join(sums.select("_part", before.alias("_before")), "_part")
    total = rows.count()
    return placed.select(name, F.floor((F.col("_before") + F.col("_in")) * LEVELS / F.lit(max(total, 1))).cast("int").alias("step"))


def _steps(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace each number by its step: how many of the dimension's distinct quantiles are at most it, less one."""
    shares = [i / LEVELS for i in range(LEVELS)]
    found = df.agg(*[F.percentile_approx(n, shares, 10_000).alias(n) for n in names]).first()
    out = df
    for n in names:
        cuts = sorted(set(found[n] or []))[1:]
        out = out.withColumn(n, F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(n))) if cuts else F.lit(0))
    return out


def placed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``cell`` and ``h``, the hash that orders a cell; one scan of the texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(d) for c, d in (("source", "d0"), ("lang", "d1"))],
        F.octet_length(body).cast("double").alias("d2"),
    )
    slim = materialize(slim.withColumn("row", F.monotonically_increasing_id()))
    stepped = _steps(slim, ["d2"])
    for name in ("d0", "d1"):
        steps = broadcast_if_small(_value_steps(slim.select(name), name))
        stepped = stepped.join(steps, name).drop(name).withColumnRenamed("step", name)
    point = F.col("d0") + F.col("d1") * LEVELS + F.col("d2") * LEVELS * LEVELS
    own = F.xxhash64("doc_id", "text_crc32")
    h = F.when(F.col("doc_id").isNull(), F.xxhash64("row", "text_crc32")).otherwise(own)  # copies without an id are spread
    with_point = stepped.withColumn("point", point.cast("int")).withColumn("h", h)
    return with_point.join(F.broadcast(curve(docs.sparkSession)), "point").select("doc_id", "size", "text_crc32", "cell", "h")


def ranked(rows: DataFrame) -> DataFrame:
    """Add ``rank``, from 0 without gaps, in the order of (cell, h, doc_id), and the row count ``total``."""
    rows = materialize(rows)
    total = rows.count()
    parts = max(MIN_PARTS, 1 << max(0, (-(-total // PART_ROWS) - 1).bit_length()))
    # the hash's upper bits, shifted so that the order of parts is the order of hashes
    part = F.shiftright("h", 64 - (parts.bit_length() - 1))
    parted = rows.withColumn("part", part)
    counts = parted.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n"))  # at most LEVELS ** DIMENSIONS rows
    curve_order = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("cell", F.coalesce(F.sum("n").over(curve_order), F.lit(0)).alias("before"))
    starts = counts.select("cell", "part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("within")).join(
        F.broadcast(offsets), "cell").select("cell", "part", (F.col("before") + F.col("within")).alias("start"))
    own = Window.partitionBy("cell", "part").orderBy("h", "doc_id", "size", "text_crc32")
    numbered = parted.withColumn("place", F.row_number().over(own) - 1)
    return numbered.join(starts, ["cell", "part"]).select(
        *rows.columns, (F.col("start") + F.col("place")).alias("rank"), F.lit(total).cast("long").alias("total"))


def sharded(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``text_crc32``, ``cell``, ``shard``, ``slot``, ``shard_rows``.

    Shard k holds the ranks from k * total / shards on, rounded up: row counts differ by one at most.
    """
    rows = ranked(placed(docs, doc_id, text))
    shard = F.floor(F.col("rank") * shards / F.col("total")).cast("int")
    exact = F.when(F.col("rank") < F.ceil(shard * F.col("total") / shards), shard - 1).when(
        F.col("rank") >= F.ceil((shard + 1) * F.col("total") / shards), shard + 1).otherwise(shard)
    first, after = (F.ceil((F.col("shard") + k) * F.col("total") / shards) for k in (0, 1))
    return rows.withColumn("shard", exact.cast("int")).select(
        "doc_id", "size", "text_crc32", "cell", "shard", (F.col("rank") - first).cast("long").alias("slot"),
        (after - first).cast("long").alias("shard_rows"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, files: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as Parquet, a folder for each shard and in it one for each run of the curve; returns the shards' boxes.

    A shard is written as ``files`` runs, or as many as hold about ``FILE_BYTES`` of text each. The boxes (smallest and
    largest source, language and length for each shard) tell which files a reader can skip. Ids must be unique; rows with
    a null id go to the first shard, spread over its runs.
    """
    placed_rows = materialize(sharded(docs, shards, doc_id, text).select(
        F.col("doc_id").alias("own_id"), "shard", F.floor(F.col("slot") / F.col("shard_rows") * F.lit(1 << 30)).alias("share"), "slot", "size"))
    if files is None:
        files = max(1, -(-(placed_rows.agg(F.sum("size")).first()[0] or 0) // (shards * FILE_BYTES)))
    where = placed_rows.filter("own_id is not null").drop("size")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("twin"))
    joined = rows.join(where, F.col("id") == F.col("own_id"), "left")
    run = F.coalesce(F.shiftright(F.col("share") * files, 30), F.pmod("twin", F.lit(files)))
    dealt = joined.select("row", F.coalesce("shard", F.lit(0)).alias("shard"), F.coalesce("slot", F.lit(-1)).alias("slot"), run.cast("int").alias("run"))
    dealt = dealt.repartition("shard", "run").sortWithinPartitions("shard", "run", "slot")
    dealt.select("shard", "run", "row").write.partitionBy("shard", "run").parquet(path)
    written = docs.sparkSession.read.parquet(path)
    return written.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.min("row.source").alias("min_source"), F.max("row.source").alias("max_source"),
        F.min("row.lang").alias("min_lang"), F.max("row.lang").alias("max_lang"),
        F.min(F.octet_length(f"row.{text}")).alias("min_size"), F.max(F.octet_length(f"row.{text}")).alias("max_size"))
