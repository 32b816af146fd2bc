"""Target-distribution importance resampling over hashed word runs.

Every run of one to three words falls into one of ``BUCKETS`` buckets by its checksum. Bucket counts of the corpus and
of a target corpus are summed as arrays in the scan and added in two steps; a bucket's gain is the scaled logarithm of
its smoothed share in the target over that in the corpus. A second scan adds each document's gains, and a Gumbel number
drawn from its id turns the largest scores into a sample without replacement.

The drawn documents are found without sorting the corpus: over the written scores, the cutoff score is halved in by jobs
that count exactly, then the cutoff id among documents of that score, then the cutoff row among rows of that score
and id. Only drawn rows are sorted, by ranges, and ranked by their place in a range plus the ranges before it.

Checksums of runs come from those of their words, so no run is built. What reaches the driver are bucket arrays and counts.

Defined cases: a null or empty text has no words, weight 0, and can't be drawn unless ``min_words`` is 0; equal scores
go to the smaller id, a null id first, and rows with one id and score in the order in which they were written. A null
id is drawn as ``<seed>:``. Very long texts are read whole. Extra columns play no part. With an empty table nothing is
drawn; an empty target counts as 0 in every bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.llm.checksums import checksums, joined
from tidewarden.llm.words import bytes_of, slices, texts_from, word_spans
from tidewarden.session import materialize

BUCKETS = 10_000
LONGEST_RUN = 3
SEED = 42
PERCENT = 5
MIN_WORDS = 20
STEP = 4 << 20
FIRST_STEP = 1024
HALVINGS = 4  # done by one counting job
INDEX_BITS = 33  # of a generated row number: its place in the partition

# A-Z become a-z; other ASCII that is no letter or digit parts words.
WORD_BYTES = np.array([
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
], np.uint8)


def run_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of words of each text; the text and the bucket of each of its runs."""
    data, offsets = bytes_of(texts)
    rows, encoded = word_spans(texts_from(WORD_BYTES[data], offsets))
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    words = encoded.dictionary.cast(pa.large_binary()).to_pylist()
    sizes = np.fromiter(map(len, words), np.int64, len(words))[codes] + 1
    spaced = checksums([b" " + w for w in words])[codes]
    runs = checksums(words)[codes]
    found = [(rows, runs)]
    for more in range(1, LONGEST_RUN):
        runs = joined(runs[:-1], spaced[more:], sizes[more:])
        inside = rows[more:] == rows[:-more]
        found.append((rows[more:][inside], runs[inside]))
    counts = np.bincount(rows, minlength=len(texts))
    return counts, np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found]).astype(np.int64) % BUCKETS


def _blob(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.tobytes())


def _counts(blobs: list[bytes]) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for blob in blobs:
        total += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)
    return total


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How many runs of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for batch in slices(whole, STEP):
                total += np.bincount(run_buckets(batch.column(0))[2], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([_blob(total)], pa.binary())], ["counts"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"counts": pa.array([_blob(_counts(table.column("counts").to_pylist()))], pa.binary())})

    part = texts.select(F.col(text).alias("text")).mapInArrow(count, "counts binary")
    dealt = part.withColumn("step", F.pmod(F.spark_partition_id(), F.lit(FIRST_STEP)))
    done = dealt.groupBy("step").applyInArrow(add, "counts binary").collect()  # at most FIRST_STEP arrays
    return _counts([bytes(row["counts"]) for row in done])


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths, rounded down."""
    s, t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def luck(doc_id: str | Column, seed: int = SEED) -> Column:
    """A document's Gumbel number in thousandths, rounded down, from its id alone."""
    value = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def scores(docs: DataFrame, target: DataFrame, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every document."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, STEP):
                words, rows, buckets = run_buckets(batch.column(1))
                weight = np.bincount(rows, weights=gain[buckets], minlength=batch.num_rows)  # exact below 2**53
                n = np.bincount(rows, minlength=batch.num_rows)
                arrays = [batch.column(0), *(pa.array(x.astype(np.int64)) for x in (words, n, weight))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    weighed = slim.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + luck("doc_id", seed))


def cutoff(rows: DataFrame, column: str, wanted: int) -> tuple[int, int, int]:
    """The smallest value such that at least ``wanted`` rows are at or below it; the rows below it, and those at it."""
    low, high, total = rows.agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
    below, upto = 0, total
    while low < high:
        marks = sorted({low + (high - low) * k // (1 << HALVINGS) for k in range(1, 1 << HALVINGS)} - {high})
        inside = rows.filter(F.col(column).between(low, high))
        held = [below + n for n in inside.agg(*[F.count_if(F.col(column) <= m) for m in marks]).first()]
        for mark, n in zip(marks, held):
            if n >= wanted:
                high, upto = mark, n
                break
            low, below = mark + 1, n
    return low, below, upto - below


def drawn(table: DataFrame, wanted: int) -> Column:
    """Which rows are the first ``wanted`` by (``place``, ``tie``, ``row``); there are as many at least."""
    if wanted <= 0:
        return F.lit(False)
    taken, tied, left = F.lit(False), F.lit(True), wanted
    for column in ("place", "tie", "row"):
        value, below, equal = cutoff(table.filter(tied), column, left)
        taken = taken | (tied & (F.col(column) < F.lit(value)))
        tied = tied & (F.col(column) == F.lit(value))
        left -= below
        if left == equal:
            break
    return taken | tied


def ranked(rows: DataFrame) -> DataFrame:
    """Add ``rank`` by (``place``, ``tie``, ``row``): rows are sorted by ranges, and the ranges' counts are summed up."""
    order = ["place", "tie", "row"]
    dealt = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", INDEX_BITS)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index = F.col("_at").bitwiseAND((1 << INDEX_BITS) - 1)
    placed = dealt.withColumn("_part", part).join(sizes.select("_part", before.alias("_before")), "_part")
    return placed.withColumn("rank", F.col("_before") + index + 1).drop("_part", "_before", "_at")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Every document's ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``; undrawn ones have no rank.

    Of the documents with ``min_words`` words, ``percent`` of a hundred are drawn, rounded down.
    """
    scored = scores(docs, target, seed, doc_id, text)
    table = materialize(scored.withColumns({
        "place": -F.col("score"), "tie": F.coalesce("doc_id", F.lit(-(1 << 63))), "row": F.monotonically_increasing_id(),
        "long": F.col("n_words") >= min_words,
    }))
    eligible = table.filter("long")
    is_drawn = F.col("long") & drawn(eligible, percent * eligible.count() // 100)
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    others = table.filter(~is_drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked(table.filter(is_drawn)).select(*columns).unionByName(others.select(*columns))


def sample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns and ``rank``; ids must tell documents apart."""
    chosen = resample(docs, target, doc_id=doc_id, **options).filter("rank is not null")
    return docs.join(chosen.select(F.col("doc_id").alias(doc_id), "rank"), doc_id)
