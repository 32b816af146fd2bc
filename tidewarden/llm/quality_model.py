"""Quality classifier: random-indexing word vectors, pooled per document, under a small calibrated network.

Every word (a run of letters and digits, or a run of other characters; lower case) falls into one of ``SLOTS`` slots
by hash. A slot has a sparse random index vector; its word vector is the sum of the index vectors of the words up to
``REACH`` places away, over all documents. Partial sums are made in the scan, packed, and added in two steps, so the
table of ``SLOTS x SIZE`` numbers is all that reaches the driver, whatever the corpus. A document's features are mean
and spread of its unit word vectors. A two-layer network is fitted on about ``MAX_LABELLED`` labelled documents at most,
drawn by hash, and its temperature on a fifth of them that it does not see; where ids or labels repeat, the rows of the
drawn ones are cut, in hash order, at twice as many.

Labels are read only from rows whose crc32(id as text) modulo 3 is not 1. Language, source and id are no inputs.

Defined cases: a null or empty text has all features 0 and is scored like any other; a label whose document is
missing, or that is null, is ignored; with labels of one kind or none at all, every score is the smoothed share of
good ones (0.5 without labels). Rows that repeat an id each get a row. Very long texts are read whole. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.words import hashes_of, mixed, slices, word_spans
from tidewarden.session import materialize

SLOTS = 1 << 14
SIZE = 32
NONZERO = 2
REACH = 2
BLOCK = 256
FIRST_STEP = 1024
STEP = 2 << 20
MAX_LABELLED = 20_000
HIDDEN = 32
SEED = 11


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of each slot's index vector."""
    bits = mixed(np.arange(SLOTS * NONZERO, dtype=np.uint64) + np.uint64(1)).reshape(SLOTS, NONZERO)
    return (bits % np.uint64(SIZE)).astype(np.int64), np.where(bits >> np.uint64(63), 1.0, -1.0)


def word_slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and the slot of every word of a batch of texts."""
    parted = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"([^\pL\pN\s]+)", r" \1 ")
    rows, encoded = word_spans(pc.ascii_lower(parted))
    slots = (hashes_of(encoded.dictionary) % np.uint64(SLOTS)).astype(np.int64)
    return rows, slots[encoded.indices.to_numpy(zero_copy_only=False)]


def _added(table: pa.Table) -> np.ndarray:
    total = np.zeros((BLOCK, SIZE), np.int64)
    for blob in table.column("sums").to_pylist():
        total += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64).reshape(BLOCK, SIZE)
    return total


def _blob(block: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(block, np.int64).tobytes())


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit word vectors of all slots, from every document; a slot without words has zeros."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = _index_vectors()
        table = np.zeros(SLOTS * SIZE)
        for whole in batches:
            for batch in slices(whole, STEP):
                rows, slots = word_slots(batch.column(0))
                for away in range(1, REACH + 1):
                    near = rows[away:] == rows[:-away]
                    left, right = slots[:-away][near], slots[away:][near]
                    for word, other in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            table += np.bincount(word * SIZE + places[other, k], weights=signs[other, k], minlength=len(table))
        blocks = table.round().astype(np.int64).reshape(-1, BLOCK, SIZE)
        used = [i for i, b in enumerate(blocks) if b.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array([_blob(blocks[i]) for i in used], pa.binary())], ["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"block": table.column("block")[:1], "sums": pa.array([_blob(_added(table))], pa.binary())})

    part = docs.select(text).withColumnRenamed(text, "text").mapInArrow(sums, "block long, sums binary")
    dealt = part.withColumn("step", F.pmod(F.spark_partition_id(), F.lit(FIRST_STEP)))
    once = dealt.groupBy("block", "step").applyInArrow(add, "block long, sums binary")
    done = once.groupBy("block").applyInArrow(add, "block long, sums binary").collect()  # SLOTS / BLOCK rows
    table = np.zeros((SLOTS // BLOCK, BLOCK, SIZE))
    for row in done:
        table[row["block"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["sums"])), np.int64).reshape(BLOCK, SIZE)
    flat = table.reshape(SLOTS, SIZE)
    norms = np.linalg.norm(flat, axis=1, keepdims=True)
    return np.divide(flat, norms, out=np.zeros_like(flat), where=norms > 0).astype(np.float32)


def pooled(rows: np.ndarray, slots: np.ndarray, n: int, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each of ``n`` rows."""
    total, squares = np.zeros((n, SIZE)), np.zeros((n, SIZE))
    for at in range(0, len(rows), 1 << 17):
        part = rows[at : at + (1 << 17)]
        values = vectors[slots[at : at + (1 << 17)]]
        heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        total[part[heads]] += np.add.reduceat(values, heads, axis=0)
        squares[part[heads]] += np.add.reduceat(values * values, heads, axis=0)
    count = np.maximum(np.bincount(rows, minlength=n), 1)[:, None]
    mean = total / count
    return np.hstack((mean, np.sqrt(np.maximum(squares / count - mean * mean, 0)))).astype(np.float32)


def features(docs: DataFrame, vectors: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``features``, 2 * SIZE single-precision numbers as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # SLOTS x SIZE numbers

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, STEP):
                rows, slots = word_slots(batch.column(1))
                found = pooled(rows, slots, batch.num_rows, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([row.tobytes() for row in found], pa.binary())], ["doc_id", "features"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(compute, "doc_id long, features binary")


class Network:
    """Standardised inputs, a hidden layer, one output; ``temperature`` divides the output before the logistic."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 3e-3):
        random = np.random.default_rng(SEED)
        self.prior = (y.sum() + 1) / (len(y) + 2)
        self.flat = len(np.unique(y)) < 2
        self.temperature = 1.0
        if self.flat:
            return
        held = random.random(len(y)) < 0.2
        if len(np.unique(y[~held])) < 2:
            held[:] = False
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        shape = (z.shape[1], HIDDEN)
        weights = [random.normal(0, 1 / np.sqrt(shape[0]), shape), np.zeros(HIDDEN), random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        zt, yt = z[~held], y[~held]
        for _ in range(epochs):
            order = random.permutation(len(yt))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                a = np.tanh(zt[rows] @ weights[0] + weights[1])
                off = (_logistic(a @ weights[2] + weights[3]) - yt[rows]) / len(rows)
                back = np.outer(off, weights[2]) * (1 - a * a)
                slopes = [zt[rows].T @ back + 1e-4 * weights[0], back.sum(axis=0), a.T @ off, np.array([off.sum()])]
                step += 1
                for w, g, m, v in zip(weights, slopes, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights = weights
        if held.any():
            out = self._outputs(x[held])
            choices = np.geomspace(0.25, 8, 61)
            losses = [np.mean(np.logaddexp(0, out / t) - y[held] * out / t) for t in choices]
            self.temperature = float(choices[int(np.argmin(losses))])

    def _outputs(self, x: np.ndarray) -> np.ndarray:
        a = np.tanh((x - self.mean) / self.scale @ self.weights[0] + self.weights[1])
        return a @ self.weights[2] + self.weights[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.prior)
        return _logistic(self._outputs(x) / self.temperature)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def held_out(doc_id: str | Column) -> Column:
    """Rows whose labels may not be learnt from."""
    value = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(value.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float32).reshape(len(blobs), 2 * SIZE).astype(np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    table = materialize(features(docs, word_vectors(docs, text), doc_id, text))
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    total = known.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))
    chosen = known.filter(place < F.lit(int((1 << 30) * min(1.0, MAX_LABELLED / max(total, 1)))))
    whole = table.join(chosen, "doc_id").select("doc_id", "features", "label")
    # Ids or labels that repeat may bring more rows than were chosen: then those that come first by hash.
    rows = whole.orderBy(F.xxhash64("doc_id", "features", "label", F.lit(SEED)), "doc_id", "features", "label").limit(2 * MAX_LABELLED).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["features"]), r["label"]))  # the order of arrival must not matter
    network = Network(_matrix([bytes(r["features"]) for r in rows]), np.array([r["label"] for r in rows], float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = network.scores(_matrix(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    scored = table.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
