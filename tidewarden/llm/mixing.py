"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by (source, language, topic), with every value that has no target of its own in one rest value,
so the table of cells is bounded by the targets and not by the data. Its weights are raked to each marginal in turn
until all hold, never taking more than a cell holds: the sample is the largest one whose marginals hold, up to all tokens. If ``keep`` is given, that share is taken even where a value is too scarce for it; the weights meet the
targets all the same, and a warning tells by how much the sample misses them. A document's probability is the share of
its cell that is taken; documents are drawn by a hash of their id and text, so a run can be repeated and needs no shuffle of texts.

The topic of a document is the class of a hashed lexicon (words of eight letters or more, lower case, by hash into
``TOPICS`` classes) that it holds most words of; ties go to the smallest class.

Defined cases: null or unlisted values belong to the rest; a text without words has one token's weight and topic 0;
a cell without documents gets no weight and its share goes to the cells of the same margins; if a target value has
no documents at all, its share is spread over the others in proportion. Rows that repeat an id are drawn alike if
their texts are equal. A null id is drawn by its text. An empty table gives an empty result. Extra columns,
whatever their names, pass through unchanged.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.llm.words import hashes_of, packed_rows, slices, word_spans
from tidewarden.session import materialize

TOPICS = 4
NAMES = np.array([f"t{k}" for k in range(TOPICS)], object)
LETTERS = 8
REST = "*"
STEP = 4 << 20
AXES = ("source", "lang", "topic")
MEASURES = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("topic", T.StringType())])


@F.arrow_udf(MEASURES)
def measure(texts: pa.Array) -> pa.Array:
    """The number of words (at least 1) and the topic of each text; only the texts travel to Python."""
    tokens, topics = [], []
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), STEP):
        rows, encoded = word_spans(part.column(0))
        words, codes = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
        counted = pc.greater_equal(pc.utf8_length(words), LETTERS).to_numpy(zero_copy_only=False)[codes]
        classes = (hashes_of(pc.ascii_lower(words)) % np.uint64(TOPICS)).astype(np.int64)[codes[counted]]
        held = np.bincount(rows[counted] * TOPICS + classes, minlength=part.num_rows * TOPICS).reshape(part.num_rows, TOPICS)
        topics.append(NAMES[held.argmax(axis=1)])
        tokens.append(np.maximum(np.bincount(rows, minlength=part.num_rows), 1))
    n = np.concatenate([np.empty(0, np.int64), *tokens]).astype(np.int64)
    return pa.StructArray.from_arrays(
        [pa.array(n), pa.array(np.concatenate([np.empty(0, object), *topics]), pa.string())], ["n_tokens", "topic"])


def _listed(value: Column, targets: dict[str, float]) -> Column:
    return F.when(value.isin(*targets), value).otherwise(F.lit(REST)) if targets else F.lit(REST)


def shares(targets: dict[str, float]) -> dict[str, float]:
    """The targets with the rest's share: what the listed ones leave."""
    left = 1 - sum(targets.values())
    if left < -1e-9:
        raise ValueError("target shares sum to more than 1")
    return {**targets, REST: max(left, 0.0)}


def _fitted(tokens: np.ndarray, axes: list[tuple], share: float, limit: np.ndarray | None, rounds: int, close: float) -> tuple[np.ndarray, float]:
    """Weights of ``share`` of all tokens raked to each axis in turn, at most ``limit``, and the largest miss of a margin."""
    weights, goal, worst = tokens * share, tokens.sum() * share, 0.0
    for _ in range(rounds + 1):
        sums = [weights.sum(axis=others) for others, _ in axes]
        worst = max(float(np.abs(now - wanted * goal).max()) / max(goal, 1e-300) for now, (_, wanted) in zip(sums, axes))
        if worst < close:
            break
        for others, wanted in axes:
            now = weights.sum(axis=others)
            factor = np.divide(wanted * goal, now, out=np.zeros_like(wanted), where=now > 0)
            weights = weights * np.expand_dims(factor, others)
            if limit is not None:
                weights = np.minimum(weights, limit)
    return weights, worst


def _axes(tokens: np.ndarray, margins: list[np.ndarray]) -> list[tuple]:
    axes = []
    for axis, margin in enumerate(margins):
        others = tuple(i for i in range(tokens.ndim) if i != axis)
        there = margin * (tokens.sum(axis=others) > 0)
        axes.append((others, there / there.sum() if there.sum() else there))
    return axes


def raked_pair(
    tokens: np.ndarray, margins: list[np.ndarray], keep: float, fixed: bool = False, rounds: int = 500, close: float = 1e-9, met: float = 1e-6
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens to take from each cell, and weights, both in the margins' proportions along each axis. Never more is taken
    than there is: ``keep`` of all, or the largest share below it that meets the margins.

    With ``fixed``, ``keep`` is taken even where the margins can't be met so; the weights meet them all the same. A warning
    tells by how much the sample misses, also where no weights at all can meet the margins (cells are empty)."""
    axes = _axes(tokens, margins)
    if not tokens.sum():
        return tokens * keep, tokens * keep
    found, miss = _fitted(tokens, axes, keep, tokens, rounds, close)
    if miss < met:
        return found, found
    free, gap = _fitted(tokens, axes, keep, None, 20 * rounds, close)
    if fixed or gap >= met:
        why = f"no sample of {keep:.4g} of all tokens" if gap < met else "no weights"
        warnings.warn(f"target shares are missed by {max(miss, gap):.4f}: {why} can meet them", stacklevel=2)
        return found, free
    low = keep * min(1.0, float((tokens[free > 0] / free[free > 0]).min()))  # at this share the free weights fit
    high, found = keep, free * (low / keep)
    for _ in range(20):
        middle = (low + high) / 2
        tried, miss = _fitted(tokens, axes, middle, tokens, rounds, close)
        if miss < met:
            low, found = middle, tried
        else:
            high = middle
    return found, found


def raked(tokens: np.ndarray, margins: list[np.ndarray], keep: float) -> np.ndarray:
    """The tokens to take from each cell."""
    return raked_pair(tokens, margins, keep)[0]


def factors(sums: dict[tuple[str, ...], int], targets: dict[str, dict[str, float]], keep: float | None) -> dict[tuple[str, ...], tuple[float, float]]:
    """For each cell its weight (share wanted over share there) and its probability (tokens to take over tokens there)."""
    wanted = [shares(targets.get(a, {})) for a in AXES]
    places = [{v: i for i, v in enumerate(w)} for w in wanted]
    tokens = np.zeros([len(w) for w in wanted])
    for cell, n in sums.items():
        tokens[tuple(p[v] for p, v in zip(places, cell))] = n
    take, weights = raked_pair(tokens, [np.array(list(w.values())) for w in wanted], 1.0 if keep is None else keep, keep is not None)
    part, ratio = (np.divide(x, tokens, out=np.zeros_like(x), where=tokens > 0) for x in (take, weights))
    total = float(weights.sum() / max(tokens.sum(), 1.0))
    out = {}
    for cell in sums:
        at = tuple(q[v] for q, v in zip(places, cell))
        out[cell] = (float(ratio[at]) / total if total else 0.0, min(float(part[at]), 1.0))
    return out


def _drawn(measures: DataFrame, targets: dict[str, dict[str, float]], keep: float | None) -> DataFrame:
    """Add ``weight``, ``probability`` and ``selected`` to rows with the axes, ``n_tokens`` and ``draw`` (0 to 1)."""
    cells = [_listed(F.col(a), targets.get(a, {})) for a in AXES]
    keyed = measures.withColumn("cell", F.concat_ws("\x1f", *cells))
    # at most one row for each combination of listed values
    sums = {tuple(r["cell"].split("\x1f")): r["n"] for r in keyed.groupBy("cell").agg(F.sum("n_tokens").alias("n")).collect()}
    found = factors(sums, targets, keep)
    spark = measures.sparkSession
    table = spark.createDataFrame(
        [("\x1f".join(c), w, p) for c, (w, p) in found.items()], "cell string, weight double, probability double")
    return keyed.join(F.broadcast(table), "cell", "left").drop("cell").withColumn("selected", F.col("draw") < F.col("probability"))


def draw_of(*columns: str | Column) -> Column:
    """A number from 0 to 1 that depends on the columns only."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11)).cast("double") / F.lit(float(1 << 53))


def mixture(docs: DataFrame, targets: dict[str, dict[str, float]], keep: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, the axes, ``n_tokens``, ``weight``, ``probability``, ``selected``."""
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        draw_of(doc_id, text).alias("draw"), measure(text).alias("m"))
    measures = materialize(slim.select("doc_id", "source", "lang", "draw", "m.*"))
    return _drawn(measures, targets, keep).select("doc_id", *AXES, "n_tokens", "weight", "probability", "selected")


def sample(docs: DataFrame, targets: dict[str, dict[str, float]], keep: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn rows of ``docs``, with exactly their columns. The texts are measured twice rather than moved."""
    rows = packed_rows(docs, source=F.col("source").cast("string"), lang=F.col("lang").cast("string"),
                       draw=draw_of(doc_id, text), m=measure(text))
    return _drawn(rows.select("row", "source", "lang", "draw", "m.*"), targets, keep).filter("selected").select("row.*")
