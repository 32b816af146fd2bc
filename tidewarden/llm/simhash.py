"""Near-duplicates by SimHash fingerprints, compared at the anchors of a covering code.

The 64 bits are two halves. Two fingerprints that differ in at most three bits differ in at most one bit of one
half. The anchors of a half are the words of the perfect (31, 26) Hamming code over 31 of its bits: every
fingerprint has exactly one anchor within the covering radius 1, its home, and is replicated to every anchor
within radius plus threshold (1 + 1 = 2): 15.5 anchors a half on average, found from the syndrome without a
table. Two such fingerprints therefore meet at the home anchor of either, and are compared there.

Only distinct fingerprints take part, so copies cost nothing. An anchor with more than ``BLOCK`` members is cut
into pairs of blocks, each a group of bounded size; inside a group links are reduced to a spanning forest before
they leave it, so a dense group of m members sends at most m links. Components follow from those links.

Defined cases: a text without words (empty, null) has fingerprint zero and is linked like any other; fewer words
than a shingle make one shingle of all of them; rows that repeat an id all come back; a null id keeps its
fingerprint and component and never names one, so a component without any id has a null ``component_id``.
Very long texts are hashed whole, piece by piece. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewarden.llm.components import connected_components
from tidewarden.llm.words import packed_rows, texts_of
from tidewarden.session import broadcast_or_merge, materialize

SEED = 42
MAX_BITS = 3
CODE_BITS = 31
HALF_SHIFTS = (0, 32)
# Members of one anchor that are compared in one group.
BLOCK = 4096
# Shingles whose bits are counted at once.
STEP = 1 << 16


def simhash(text: bytes, shingle: int) -> int:
    """The unsigned fingerprint of one text: a bit is 1 if it is set in over half the shingles' hashes."""
    words = text.lower().split()  # bytes: lower-cases A-Z only, splits at the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), STEP):
        hashed = [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(first[at : at + STEP], last[at : at + STEP])]
        bits = np.unpackbits(np.array(hashed, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long; one pass without a shuffle."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t, shingle) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(compute, "doc_id long, fp long")


def _flip(half: Column, place: Column) -> Column:
    """``half`` with its bit at 1-based ``place`` turned over; place 0 turns nothing."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(place - 1, F.lit(0)))
    return F.when(place == 0, half).otherwise(half.bitwiseXOR(bit))


def _syndrome(half: Column) -> Column:
    """The exclusive or of the 1-based places of the half's set bits: 0 for a code word, else the bit to turn."""
    found = F.lit(0)
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, CODE_BITS + 1) if p >> k & 1)
        parity = F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))) % 2
        found = found.bitwiseOR(parity.cast("int") * (1 << k))
    return found


def _anchors_near(half: Column, syndrome: Column) -> Column:
    """All anchors up to distance 2, the home first: turn the syndrome's bit, or two bits whose places combine to it."""
    places = F.sequence(F.lit(1), F.lit(CODE_BITS))
    lower = F.filter(places, lambda p: (p.bitwiseXOR(syndrome) > p) & (syndrome != 0))
    pairs = F.transform(lower, lambda p: _flip(_flip(half, p), p.bitwiseXOR(syndrome)))
    return F.concat(F.array(_flip(half, syndrome)), pairs)


def _replicas(distinct: DataFrame) -> DataFrame:
    """Each fingerprint at each of its anchors: ``anchor``, ``fp``, ``home``."""
    sides = distinct.select("fp", F.explode(F.array(*[F.lit(s) for s in HALF_SHIFTS])).alias("_shift")).select(
        "fp", "_shift",
        F.call_function("shiftright", F.col("fp"), F.col("_shift")).bitwiseAND(F.lit((1 << CODE_BITS) - 1)).alias("_half"),
    )
    side = F.when(F.col("_shift") == 0, F.lit(0)).otherwise(F.lit(1 << CODE_BITS)).cast("long")
    return near_anchors(sides.select("fp", side.alias("side"), F.col("_half").alias("half")))


def near_anchors(sides: DataFrame) -> DataFrame:
    """(``fp``, ``side``, ``half``) at every anchor within distance 2 of the half; ``side`` sets the bits above it."""
    at = sides.withColumn("_syndrome", _syndrome(F.col("half")))
    near = at.select("fp", "side", F.posexplode(_anchors_near(F.col("half"), F.col("_syndrome"))).alias("_i", "_near"))
    return near.select(F.col("_near").bitwiseOR(F.col("side")).alias("anchor"), "fp", (F.col("_i") == 0).alias("home"))


def split_groups(replicas: DataFrame, block: int) -> DataFrame:
    """Only anchors where two fingerprints meet, with large ones cut into pairs of blocks of bounded size, ``part``.

    Where there is a ``home`` column, one of the members must be at home.
    """
    homes = [F.max("home").alias("_any")] if "home" in replicas.columns else [F.lit(True).alias("_any")]
    met = replicas.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"), *homes).filter("_n > 1 and _any")
    # written and counted: both sides come from an explode, which Spark takes for no larger than the file below it
    met = materialize(met.select("anchor", F.ceil(F.col("_n") / block).cast("int").alias("_blocks")))
    sized = replicas.join(broadcast_or_merge(met), "anchor")
    own = F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda b: F.least(b, own) * F.col("_blocks") + F.greatest(b, own))
    return sized.select(*replicas.columns, F.explode(pairs.cast("array<bigint>")).alias("part"))


def spanning_links(fps: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one group that join what its links join: each member to the smallest of its component."""
    label = np.arange(len(fps))
    for i in np.flatnonzero(home):
        near = np.bitwise_count(fps ^ fps[i]) <= max_bits
        labels = np.unique(label[near])
        if len(labels) > 1:
            label[np.isin(label, labels)] = labels[0]
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _links(groups: DataFrame, max_bits: int) -> DataFrame:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.empty(0, np.int64) for _ in range(3)] + [np.empty(0, bool)]

        def joined(columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            anchor, part, fp, home = columns
            cuts = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(part) != 0)) + 1
            bounds = np.concatenate(([0], cuts, [len(anchor)] if last and len(anchor) else [])).astype(int)
            a, b = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if hi - lo > 1:
                    x, y = spanning_links(fp[lo:hi].view(np.uint64), home[lo:hi], max_bits)
                    a.append(x.view(np.int64))
                    b.append(y.view(np.int64))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
            kept[:] = [c[bounds[-1] :] for c in columns]

        for batch in batches:
            arrived = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            yield from joined([np.concatenate(x) for x in zip(kept, arrived)], last=False)
        yield from joined(list(kept), last=True)

    dealt = groups.select("anchor", "part", "fp", "home").repartition("anchor", "part")
    return dealt.sortWithinPartitions("anchor", "part").mapInArrow(compare, "a long, b long")


def linked(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Add ``component_id``, the smallest id reachable over links, to (``doc_id``, ``fp``)."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the two halves cover thresholds up to {MAX_BITS} bits")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    return named_components(prints, distinct, _links(split_groups(_replicas(distinct), BLOCK), max_bits))


def named_components(prints: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``component_id`` to (``doc_id``, ``fp``), from the smallest id of each ``fp`` and the links between them."""
    found = broadcast_or_merge(connected_components(links))
    rooted = materialize(distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")))
    # written, so that the join on a root of very many fingerprints can be split
    roots = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = rooted.join(broadcast_or_merge(roots), "root").select("fp", "component_id")
    return prints.join(broadcast_or_merge(named, counted=rooted), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 5, max_bits: int = MAX_BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``."""
    found = linked(materialize(fingerprints(docs, shingle, doc_id, text)), max_bits)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 5, max_bits: int = MAX_BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the smallest id; of rows that repeat that id, one. Null ids all stay."""
    return first_rows(docs, linked(materialize(fingerprints(docs, shingle, doc_id, text)), max_bits), doc_id, text)


def first_rows(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that give their components their names."""
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    rows = packed_rows(docs, id=F.col(doc_id).cast("long"), twin=F.xxhash64(text))
    same_id = Window.partitionBy("id").orderBy("twin")
    chosen = rows.filter("id is not null").join(kept, F.col("id") == F.col("kept"), "left_semi")
    first = chosen.withColumn("rank", F.row_number().over(same_id)).filter("rank = 1")
    return first.select("row.*").unionByName(rows.filter("id is null").select("row.*"))
