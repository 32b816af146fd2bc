"""Documents whose sets of word shingles are alike: SimHash components and MinHash bands to meet in, then an exact check.

A text's set of ``shingle``-word shingles gets a SimHash fingerprint, and texts meet whose fingerprints the SimHash operator
joins (3 or fewer differing bits, found at the anchors of its code). Those are few of the pairs at 0.8, so the set is also
reduced to ``BANDS`` keys of ``ROWS`` minima each, and texts meet where a key is the same, which has probability
``s ** ROWS`` a key for a similarity ``s`` (Jaccard), however the edits lie. All members that meet in either way are
compared on their full sets, and only links at ``similarity`` or more leave a group, reduced to a forest AFTER the check: a
crowd of texts just below the threshold hides no link, and m members send at most m - 1.

A pair at 0.8 meets in one key or more with probability 0.998 for 16 bands of five (0.9999 at 0.85, 0.13 at 0.4).

Groups that have the same members are checked once. A group with more than ``BLOCK`` members or ``BLOCK_SHINGLES``
shingles is cut into blocks; each is checked by itself, together with one common member, and then, only if the
links found so far leave more than one component in the group, each block with each other one.

Defined cases: words are as in SimHash (A-Z lower-cased, ASCII spaces); texts without words (empty, null) are alike;
fewer words than a shingle make one shingle of all of them; equal texts cost nothing; ids may repeat or be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.components import connected_components
from tidewarden.llm.simhash import first_rows, linked, named_components
from tidewarden.llm.words import hashes_of, mixed, slices, word_spans
from tidewarden.session import broadcast_or_merge, materialize

BANDS = 16
ROWS = 5
# Members of one block of a group, and the shingles they have together.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 18
# Texts whose keys are broadcast, one number each, to read the texts without moving them.
ASKED_ROWS = 400_000
# Text handled at once, and shingles that are hashed at once.
TEXT_BYTES = 2 << 20
STEP = 1 << 12


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of the k-word shingles of one text, from the hashes of its words, in order."""
    k = min(k, len(words))
    found = np.zeros(len(words) - k + 1 if k else 0, np.uint64)
    for j in range(k):
        found = mixed(found * np.uint64(3) + words[j : len(words) - k + 1 + j])
    return np.unique(found)


def word_hashes(batch: pa.RecordBatch, name: str = "text") -> Iterator[np.ndarray]:
    """For each row, the hashes of its words in order."""
    for part in slices(batch, TEXT_BYTES, name):
        lowered = pc.ascii_lower(part.column(part.schema.get_field_index(name)).cast(pa.large_string()))
        rows, words = word_spans(lowered)
        hashed = hashes_of(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)] if len(rows) else np.empty(0, np.uint64)
        cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield hashed[lo:hi]


def band_keys(shingles: np.ndarray, bands: int) -> np.ndarray:
    """A key for each band: a hash of the band's number and its minima over the set."""
    seeds = mixed(np.arange(1, bands * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least = np.full(len(seeds), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), STEP):
        np.minimum(least, mixed(shingles[at : at + STEP, None] + seeds[None, :]).min(axis=0), out=least)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for row in least.reshape(bands, ROWS).T:
        keys = mixed(keys * np.uint64(3) + row)
    return keys.view(np.int64)


def fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes, signed: a bit is 1 if it is set in over half of them; zero without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), STEP):
        bits = np.unpackbits(shingles[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def prints_of(docs: DataFrame, shingle: int, bands: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``fp`` (the key of the text), ``n`` (its shingles), ``simhash`` and ``keys``; one pass without a shuffle."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, keys = [], [], []
            for words in word_hashes(batch):
                found = shingle_set(words, shingle)
                sizes.append(len(found))
                prints.append(fingerprint(found))
                keys.append(band_keys(found, bands))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "fp", "n", "simhash", "keys"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("fp"), F.col(text).alias("text"))
    return slim.mapInArrow(compute, "doc_id long, fp long, n long, simhash long, keys array<long>")


def with_simhash_key(distinct: DataFrame) -> DataFrame:
    """One more of the ``keys``: the component of the text's fingerprint, by the SimHash operator."""
    found = linked(distinct.select(F.col("fp").alias("doc_id"), F.col("simhash").alias("fp")))
    component = found.select(F.col("doc_id").alias("fp"), F.xxhash64(F.lit("simhash"), F.col("component_id")).alias("_component"))
    return distinct.join(component, "fp").withColumn("keys", F.concat("keys", F.array("_component"))).drop("_component", "simhash")


def meetings(distinct: DataFrame) -> DataFrame:
    """``anchor``, ``fp``, ``least`` (the group's smallest ``fp``), ``blocks``: who meets, each set of members once."""
    members = distinct.select("fp", "n", F.explode("keys").alias("anchor"))
    met = members.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_shingles"), F.min("fp").alias("least"),
        F.bit_xor(F.xxhash64("fp")).alias("_mark")).filter("_n > 1")
    once = met.groupBy("_n", "_shingles", "least", "_mark").agg(F.min("anchor").alias("anchor"))
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK), F.ceil(F.col("_shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    return members.join(once.select("anchor", "least", blocks.alias("blocks")), "anchor").select("anchor", "fp", "least", "blocks")


def alike_links(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of one group that join what all its pairs at ``similarity`` join, beyond what equal ``labels`` join already."""
    label, sizes = labels.copy(), np.fromiter(map(len, sets), np.int64, len(sets))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(codes, kind="stable")]
    counts = np.bincount(codes)
    starts, ends = np.cumsum(counts) - counts, np.cumsum(sizes)
    links: list[tuple[int, int]] = []
    for i in range(len(sets)):
        if (label == label[0]).all():
            break
        own = codes[ends[i] - sizes[i] : ends[i]]
        held = counts[own]
        places = np.repeat(starts[own] - np.cumsum(held) + held, held) + np.arange(held.sum())
        both = np.bincount(owners[places], minlength=len(sets))
        near = np.flatnonzero(both >= similarity * (sizes + sizes[i] - both))
        for j in near[np.unique(label[near], return_index=True)[1]]:
            if label[j] != label[i]:
                links.append((i, int(j)))
                label[label == label[j]] = label[i]
    return links


def _bounds(table: pa.Table) -> tuple[list[int], list[int]]:
    """Where each group of a sorted table begins and ends."""
    if not table.num_rows:
        return [], []
    anchor, part = (table.column(c).to_numpy() for c in ("anchor", "part"))
    cuts = (np.flatnonzero((np.diff(anchor) != 0) | (np.diff(part) != 0)) + 1).tolist()
    return [0, *cuts], [*cuts, table.num_rows]


def checked(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (``a``, ``b``) within groups (``anchor``, ``part``) of ``fp`` with a ``root``, checked on the full ``sets``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
            fp, root = (table.column(c).to_numpy() for c in ("fp", "root"))
            a, b = [], []
            for lo, hi in zip(*_bounds(table)):
                if hi - lo > 1 and (root[lo:hi] != root[lo]).any():
                    hashes = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("hashes").slice(lo, hi - lo)]
                    for i, j in alike_links(hashes, root[lo:hi], similarity):
                        a.append(fp[lo + i]), b.append(fp[lo + j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            arrived = pa.Table.from_batches([batch])
            held = arrived if held is None else pa.concat_tables([held, arrived])
            starts, _ = _bounds(held)
            if len(starts) > 1:
                yield from links(held.slice(0, starts[-1]))
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield from links(held)

    dealt = sets.join(broadcast_or_merge(groups), "fp").select("anchor", "part", "fp", "root", "hashes").repartition("anchor", "part")
    return dealt.sortWithinPartitions("anchor", "part").mapInArrow(compare, "a long, b long")


def shingle_sets(docs: DataFrame, asked: DataFrame, shingle: int, text: str) -> DataFrame:
    """``fp`` and ``hashes``, the full shingle set of each text in ``asked``, built once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(w, shingle).tobytes() for w in word_hashes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["fp", "hashes"])

    texts = docs.select(text_key(F.col(text)).alias("fp"), F.col(text).alias("text")).join(
        broadcast_or_merge(asked, ASKED_ROWS), "fp", "left_semi")
    return texts.mapInArrow(sets, "fp long, hashes binary").dropDuplicates(["fp"])


def links_of(met: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links that join what all pairs at ``similarity`` that meet join."""
    blocks, own = F.col("blocks"), F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    everywhere = F.sequence(F.lit(0), blocks - 1)
    alone = F.when(F.col("fp") == F.col("least"), everywhere).otherwise(F.array(own))
    first = materialize(checked(met.select("anchor", "fp", F.col("fp").alias("root"), F.explode(alone).alias("part")), sets, similarity))
    large = met.filter("blocks > 1")
    if large.isEmpty():
        return first
    found = broadcast_or_merge(connected_components(first))
    rooted = large.join(found, F.col("fp") == F.col("node"), "left").select(
        "anchor", "fp", "blocks", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted)
    open_ = rooted.groupBy("anchor").agg((F.min("root") != F.max("root")).alias("_open")).filter("_open").select("anchor")
    across = F.transform(F.filter(everywhere, lambda b: b != own), lambda b: F.least(b, own) * blocks + F.greatest(b, own))
    parts = rooted.join(open_, "anchor", "left_semi").select("anchor", "fp", "root", F.explode(across).alias("part"))
    return first.unionByName(materialize(checked(parts, sets, similarity)))


def alike_documents(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = BANDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id`` and ``component_id``, the smallest id reachable over links."""
    prints = materialize(prints_of(docs, shingle, bands, doc_id, text))
    distinct = materialize(prints.groupBy("fp").agg(
        F.min("doc_id").alias("first"), F.any_value("n").alias("n"), F.any_value("simhash").alias("simhash"),
        F.any_value("keys").alias("keys")))
    met = materialize(meetings(with_simhash_key(distinct)))
    sets = materialize(shingle_sets(docs, met.select("fp").distinct(), shingle, text))
    links = links_of(met, sets, similarity)
    return named_components(prints.select("doc_id", "fp"), distinct.select("fp", "first"), links).select("doc_id", "component_id")


def keep_first(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = BANDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of ``docs`` for each component: the smallest id; of rows that repeat that id, one. Null ids all stay."""
    return first_rows(docs, alike_documents(docs, shingle, similarity, bands, doc_id, text), doc_id, text)
