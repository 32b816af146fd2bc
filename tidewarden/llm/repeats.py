"""Substring dedup by fixed-block anchors.

A run of ``window`` words that two documents share covers, whatever its place in either, one whole aligned block
of ``block = (window + 1) // 2`` words of the first. So the aligned, non-overlapping blocks of every document are
the index, and every rolling window of ``block`` words probes it (round 1). Hits are extended: the windows of
``window`` words around them are looked up exactly, and each learns whether an earlier document starts one
(round 2). Overlapping windows join to maximal repeats, whose words are removed (round 3).

How it moves: documents are written once as chunks of about ``CHUNK`` bytes, compressed. A chunk sends each of
its distinct hashes once, sorted and packed by bucket, so a passage in a third of all documents costs one entry
a chunk; the answer is a bit for each entry, and the chunk, which can list its entries again, applies it. Buckets
grow in number with the input, so each is a group of bounded size. No pairs of documents are ever formed: each
window only learns the smallest document that starts it.

Round 1 compares 32 bits beside the bucket and may let through what is not shared; round 2 compares 96 bits
beside the bucket and decides.

Defined cases: a null or empty text has no words; rows with the same id are one document's, so they never remove
each other's words, and neither does a row with a null id, whose text stays as it is; fewer words than a window
have no repeats. All rows come back, also those left without words. Very long texts are one chunk. Extra
columns, whatever their names, come back unchanged. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.words import hashes_of, mixed, packed_rows, slices, word_spans
from tidewarden.session import materialize

CHUNK = 2 << 20
# Text bytes whose windows share one bucket, and the least number of buckets.
BUCKET = 16 << 20
MIN_BUCKETS = 64
SEEDS = (1, 2)
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _pack(values: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(blob: bytes, n: int, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(dtype).itemsize, n)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(n)


def _bits(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(values).tobytes())


def _from_bits(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.unpackbits(raw, count=n).astype(bool)


def chunked(docs: DataFrame) -> DataFrame:
    """``chunk``, ``n_bytes`` and ``blob``: the rows of ``docs`` with its column ``text``, about CHUNK bytes together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays(
                [pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["n_bytes", "blob"])

        for batch in batches:
            for piece in slices(batch, CHUNK):
                held.append(piece)
                size += pc.sum(pc.binary_length(piece.column(piece.schema.get_field_index("text")).cast(pa.large_binary()))).as_py() or 0
                if size >= CHUNK:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    return docs.mapInArrow(pack, "n_bytes long, blob binary").withColumn("chunk", F.monotonically_increasing_id())


class Chunk:
    """The words of one chunk, and the windows over them that stay within a document."""

    def __init__(self, blob: bytes, seeds: tuple[int, ...] = SEEDS[:1]):
        self.rows = pa.ipc.open_stream(blob).read_all().combine_chunks()
        texts = self.rows.column("text").combine_chunks() if self.rows.num_rows else pa.array([], pa.string())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.string())
        self.texts = texts
        self.doc, encoded = word_spans(texts)
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        self.hashes = [hashes_of(encoded.dictionary, s)[codes] for s in seeds]
        ids = self.rows.column("doc_id")
        self.known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(ids, 0).to_numpy()
        self.n_words = np.bincount(self.doc, minlength=self.rows.num_rows)
        self.first = np.concatenate(([0], np.cumsum(self.n_words)[:-1])).astype(np.int64)

    def starts(self, size: int) -> np.ndarray:
        """The first places of all windows of ``size`` words in documents with an id."""
        n = len(self.doc) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        return np.flatnonzero((self.doc[:n] == self.doc[size - 1 :]) & self.known[self.doc[:n]])

    def windows(self, size: int, starts: np.ndarray, which: int = 0) -> np.ndarray:
        """The hashes of the windows of ``size`` words at ``starts``."""
        m, words = np.uint64(MULTIPLIERS[which]), self.hashes[which]
        n = len(words) - size + 1
        total = np.zeros(max(n, 0), np.uint64)
        for k in range(size if n > 0 else 0):
            total *= m
            total += words[k : k + n]
        return mixed(total[starts])


def _bucketed(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; buckets follow the hashes' order."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class Probes:
    """Round 1 of a chunk: its distinct block-sized windows, by (bucket, low 32 bits)."""

    def __init__(self, chunk: Chunk, block: int, buckets: int):
        self.starts = chunk.starts(block)
        hashes = chunk.windows(block, self.starts)
        key = (_bucketed(hashes, buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
        self.keys, self.of, counts = np.unique(key, return_inverse=True, return_counts=True)
        self.again = counts > 1
        self.aligned = np.zeros(len(self.keys), bool)
        self.aligned[self.of[(self.starts - chunk.first[chunk.doc[self.starts]]) % block == 0]] = True

    def by_bucket(self) -> Iterator[tuple[int, int, int]]:
        own = (self.keys >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(own)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
            if hi > lo:
                yield int(own[lo]), lo, hi


class Candidates:
    """Round 2 of a chunk: the distinct window-sized windows around its hits, with the smallest id that starts each."""

    def __init__(self, chunk: Chunk, probes: Probes, shared: np.ndarray, window: int, block: int, buckets: int):
        hit = np.zeros(len(chunk.doc) + 1, np.int64)
        hit[probes.starts[shared[probes.of]] + 1] = 1
        upto = np.cumsum(hit)
        starts = chunk.starts(window)
        starts = starts[upto[starts + window - block + 1] > upto[starts]]
        hashes, checks = chunk.windows(window, starts), chunk.windows(window, starts, 1)
        self.keys, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        checks = (checks >> np.uint64(32)).astype(np.uint32)
        self.checks = checks[first]
        same = checks == self.checks[of]  # else two windows of the chunk agree in one hash only: left alone
        self.starts, self.of = starts[same], of[same]
        self.doc_ids = chunk.ids[chunk.doc[self.starts]]
        self.least = np.full(len(self.keys), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.of, self.doc_ids)
        self.own = _bucketed(self.keys, buckets).astype(np.int64)

    def by_bucket(self) -> Iterator[tuple[int, int, int]]:
        cuts = np.flatnonzero(np.diff(self.own)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.own)]):
            if hi > lo:
                yield int(self.own[lo]), lo, hi

    def removable(self, earlier: np.ndarray) -> np.ndarray:
        """The starts of windows that a document with a smaller id starts too."""
        return self.starts[earlier[self.of] | (self.doc_ids > self.least[self.of])]


REQUEST = "chunk long, bucket long, n long, keys binary, extra binary, least binary"
ANSWER = "chunk long, bucket long, bits binary"


def _requests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = [part.split()[0] for part in REQUEST.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _answers(table: pa.Table, results: np.ndarray) -> pa.Table:
    """The entries' bits by request row; rows without a set bit are not sent."""
    out, at = [], 0
    for chunk, bucket, n in zip(*[table.column(c).to_pylist() for c in ("chunk", "bucket", "n")]):
        part = results[at : at + n]
        at += n
        if part.any():
            out.append((chunk, bucket, _bits(part)))
    columns = list(zip(*out)) if out else [[]] * 3
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["chunk", "bucket", "bits"])


def _shared_blocks(table: pa.Table) -> pa.Table:
    """Entries whose hash comes at least twice in the bucket, at least once as an aligned block."""
    sizes = table.column("n").to_pylist()
    keys = [np.cumsum(_unpack(b, n, np.uint32), dtype=np.uint32) for b, n in zip(table.column("keys").to_pylist(), sizes)]
    flags = [_unpack(b, n, np.uint8) for b, n in zip(table.column("extra").to_pylist(), sizes)]
    key, flag = np.concatenate(keys), np.concatenate(flags)
    order = np.argsort(key, kind="stable")
    sorted_keys = key[order]
    heads = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    lengths = np.diff(np.concatenate((heads, [len(key)])))
    any_flag = np.bitwise_or.reduceat(flag[order], heads)
    shared = ((lengths > 1) | (any_flag & 2 > 0)) & (any_flag & 1 > 0)
    result = np.empty(len(key), bool)
    result[order] = np.repeat(shared, lengths)
    return _answers(table, result)


def _earlier_elsewhere(table: pa.Table) -> pa.Table:
    """Entries whose window starts in a document with a smaller id than any of the entry's chunk."""
    sizes = table.column("n").to_pylist()
    column = lambda name: table.column(name).to_pylist()
    key = np.concatenate([np.cumsum(_unpack(b, n, np.uint64), dtype=np.uint64) for b, n in zip(column("keys"), sizes)])
    check = np.concatenate([_unpack(b, n, np.uint32) for b, n in zip(column("extra"), sizes)])
    least = np.concatenate([_unpack(b, n, np.int64) for b, n in zip(column("least"), sizes)])
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    heads = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))))
    lengths = np.diff(np.concatenate((heads, [len(key)])))
    smallest = np.minimum.reduceat(least[order], heads)
    result = np.empty(len(key), bool)
    result[order] = np.repeat(smallest, lengths) < least[order]
    return _answers(table, result)


def _filled(n: int, bounds: Iterator[tuple[int, int, int]], answers: list[dict] | None) -> np.ndarray:
    given = {a["bucket"]: a["bits"] for a in answers or []}
    out = np.zeros(n, bool)
    for bucket, lo, hi in bounds:
        if bucket in given:
            out[lo:hi] = _from_bits(given[bucket], hi - lo)
    return out


def _gathered(answers: DataFrame, name: str) -> DataFrame:
    """All answers to a chunk in one row: a bit for each of its entries at most."""
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def repeat_marks(chunks: DataFrame, window: int, apply: Callable[[Chunk, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Rounds 1 to 3 over written ``chunks``; ``apply`` gets each chunk and the mark of every word to remove."""
    block = (window + 1) // 2
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-total // BUCKET))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk_id, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist()):
                p = Probes(Chunk(blob), block, buckets)
                low = (p.keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                flags = p.aligned.astype(np.uint8) | (p.again.astype(np.uint8) << 1)
                yield _requests([
                    (chunk_id, bucket, hi - lo, _pack(np.diff(low[lo:hi], prepend=np.uint32(0))), _pack(flags[lo:hi]), b"")
                    for bucket, lo, hi in p.by_bucket()
                ])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk_id, blob, hits in zip(*[batch.column(c).to_pylist() for c in ("chunk", "blob", "hits")]):
                chunk = Chunk(blob, SEEDS)
                p = Probes(chunk, block, buckets)
                c = Candidates(chunk, p, _filled(len(p.keys), p.by_bucket(), hits), window, block, buckets)
                yield _requests([
                    (chunk_id, bucket, hi - lo, _pack(np.diff(c.keys[lo:hi], prepend=np.uint64(0))), _pack(c.checks[lo:hi]), _pack(c.least[lo:hi]))
                    for bucket, lo, hi in c.by_bucket()
                ])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, hits, earlier in zip(*[batch.column(c).to_pylist() for c in ("blob", "hits", "earlier")]):
                chunk = Chunk(blob, SEEDS)
                depth = np.zeros(len(chunk.doc) + 1, np.int64)
                if hits:
                    p = Probes(chunk, block, buckets)
                    c = Candidates(chunk, p, _filled(len(p.keys), p.by_bucket(), hits), window, block, buckets)
                    marked = c.removable(_filled(len(c.keys), c.by_bucket(), earlier))
                    np.add.at(depth, marked, 1)
                    np.add.at(depth, marked + window, -1)
                yield apply(chunk, np.cumsum(depth)[:-1] > 0)

    hits = materialize(chunks.select("chunk", "blob").mapInArrow(probe, REQUEST).groupBy("bucket").applyInArrow(_shared_blocks, ANSWER))
    found = _gathered(hits, "hits")
    asked = chunks.select("chunk", "blob").join(found, "chunk").mapInArrow(verify, REQUEST)
    earlier = materialize(asked.groupBy("bucket").applyInArrow(_earlier_elsewhere, ANSWER))
    answered = chunks.select("chunk", "blob").join(found, "chunk", "left").join(_gathered(earlier, "earlier"), "chunk", "left")
    return answered.mapInArrow(remove, schema)


def repeat_digest(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by one space."""

    def digest(chunk: Chunk, removed: np.ndarray) -> pa.RecordBatch:
        gone = np.bincount(chunk.doc[removed], minlength=len(chunk.ids))
        kept = []
        bounds = zip(chunk.first.tolist(), (chunk.first + chunk.n_words).tolist())
        for value, n, (lo, hi) in zip(chunk.texts.cast(pa.large_binary()).to_pylist(), gone.tolist(), bounds):
            words = (value or b"").split()
            if n:
                words = [w for w, cut in zip(words, removed[lo:hi].tolist()) if not cut]
            kept.append(b" ".join(words))
        return pa.RecordBatch.from_arrays(
            [chunk.rows.column("doc_id").combine_chunks() if chunk.rows.num_rows else pa.array([], pa.int64()),
             pa.array(chunk.n_words.astype(np.int64)), pa.array(gone.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return repeat_marks(materialize(chunked(slim)), window, digest, "doc_id long, n_words long, n_removed long, kept string")


def _cut(value: bytes, removed: np.ndarray) -> bytes:
    """``value`` without its marked words; the white space before a removed word goes with it."""
    parts, at = [], 0
    for (start, stop), gone in zip(_word_bounds(value), removed.tolist()):
        if not gone:
            parts.append(value[at:stop])
        at = stop
        del start
    return b"".join(parts) + value[at:]


def _word_bounds(value: bytes) -> Iterator[tuple[int, int]]:
    at = 0
    for word in value.split():
        at = value.index(word, at)
        yield at, at + len(word)
        at += len(word)


def without_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; words of repeats are cut from ``text``, the other white space stays."""

    def cut(chunk: Chunk, removed: np.ndarray) -> pa.RecordBatch:
        gone = np.bincount(chunk.doc[removed], minlength=len(chunk.ids))
        bounds = zip(chunk.first.tolist(), (chunk.first + chunk.n_words).tolist())
        values = chunk.texts.cast(pa.large_binary()).to_pylist()
        out = [_cut(v, removed[lo:hi]) if n else v for v, n, (lo, hi) in zip(values, gone.tolist(), bounds)]
        row = chunk.rows.column("row").combine_chunks() if chunk.rows.num_rows else pa.array([], chunk.rows.schema.field("row").type)
        return pa.RecordBatch.from_arrays([row, pa.array(out, pa.binary()).cast(pa.string())], ["row", "text"])

    rest = [c for c in docs.columns if c != text]
    packed = packed_rows(docs.select(*rest), doc_id=F.col(doc_id).cast("long")) if text not in docs.columns else docs.select(
        F.struct(*rest).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = packed.schema["row"].dataType.simpleString()
    done = repeat_marks(materialize(chunked(packed)), window, cut, f"row {kind}, text string")
    return done.select(*[F.col("text").alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
