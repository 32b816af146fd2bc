"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised once, in the scan; only lengths and checksums leave it. Documents longer than a sequence
are cut into full pieces and a rest. Pieces are dealt by hash into groups of about ``GROUP`` sequences' worth of
tokens, so that a group is bounded and their number follows the input; each group is packed on its own and ends
with at most one sequence that is not well filled.

Within a group a sequence is filled greedily, largest fitting piece first. If a gap stays, the sequence's smallest
piece is replaced by the two unpacked pieces that fill the gap it would leave best, if they fill it better.
Only counts by length matter for that, so the search is over at most ``length`` values.

Defined cases: a null or empty text is one piece of the closing id alone; rows that repeat an id are pieces of
their own, told apart by nothing but their content; a null id is packed like any other. An empty table gives an
empty result. ``pack`` needs no ids to be unique.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.words import slices, word_spans
from tidewarden.session import materialize

LENGTH = 4096
CLOSING_ID = 1
# Sequences' worth of tokens in a packing group.
GROUP = 1024
# Distinct words whose ids a Python worker remembers, about 0.4 KB each, and bytes of text it tokenises at once for
# each of them. Fewer words take less memory and more time; the result is the same.
REMEMBERED = 600_000
STEP_SHARE = 7


def parted(texts: pa.Array) -> pa.Array:
    """Texts whose white-space separated parts have the ids that the text has, and come more often than its words.

    The tokenizer lower-cases, and it parts letters from the punctuation that ends a word. Texts in which one of its
    special tokens may stand, which it tells apart by case, are left alone.
    """
    lower = pc.replace_substring_regex(pc.ascii_lower(texts), r"(\pL)([.,!?;:]+)(\s|$)", r"\1 \2\3")
    return pc.if_else(pc.match_substring(texts, "<|"), texts, lower)


class WordIds:
    """Ids of white-space separated words. The tokenizer drops white space and splits at it, so words are independent.

    When more than ``remembered`` words are held, those that came in several batches stay, the most used first.
    """

    def __init__(self, tokenizer_path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.remembered = remembered
        self.places: dict[str, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.used = np.empty(0, np.int64)

    def _forget(self) -> None:
        stay = np.flatnonzero(self.used > 1)
        if len(stay) > self.remembered // 2:
            stay = np.sort(stay[np.argsort(-self.used[stay], kind="stable")[: self.remembered // 2]])
        sizes = np.diff(self.starts)[stay]
        ends = np.cumsum(sizes)
        words = np.array(list(self.places), object)[stay]
        if len(stay):
            self.ids = self.ids[np.repeat(self.starts[stay] - (ends - sizes), sizes) + np.arange(ends[-1])]
        else:
            self.ids = self.ids[:0]
        self.starts = np.concatenate((np.zeros(1, np.int64), ends))
        self.places = dict(zip(words.tolist(), range(len(words))))
        self.used = self.used[stay]

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The first place and the number of each word's ids in ``self.ids``."""
        if len(self.places) + len(words) > self.remembered and self.places:
            self._forget()
        new = [w for w in words if w not in self.places]
        if new:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            base = len(self.places)
            self.places.update(zip(new, range(base, base + len(new))))
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
            self.ids = np.concatenate((self.ids, np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum()))))
            self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))
        at = np.fromiter((self.places[w] for w in words), np.int64, len(words))
        self.used[at] += 1
        return self.starts[at], self.starts[at + 1] - self.starts[at]


_KNOWN: dict[tuple[str, int], WordIds] = {}


def word_ids(tokenizer_path: str, remembered: int) -> WordIds:
    """The worker's remembered ids; a worker serves many tasks."""
    if (tokenizer_path, remembered) not in _KNOWN:
        if not Path(tokenizer_path).is_file():
            raise FileNotFoundError(f"the tokenizer file must be on every machine: {tokenizer_path}")
        _KNOWN[tokenizer_path, remembered] = WordIds(tokenizer_path, remembered)
    return _KNOWN[tokenizer_path, remembered]


def token_ids(texts: pa.Array, known: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of texts, one text after another, and the number of each text's."""
    rows, encoded = word_spans(parted(texts))
    starts, sizes = known.of(encoded.dictionary.to_pylist())
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    lengths = sizes[codes]
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
    within = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    ids = known.ids[np.repeat(starts[codes], lengths) + within]
    return ids, np.bincount(rows, weights=lengths, minlength=len(texts)).astype(np.int64)


def pieces(
    docs: DataFrame, tokenizer_path: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", remembered: int = REMEMBERED
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` for every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer_path, remembered)
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, STEP_SHARE * remembered):
                ids, sizes = token_ids(batch.column(1).cast(pa.large_string()), known)
                raw, ends = ids.astype("<u4"), np.cumsum(sizes)
                out: list[tuple] = []
                for doc, n, end in zip(batch.column(0).to_pylist(), sizes.tolist(), ends.tolist()):
                    body = raw[end - n : end].tobytes() + closing
                    for piece, at in enumerate(range(0, n + 1, length)):
                        part = body[4 * at : 4 * (at + length)]
                        out.append((doc, piece, at, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*out)) if out else [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: np.ndarray, length: int) -> Iterator[list[int]]:
    """The lengths of each sequence's pieces, for ``counts[n]`` pieces of length n; ``counts`` is used up."""
    there = sum(1 << int(n) for n in np.flatnonzero(counts))  # lengths of which a piece is left

    def take(n: int) -> None:
        nonlocal there
        counts[n] -= 1
        if not counts[n]:
            there ^= 1 << n

    while there:
        bin_, gap = [], length
        while fits := there & ((2 << gap) - 1):
            n = fits.bit_length() - 1
            take(n)
            bin_.append(n)
            gap -= n
        if gap and there:
            smallest = bin_[-1]
            pair = _best_pair(counts, smallest + gap, smallest)
            if pair:
                bin_.pop()
                counts[smallest] += 1
                there |= 1 << smallest
                for n in pair:
                    take(n)
                    bin_.append(n)
        yield bin_


def _best_pair(counts: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum up to ``room``, if it is over ``more_than``."""
    lengths = np.flatnonzero(counts[: room + 1])
    if not len(lengths):
        return None
    place = np.searchsorted(lengths, room - lengths, side="right") - 1  # the largest partner of each
    good = place >= 0
    a, b = lengths[good], lengths[place[good]]
    alone = (a == b) & (counts[a] < 2)
    b = np.where(alone, np.where(place[good] > 0, lengths[np.maximum(place[good] - 1, 0)], -length_of(room)), b)
    sums = a + b
    if not len(sums) or sums.max() <= more_than:
        return None
    best = int(np.argmax(sums))
    return int(a[best]), int(b[best])


def length_of(room: int) -> int:
    """A value that no pair with it can be chosen for."""
    return 2 * room + 2


def _pack_group(table: pa.Table, length: int) -> pa.Table:
    """Place the pieces of one group: pieces of one length are alike, and are used in the order of id and piece."""
    table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
    sizes = table.column("length").to_numpy()
    order = np.argsort(sizes, kind="stable")
    heads = np.concatenate(([0], np.cumsum(np.bincount(sizes, minlength=length + 1))))
    nxt = heads[:-1].copy()
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    group = int(table.column("group")[0].as_py())
    for number, lengths in enumerate(best_two_fit(np.bincount(sizes, minlength=length + 1), length)):
        at = 0
        for n in lengths:
            row = order[nxt[n]]
            nxt[n] += 1
            sequence[row], offset[row] = number, at
            at += n
    out = table.drop_columns(["group"])
    return out.append_column("sequence_id", pa.array(sequence + (group << 32))).append_column("offset", pa.array(offset))


def pack(
    docs: DataFrame, tokenizer_path: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", remembered: int = REMEMBERED
) -> DataFrame:
    """Every piece with the sequence it stands in and its place there."""
    cut = materialize(pieces(docs, tokenizer_path, length, doc_id, text, remembered))
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (GROUP * length)))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("group").applyInArrow(lambda table: _pack_group(table, length), schema)
