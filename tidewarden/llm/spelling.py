"""Grouping of spelling variants: the vocabulary acceptor composed with a one-edit transducer and itself.

Words are counted in the scan: checksums of ``<id>:<run>`` come from those of the parts, and only distinct runs of a
batch are looked at. The pairs of words one edit apart are the accepting paths of acceptor, one-edit transducer and
acceptor. The composition is enumerated by partitions of its initial states: a pair (u, v), u not longer than v, has its
edit behind the first half of u or before the second. In the first case both words have passed the same state
of the acceptor after that half, and the paths from there are enumerated forwards; in the second the same holds
for the acceptor of the reversed words. A partition is the state after one half for one length of u, so no
partition knows the whole vocabulary, and a pair is accepted in one partition only.

In a partition the residual words form a minimised acyclic acceptor whose states know how many words they accept, so that
paths are numbers and no word is spelt out. Without an edit both sides of the composition stand in one state; an edit
leads to a pair of states, from which the common words are enumerated once for each pair. A partition of more than
``GROUP`` words is cut into blocks of words, and every two blocks are composed on their own, which stays exact.

A word's form is its near word of largest count if that is at least twice its own; counts grow along forms, so they
have no circles, and roots are found by doubling.

Defined cases: a null or empty text has no runs; a null id counts as an empty one (``:<run>``); rows that repeat an id
count each on their own; a run that a deletion empties is no word; very long texts and runs are read whole. Extra
columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.checksums import checksums, joined
from tidewarden.llm.words import bytes_of, slices, texts_from, word_spans
from tidewarden.session import materialize

MIN_LETTERS = 5
MIN_COUNT = 3
EDITED = 97
RATIO = 2
GROUP = 20_000  # words of one partition that one acceptor holds
TASK_ROWS = 50_000  # words that one task composes, over all its partitions
STEP = 4 << 20
KEPT_WORDS = 400_000  # counted in a task before it hands them on
LEAD = 0xC3  # first byte of the letters U+00C0 to U+00FF; another byte follows

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(0x61, 0x7B), LEAD]] = True


def runs_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Every run of letters of a batch of texts, A-Z in lower case: the text it stands in and its encoded value."""
    data, offsets = bytes_of(texts)
    small = LOWER[data]
    kept = IS_LETTER[small]
    kept[1:] |= data[:-1] == LEAD
    return word_spans(texts_from(np.where(kept, small, np.uint8(0x20)), offsets))


def shortened(run: bytes, digest: int) -> bytes:
    letters = run.decode()
    at = digest % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of all runs, edited where the checksum says so, whatever their length and count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for whole in batches:
            for batch in slices(whole, STEP):
                rows, encoded = runs_of(batch.column(1))
                codes = encoded.indices.to_numpy(zero_copy_only=False)
                runs = encoded.dictionary.cast(pa.large_binary()).to_pylist()
                names = checksums([f"{'' if i is None else i}:".encode() for i in batch.column(0).to_pylist()])
                sizes = np.fromiter(map(len, runs), np.int64, len(runs))
                digests = joined(names[rows], checksums(runs)[codes], sizes[codes])
                edited = digests % EDITED == 0
                plain = np.bincount(codes[~edited], minlength=len(runs))
                total.update({runs[i]: int(plain[i]) for i in np.flatnonzero(plain)})
                total.update(shortened(runs[c], d) for c, d in zip(codes[edited].tolist(), digests[edited].tolist()))
                if len(total) > KEPT_WORDS:
                    yield done()
        if total:
            yield done()

    slim = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimised acyclic acceptor of sorted distinct words; ``arcs[q]`` maps a symbol to (next state, words before)."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.accepted: list[int] = []
        known: dict[tuple, int] = {}
        open_: list[list] = [[False, []]]  # of the last word's path: whether a word ends there, and the finished arcs
        path = ""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                ends, arcs = open_.pop()
                open_[-1][1].append((path[len(open_) - 1], self._state(known, ends, arcs)))

        for word in words:
            shared = 0
            while shared < len(path) and shared < len(word) and path[shared] == word[shared]:
                shared += 1
            close(shared)
            open_.extend([False, []] for _ in range(len(word) - shared))
            open_[-1][0] = True
            path = word
        close(0)
        self.start = self._state(known, *open_[0])

    def _state(self, known: dict[tuple, int], ends: bool, arcs: list[tuple[str, int]]) -> int:
        key = (ends, tuple(arcs))
        if key not in known:
            known[key] = len(self.arcs)
            before, out = int(ends), {}
            for symbol, state in arcs:
                out[symbol] = (state, before)
                before += self.accepted[state]
            self.arcs.append(out)
            self.final.append(ends)
            self.accepted.append(before)
        return known[key]

    def common(self, a: int, b: int) -> list[tuple[int, int]]:
        """The words that two states accept alike, as their numbers from either state."""
        found, open_ = [], [(a, b, 0, 0)]
        while open_:
            p, q, i, j = open_.pop()
            if self.final[p] and self.final[q]:
                found.append((i, j))
            here, there = self.arcs[p], self.arcs[q]
            if len(there) < len(here):
                open_.extend((here[c][0], to, i + here[c][1], j + n) for c, (to, n) in there.items() if c in here)
            else:
                open_.extend((to, there[c][0], i + n, j + there[c][1]) for c, (to, n) in here.items() if c in there)
        return found

    def edits(self, state: int) -> list[tuple[int, int]]:
        """Pairs of words from a state whose first edit is at it, as numbers from it; a longer word comes second."""
        found = []
        arcs = list(self.arcs[state].values())
        for k, (a, i) in enumerate(arcs):
            for b, j in arcs[k + 1 :]:  # replaced
                found.extend((i + x, j + y) for x, y in self.common(a, b))
            found.extend((x, i + y) for x, y in self.common(state, a))  # inserted
        return found

    def near_pairs(self) -> set[tuple[int, int]]:
        """All pairs of accepted words one edit apart, as numbers in sorted order."""
        known: dict[int, list[tuple[int, int]]] = {}
        found, open_ = set(), [(self.start, 0)]
        while open_:
            state, base = open_.pop()
            if self.accepted[state] < 2:
                continue
            if state not in known:
                known[state] = self.edits(state)
            found.update((base + x, base + y) for x, y in known[state])
            open_.extend((to, base + n) for to, n in self.arcs[state].values())
        return found


def partition_near(rest: list[str], size: list[int], block: list[int], first: int, second: int, length: int) -> Iterator[tuple[int, int]]:
    """Near pairs of one partition's residual words as places in the lists; the shorter word has ``length`` letters."""
    if len(rest) < 2:
        return
    order = sorted(range(len(rest)), key=rest.__getitem__)
    for x, y in Acceptor([rest[k] for k in order]).near_pairs():
        x, y = order[x], order[y]
        blocks = {block[x], block[y]} if first != second else {first, second}
        if min(size[x], size[y]) == length and blocks == {first, second}:
            yield x, y


NEAR = "word string, n_near long, best_n long, best_word string"


def near_words(vocabulary: DataFrame, group: int = GROUP) -> DataFrame:
    """``word``, ``n_near``, ``best_n`` and ``best_word`` of each word that has near words, from ``word`` and ``n``.

    Each partition counts a word's near words and keeps the best; partitions share no pair, so the counts add up.
    """
    letters = F.char_length("word")
    for_length = vocabulary.withColumn("size", letters).withColumn("length", F.explode(F.array(letters, letters - 1)))
    half = F.floor(F.col("length") / 2).cast("int")
    sides = F.array(
        F.struct(F.lit(True).alias("forward"), F.substring("word", F.lit(1), half).alias("key")),
        F.struct(F.lit(False).alias("forward"), F.reverse(F.substring(F.reverse("word"), F.lit(1), F.col("length") - half)).alias("key")),
    )
    names = ["length", "forward", "key"]
    placed = materialize(for_length.select("word", "n", "size", "length", F.inline(sides)))
    sizes = placed.groupBy(*names).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    cut = placed.join(sizes, names).withColumn("blocks", F.ceil(F.col("members") / F.lit(group)).cast("int"))
    # With more than one block, a word goes to every pair of blocks that holds its own.
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(
        F.least(b, F.col("block")).alias("first"), F.greatest(b, F.col("block")).alias("second")))
    dealt = cut.withColumn("block", block).select(*names, "word", "n", "size", "block", F.inline(met))
    wide = [*names, "first", "second"]

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        out: list[tuple[str, int, int, str]] = []

        def finish() -> None:
            length, forward, _, first, second = key
            words = [r[0] for r in rows]
            if len(words) < 2:
                return
            half = length // 2
            rest = [w[half:] for w in words] if forward else [w[: len(w) - (length - half)][::-1] for w in words]
            count: Counter[int] = Counter()
            best: dict[int, tuple[int, str]] = {}
            for x, y in partition_near(rest, [r[2] for r in rows], [r[3] for r in rows], first, second, length):
                if not forward and words[x][:half] == words[y][:half]:
                    continue  # accepted forwards
                for one, other in ((x, y), (y, x)):
                    count[one] += 1
                    found = (-rows[other][1], words[other])
                    if one not in best or found < best[one]:
                        best[one] = found
            out.extend((words[k], count[k], -n, word) for k, (n, word) in best.items())

        def table() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                ["word", "n_near", "best_n", "best_word"])
            out.clear()
            return made

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for k, row in zip(zip(*columns[:5]), zip(*columns[5:])):
                if k != key:
                    if key is not None:
                        finish()
                    key, rows = k, []
                rows.append(row)
            if len(out) > 50_000:
                yield table()
        if key is not None:
            finish()
        if out:
            yield table()

    # A number of tasks by rows: their bytes are few for the work they make.
    tasks = 1 + 4 * vocabulary.count() // TASK_ROWS
    sorted_rows = dealt.select(*wide, "word", "n", "size", "block").repartition(tasks, *wide).sortWithinPartitions(*wide)
    found = sorted_rows.mapInArrow(compose, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best_word").alias("word")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best_word"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of words with a ``form``: forms are followed to the last by doubling."""
    jumps = forms.select("word", F.col("form").alias("root"))
    while True:
        jumps = materialize(jumps)
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = jumps.join(onward, "root", "left")
        if further.filter("_next is not null").isEmpty():
            return jumps
        jumps = further.select("word", F.coalesce("_next", "root").alias("root"))


def variants(
    docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO, group: int = GROUP,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``word``, ``n``, ``form``, ``root``, ``n_near``, ``form_n`` of every word of the corpus."""
    counted = word_counts(docs, doc_id, text).filter((F.char_length("word") >= min_letters) & (F.col("n") >= min_count))
    vocabulary = materialize(counted)
    near = near_words(vocabulary, group)
    has_form = F.col("best_n") >= ratio * F.col("n")
    formed = materialize(vocabulary.join(near, "word", "left").select(
        "word", "n", F.when(has_form, F.col("best_word")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has_form, F.col("best_n")).alias("form_n")))
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
