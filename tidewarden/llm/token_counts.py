"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes, where a word's last byte is a symbol of its own, so a piece that may only end a
word never matches inside one. Every node has a failure link (the node of what stays after the longest pieces at its
start are taken) and the number of pieces taken on the way, so a word's greedy longest-match length is a walk of one
step for each byte, and no piece is ever built. All distinct words of a batch walk together, as arrays.

The automaton is built on the driver's vocabulary once a worker; its size is that of the vocabulary file.

Defined cases: a null or empty text has 0 tokens; a byte that no piece covers counts as one unknown token; upper case
A-Z always counts as lower case, so the vocabulary has to be a lower-case one. Rows that repeat an id each get a row. Very long texts and
words are counted whole. Extra columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.words import slices, word_spans

STEP = 4 << 20
LAST = 256  # added to a word's last byte
SYMBOLS = 512


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies: printable bytes stand for themselves,
    the others for the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


def pieces_of(vocabulary_path: str, word_end: str = "</w>") -> list[list[int]]:
    """The symbols of each piece of a byte-level vocabulary whose word ends are marked."""
    letters = byte_letters()
    with open(vocabulary_path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model["added_tokens"]}
    out = []
    for piece in model["model"]["vocab"]:
        ends = piece.endswith(word_end)
        body = piece[: -len(word_end)] if ends else piece
        if piece in special or not body or any(c not in letters for c in body):
            continue
        symbols = [letters[c] for c in body]
        if ends:
            symbols[-1] += LAST
        out.append(symbols)
    return out


class Automaton:
    """``child`` by (node, symbol), ``link``, ``taken`` (pieces on the way of the link) and ``rest`` (pieces to the end)."""

    def __init__(self, pieces: list[list[int]]):
        children: list[dict[int, int]] = [{}]
        is_piece = [False]
        parent, symbol_of = [0], [0]
        for symbols in [*pieces, *([s] for s in range(SYMBOLS))]:  # a lone byte is a piece, known or not
            node = 0
            for s in symbols:
                if s not in children[node]:
                    children[node][s] = len(children)
                    children.append({})
                    is_piece.append(False)
                    parent.append(node)
                    symbol_of.append(s)
                node = children[node][s]
            is_piece[node] = True
        n = len(children)
        link, taken = [0] * n, [0] * n
        queue = deque(children[0].values())
        while queue:
            v = queue.popleft()
            queue.extend(children[v].values())
            if is_piece[v]:
                link[v], taken[v] = 0, 1
                continue
            u, s = parent[v], symbol_of[v]
            count, z = taken[u], link[u]
            while s not in children[z]:  # ends at the root, which has every symbol
                count += taken[z]
                z = link[z]
            link[v], taken[v] = children[z][s], count
        rest = [0] * n
        for v in sorted(range(1, n), key=lambda x: self._depth(parent, x)):
            rest[v] = taken[v] + rest[link[v]]
        keys = np.array([p * SYMBOLS + s for p, s in zip(parent[1:], symbol_of[1:])], np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.arange(1, n)[order]
        self.link, self.taken, self.rest = (np.array(x, np.int64) for x in (link, taken, rest))

    @staticmethod
    def _depth(parent: list[int], v: int) -> int:
        depth = 0
        while v:
            v, depth = parent[v], depth + 1
        return depth

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each walk stands after its symbol, and the pieces taken on the way."""
        out, counts = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        open_, at = np.arange(len(nodes)), nodes.copy()
        while len(open_):
            key = at * SYMBOLS + symbols[open_]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[place] == key
            out[open_[found]] = self.nodes[place[found]]
            open_, at = open_[~found], at[~found]
            counts[open_] += self.taken[at]
            at = self.link[at]
        return out, counts

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """The number of pieces of each word, longest first, from the left."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        total = np.zeros(len(words), np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        if len(data):
            data[(starts + sizes - 1)[sizes > 0]] += LAST
        nodes = np.zeros(len(words), np.int64)
        by_size = -np.sort(-sizes)
        for k in range(int(sizes.max(initial=0))):
            live = order[: np.searchsorted(-by_size, -k, side="left")]  # words longer than k
            nodes[live], counts = self.step(nodes[live], data[starts[live] + k])
            total[live] += counts
        return total + self.rest[nodes]


_BUILT: dict[str, Automaton] = {}


def automaton(vocabulary_path: str) -> Automaton:
    """The worker's automaton of a vocabulary file; a worker serves many tasks."""
    if vocabulary_path not in _BUILT:
        _BUILT[vocabulary_path] = Automaton(pieces_of(vocabulary_path))
    return _BUILT[vocabulary_path]


def token_counts(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_tokens``. Words are split at white space; one pass, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = automaton(vocabulary_path)
        for whole in batches:
            for batch in slices(whole, STEP):
                rows, encoded = word_spans(pc.ascii_lower(batch.column(1).cast(pa.large_string())))
                sizes = built.lengths(encoded.dictionary.cast(pa.large_binary()).to_pylist())
                tokens = np.bincount(rows, weights=sizes[encoded.indices.to_numpy(zero_copy_only=False)], minlength=batch.num_rows)
                words = np.bincount(rows, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(words.astype(np.int64)), pa.array(tokens.astype(np.int64))], ["doc_id", "n_words", "n_tokens"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(count, "doc_id long, n_words long, n_tokens long")
