"""Language identification by cross-parsing entropy.

Texts are lower-cased and everything but letters becomes single spaces. For every language a suffix automaton holds all
substrings of a sample of its labelled text. A text is parsed from left to right into the longest phrases that a
language's automaton knows (a symbol it doesn't know is a phrase of its own); the language that needs the fewest phrases,
times the bits that name a place in its sample, for each byte wins. The score is one less the winner's rate over the
runner-up's.

Automata are built by language in tasks from at most ``TOTAL`` bytes of pieces over all languages, drawn by the hashes of
the pieces' contents from the whole corpus, so copies count once and no text is favoured for its place. Their edges go to the workers, which
lay them out as one table where a failed step already is the first step of the next phrase. Texts are parsed in blocks
of ``BLOCK`` bytes (a block begins a phrase, for every language alike), and all blocks of a batch walk together.

Labels are read only from rows whose crc32(id as text) modulo 5 is not 0. Language, source and id are no inputs.

Defined cases: a null text, one without a letter, and every text if nothing could be learnt is ``und`` with score 0;
ties go to the language that sorts first; with one language learnt the score is 1; a null id is never learnt from and
not held out; an empty language name is a language. More than ``LANGUAGES`` labels: those with the most text are learnt.
Rows that repeat an id each get a row. Very long texts are read whole. Extra columns play no part. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewarden.llm.words import bytes_of, slices
from tidewarden.session import materialize

UNKNOWN = "und"
# Bounds of the sample that automata are built from: bytes over all languages, and languages.
TOTAL = 128 << 10
LANGUAGES = 256
PIECE = 512
BLOCK = 512
STEP = 4 << 20
SEED = 23
GAP = b"\0"  # between pieces; in no text


def plain(texts: pa.Array) -> pa.Array:
    """Lower-case letters (and marks on them) with single spaces between; null without a letter."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    spaced = pc.replace_substring_regex(pc.utf8_lower(whole), r"[^\pL\pM]+", " ")
    return pc.if_else(pc.match_substring_regex(whole, r"\pL"), pc.ascii_trim(spaced, " "), None)


def suffix_automaton(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges (state, byte, next state) of the automaton of all substrings; state 0 is the start."""
    following: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in data:
        now = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        at, last = last, now
        while at >= 0 and symbol not in following[at]:
            following[at][symbol] = now
            at = link[at]
        if at < 0:
            continue
        held = following[at][symbol]
        if length[held] == length[at] + 1:
            link[now] = held
            continue
        twin = len(following)
        following.append(dict(following[held]))
        link.append(link[held])
        length.append(length[at] + 1)
        while at >= 0 and following[at].get(symbol) == held:
            following[at][symbol] = twin
            at = link[at]
        link[held] = link[now] = twin
    edges = np.array([(s, b, t) for s, out in enumerate(following) for b, t in out.items()], np.int32).reshape(-1, 3)
    return edges[:, 0], edges[:, 1], edges[:, 2]


class Parser:
    """The automata of several languages as one table: by state and symbol, the next state doubled, plus 1 where a phrase starts."""

    def __init__(self, languages: list[str], edges: list[tuple[np.ndarray, np.ndarray, np.ndarray]], sizes: list[int]):
        self.languages = languages
        self.bits = np.log2(np.array(sizes, float) + 1)
        used = np.unique(np.concatenate([b for _, b, _ in edges]))
        used = used[used != GAP[0]]
        self.codes = np.zeros(256, np.int64)
        self.codes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        states = [int(t.max(initial=0)) + 1 for _, _, t in edges]
        self.roots = np.concatenate(([0], np.cumsum(states)[:-1])).astype(np.int64)
        tables = []
        for root, n, (source, symbol, target) in zip(self.roots.tolist(), states, edges):
            table = np.full((n, self.width), -1, np.int64)
            kept = symbol != GAP[0]
            table[source[kept], self.codes[symbol[kept]]] = 2 * (target[kept] + root)
            table[0] = np.where(table[0] < 0, 2 * root, table[0]) + 1
            tables.append(np.where(table < 0, table[0], table).astype(np.int32))
        self.table = np.concatenate(tables).ravel()

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """By language and text: the number of phrases."""
        codes, sizes = self.codes[data], np.diff(offsets)
        blocks = -(-sizes // BLOCK)
        text = np.repeat(np.arange(len(sizes)), blocks)
        place = (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        length = np.minimum(sizes[text] - place, BLOCK)
        order = np.argsort(-length, kind="stable")
        start, longest = (offsets[text] + place)[order], -length[order]
        state = np.repeat(self.roots[:, None], len(text), axis=1)
        found = np.zeros(state.shape, np.int64)
        for k in range(int(length.max(initial=0))):
            live = int(np.searchsorted(longest, -k, side="left"))  # blocks longer than k
            step = self.table[state[:, :live] * self.width + codes[start[:live] + k]]
            found[:, :live] += step & 1
            state[:, :live] = step >> 1
        return np.array([np.bincount(text[order], weights=row, minlength=len(sizes)) for row in found])

    def best(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winning language's index and the score of each text that isn't empty."""
        rates = self.phrases(data, offsets) * self.bits[:, None] / np.maximum(np.diff(offsets), 1)
        if len(rates) == 1:
            return np.zeros(rates.shape[1], np.int64), np.ones(rates.shape[1])
        first, second = np.partition(rates, 1, axis=0)[:2]
        return rates.argmin(axis=0), 1 - first / np.maximum(second, 1e-300)


def held_out(doc_id: str | Column) -> Column:
    """Rows whose labels may not be learnt from."""
    value = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(value.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_pieces(known: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``lang``, ``hash``, ``piece``: the pieces of labelled texts whose hash falls into their language's share, once each."""
    bounds = {lang: int(share * (1 << 64)) for lang, share in shares.items()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # of the sample, so as small as that
        for whole in batches:
            for batch in slices(whole, STEP):
                rows = []
                for lang, text in zip(batch.column(0).to_pylist(), plain(batch.column(1)).cast(pa.large_binary()).to_pylist()):
                    bound = bounds.get(lang, 0)
                    for at in range(0, len(text or b""), PIECE):
                        piece = text[at : at + PIECE]
                        digest = xxh64_intdigest(piece, SEED)
                        if digest < bound and (lang, digest) not in seen:
                            seen.add((lang, digest))
                            rows.append((lang, digest - (1 << 63), piece))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], ["lang", "hash", "piece"])

    return known.mapInArrow(cut, "lang string, hash long, piece binary").dropDuplicates(["lang", "hash"])


def learnt(docs: DataFrame, total: int = TOTAL, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Parser | None:
    """The parser of the languages that labelled texts of rows that aren't held out have; None without any."""
    known = docs.filter(F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & ~held_out(doc_id)).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    volumes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).filter("n > 0")
    volume = {r["lang"]: r["n"] for r in volumes.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not volume:
        return None
    share = max(total // len(volume), PIECE)
    shares = {name: min(1.0, 2 * share / n) for name, n in volume.items()}
    while True:
        pieces = materialize(labelled_pieces(known, shares))
        held = {r["lang"]: r["n"] for r in pieces.groupBy("lang").agg(F.sum(F.octet_length("piece")).alias("n")).collect()}
        short = [name for name, part in shares.items() if part < 1 and held.get(name, 0) < share]
        if not short:
            break
        shares.update({name: min(1.0, 8 * shares[name]) for name in short})  # copies had filled the share

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("hash").to_pylist(), table.column("piece").to_pylist()))
        chosen, size = [], 0
        for _, piece in rows:
            if size >= share:
                break
            chosen.append(piece)
            size += len(piece)
        edges = [x.astype(np.int32).tobytes() for x in suffix_automaton(GAP.join(chosen))]
        return pa.table({"lang": table.column("lang")[:1], "size": [size], **{n: pa.array([e], pa.binary()) for n, e in zip("abc", edges)}})

    built = pieces.groupBy("lang").applyInArrow(build, "lang string, size long, a binary, b binary, c binary").collect()
    if not built:
        return None
    built.sort(key=lambda r: r["lang"])
    edges = [tuple(np.frombuffer(bytes(r[n]), np.int32) for n in "abc") for r in built]
    return Parser([r["lang"] for r in built], edges, [r["size"] for r in built])


def languages(
    docs: DataFrame, total: int = TOTAL, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", parser: Parser | None = None
) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``."""
    parser = parser or learnt(docs, total, doc_id, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by ``total``

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared.value
        for whole in batches:
            for batch in slices(whole, STEP):
                texts = plain(batch.column(1))
                names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                readable = texts.is_valid().to_numpy(zero_copy_only=False)
                if parser is not None and readable.any():
                    winner, score[readable] = parser.best(*bytes_of(texts.drop_null()))
                    names[readable] = np.array(parser.languages, object)[winner]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = slim.mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
