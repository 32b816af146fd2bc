"""Queries that SQL can't express, against plain versions written row by row."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.llm.conftest import ODD
from tidewarden.llm import hilbert, mixing, quality_model, token_counts
from tidewarden.llm.catalog import TARGETS, tokenizer_file


@pytest.fixture(scope="module")
def rows(folder):
    return duckdb.sql(f"select doc_id, text, lang, source from '{folder}/documents.parquet' order by 1").fetchall()


def chained(*values):
    """The engine's 64-bit hash of several columns, unsigned: each seeds the next, nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h)
    return h


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- mixing


def plain_measure(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", text or "")
    held = [0] * 4
    for w in words:
        if len(w) >= 8:
            held[xxhash.xxh64_intdigest(lowered(w).encode()) % 4] += 1
    return max(len(words), 1), f"t{held.index(max(held))}"


def plain_raking(cells, targets, keep, rounds=600):
    """Tokens to take from each (source, lang, topic), scaled to each margin in turn, never above what there is."""
    goal = keep * sum(cells.values())
    take = {c: keep * n for c, n in cells.items()}
    for _ in range(rounds):
        for axis, name in enumerate(mixing.AXES):
            listed = targets[name]
            wanted = {**listed, "*": max(1 - sum(listed.values()), 0.0)}
            there = {v: w for v, w in wanted.items() if any(c[axis] == v for c in cells)}
            sums = Counter()
            for c, n in take.items():
                sums[c[axis]] += n
            for c in take:
                share = there[c[axis]] / sum(there.values())
                take[c] = min(take[c] * share * goal / sums[c[axis]], cells[c]) if sums[c[axis]] else 0.0
    return take


def test_mixture_equals_a_plain_version(spark, folder, rows):
    keep = 0.5
    measured = {i: (*plain_measure(t), lang, source) for i, t, lang, source in rows}
    cell_of = {i: tuple(v if v in TARGETS[a] else "*" for a, v in zip(mixing.AXES, (source, lang, topic)))
               for i, (_, topic, lang, source) in measured.items()}
    cells = Counter()
    for i, (n, *_) in measured.items():
        cells[cell_of[i]] += n
    take = plain_raking(cells, TARGETS, keep)
    found = mixing.mixture(spark.read.parquet(f"{folder}/documents.parquet"), TARGETS, keep=keep).collect()
    assert len(found) == len(rows)
    text = {i: t for i, t, *_ in rows}
    for r in found:
        i, chance = r["doc_id"], take[cell_of[r["doc_id"]]] / cells[cell_of[r["doc_id"]]]
        assert (r["n_tokens"], r["topic"]) == measured[i][:2] and r["probability"] == pytest.approx(chance, abs=1e-4)
        draw = (chained(i, text[i]) >> 11) / 2**53
        assert r["selected"] == (draw < r["probability"])


def test_mixture_of_odd_rows(odd, empty):
    found = mixing.mixture(odd, TARGETS, keep=1.0).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in found) == sorted((i or 0, plain_measure(t)[0]) for i, t in ODD)
    assert all(0 <= r["probability"] <= 1 and r["topic"] in mixing.NAMES for r in found) and mixing.mixture(empty, TARGETS).count() == 0


# --- quality model


def plain_mix(v):
    v ^= v >> 33
    v = v * 0xFF51AFD7ED558CCD % 2**64
    v ^= v >> 33
    v = v * 0xC4CEB9FE1A85EC53 % 2**64
    return v ^ v >> 33


def plain_index(slot):
    out = [0] * quality_model.SIZE
    for k in range(2):
        bits = plain_mix(2 * slot + k + 1)
        out[bits % quality_model.SIZE] += 1 if bits >> 63 else -1
    return np.array(out, float)


def plain_slots(text):
    parted = lowered(regex.sub(r"([^\p{L}\p{N}\t\n\f\r ]+)", r" \1 ", text or ""))
    return [xxhash.xxh64_intdigest(w.encode()) % quality_model.SLOTS for w in regex.findall(r"[^\x20\x09-\x0D]+", parted)]


def test_vectors_and_features_equal_a_plain_version(spark, folder, rows):
    some = [(i, t) for i, t, *_ in rows if len(t or "") < 4000]
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter(F.coalesce(F.length("text"), F.lit(0)) < 4000)
    index, sums = {}, defaultdict(lambda: np.zeros(quality_model.SIZE))
    slots = {i: plain_slots(t) for i, t in some}
    for found in slots.values():
        for s in found:
            index.setdefault(s, plain_index(s))
        for p, s in enumerate(found):
            for q in (p - 2, p - 1, p + 1, p + 2):
                if 0 <= q < len(found):
                    sums[s] += index[found[q]]
    unit = {s: v / np.linalg.norm(v) if v.any() else v for s, v in sums.items()}
    vectors = quality_model.word_vectors(docs)
    none = [s for s in range(quality_model.SLOTS) if s not in unit]
    assert not vectors[none].any() and all(np.allclose(vectors[s], v, atol=1e-6) for s, v in unit.items())
    got = {r["doc_id"]: np.frombuffer(bytes(r["features"]), np.float32) for r in quality_model.features(docs, vectors).collect()}
    assert len(got) == len(some)
    for i, found in slots.items():
        held = np.array([unit.get(s, np.zeros(quality_model.SIZE)) for s in found]).reshape(-1, quality_model.SIZE)
        want = np.concatenate((held.mean(axis=0), held.std(axis=0))) if found else np.zeros(2 * quality_model.SIZE)
        assert np.allclose(got[i], want, atol=1e-3)


def test_network_learns_what_no_line_can_part_and_its_scores_are_calibrated():
    random = np.random.default_rng(5)
    x = random.uniform(-1, 1, (6000, 4))
    chance = np.where(x[:, 0] * x[:, 1] > 0, 0.9, 0.1)  # labels are wrong in a tenth of all cases
    y = (random.random(6000) < chance).astype(float)
    scores = quality_model.Network(x[:4000], y[:4000]).scores(x[4000:])
    assert ((scores >= 0.5) == (chance[4000:] > 0.5)).mean() > 0.9
    sure = scores > 0.8
    assert sure.sum() > 300 and abs(scores[sure].mean() - y[4000:][sure].mean()) < 0.06


# --- sharding


def test_ranks_equal_a_plain_version(spark, folder, rows):
    total, levels = len(rows), hilbert.LEVELS

    def steps(values):
        counts, before, out = Counter(values), 0, {}
        for v in sorted(counts):
            out[v] = before * levels // total
            before += counts[v]
        return out

    sizes = {i: len((t or "").encode()) for i, t, *_ in rows}
    ordered = sorted(sizes.values())
    cuts = sorted({ordered[max(math.ceil(k * total / levels) - 1, 0)] for k in range(levels)})[1:]
    of_source, of_lang = steps([r[3] or "" for r in rows]), steps([r[2] or "" for r in rows])
    keyed = []
    for i, t, lang, source in rows:
        cell = hilbert.hilbert_index([of_source[source or ""], of_lang[lang or ""], sum(c <= sizes[i] for c in cuts)])
        h = chained(i, zlib.crc32((t or "").encode()))
        keyed.append((cell, h - 2**64 if h >> 63 else h, i))
    want = {}
    for rank, (cell, _, i) in enumerate(sorted(keyed)):
        shard = max(k for k in range(8) if rank >= -(-k * total // 8))
        want[i] = (cell, shard, rank - -(-shard * total // 8))
    got = {r["doc_id"]: (r["cell"], r["shard"], r["slot"]) for r in entry.queries()["op9_hilbert_shards"](spark, folder).collect()}
    assert got == want


def test_files_of_a_shard_are_runs_of_its_slots(spark, folder, odd, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = str(tmp_path / "runs")
    boxes = hilbert.write_shards(docs, path, 4, files=3).toPandas()
    slots = {r["doc_id"]: (r["shard"], r["slot"]) for r in hilbert.sharded(docs, 4).collect()}
    files = defaultdict(list)
    for r in spark.read.parquet(path).select("row.doc_id", F.input_file_name().alias("file")).collect():
        files[r["file"]].append(slots[r["doc_id"]])
    assert len(files) == 12 and boxes["rows"].sum() == len(slots) == sum(map(len, files.values()))
    for held in files.values():
        numbers = sorted(slot for _, slot in held)
        assert len({shard for shard, _ in held}) == 1 and numbers == list(range(numbers[0], numbers[0] + len(held)))
    distinct = odd.dropDuplicates(["doc_id"])
    assert hilbert.write_shards(distinct, str(tmp_path / "odd"), 2, files=2).toPandas()["rows"].sum() == distinct.count()


# --- token counts


def test_tokens_of_odd_rows(odd, docs, empty):
    path = tokenizer_file("word_bpe_49k.json")
    found = [(r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(odd, path).collect()]
    assert sorted(i or 0 for i, *_ in found) == sorted(i or 0 for i, _ in ODD)
    by_id = {i: (words, tokens) for i, words, tokens in found}
    assert by_id[1] == by_id[2] == by_id[3] == (0, 0) and by_id[5] == by_id[6] and by_id[5][0] == 6000
    long = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs([(1, "One Two "), (2, "one two " * 300_000), (3, "z" * 100_000)]), path).collect()}
    assert long[2] == 300_000 * long[1] and 0 < long[3] <= 100_000
    assert token_counts.token_counts(empty, path).count() == 0
