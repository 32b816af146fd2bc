"""Near-duplicates by wide fingerprints against all pairs of shingle sets."""

import random

import numpy as np

from tidewarden.llm import similar


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def share(a, b):
    both = len(a & b)
    return 1.0 if not a | b else both / (len(a) + len(b) - both)


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if 0.8 * max(len(x), len(y)) <= min(len(x), len(y)) and share(x, y) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def edited_rows(seed=3, originals=60):
    """Texts, with copies that have scattered edits, lost ends and new beginnings; some stay above the threshold."""
    rng = random.Random(seed)
    rows = []
    for d in range(originals):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 400))]
        rows.append(" ".join(words))
        some = list(words)
        for _ in range(max(1, len(words) // 80)):
            some[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append(" ".join(some))
        rows.append(" ".join(words[: int(len(words) * 0.93)]))
        rows.append(" ".join([f"head{d}of{k}" for k in range(len(words) // 3)] + words))
    return list(enumerate(rows, 1))


def found(spark_docs):
    return {r["doc_id"]: r["component_id"] for r in similar.alike_documents(spark_docs).collect()}


def test_components_of_edited_copies(docs):
    rows = edited_rows()
    expected, got = brute_components(rows), found(docs(rows))
    wrong = [i for i in expected if got[i] != expected[i]]
    assert sum(expected[i] != i for i in expected) > 60
    assert len(wrong) <= 0.05 * len(rows)
    assert all(expected[got[i]] == expected[i] for i in got)  # nothing below the threshold is joined


def test_components_of_the_documents(docs, texts):
    rows = [(i, t) for i, t in texts if len(t) < 20000]
    expected, got = brute_components(rows), found(docs(rows))
    assert all(expected[got[i]] == expected[i] for i in got)
    assert sum(got[i] != expected[i] for i in got) <= 0.002 * len(rows)


def test_a_large_group_of_near_copies(docs):
    base = [f"base{k}" for k in range(200)]
    rows = [(i, " ".join([*base[:i % 200], f"edit{i}", *base[i % 200 + 1 :]])) for i in range(1, 400)]
    rows += [(1000 + i, " ".join(f"other{i}of{k}" for k in range(200))) for i in range(20)]
    old = similar.BLOCK
    similar.BLOCK = 50
    try:
        got = found(docs(rows))
    finally:
        similar.BLOCK = old
    assert {got[i] for i in range(1, 400)} == {1} and all(got[1000 + i] == 1000 + i for i in range(20))


def test_odd_rows(odd, empty):
    got = [(r["doc_id"], r["component_id"]) for r in similar.alike_documents(odd).collect()]
    assert sorted(i for i, _ in got if i is not None) == [1, 2, 3, 4, 4, 5, 6, 7, 8] and len(got) == 10
    of = dict(got)
    assert of[1] == of[2] == of[3] == 1 and of[6] == 5 and of[8] == 8 and of[None] is None
    kept = similar.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8]
    assert similar.alike_documents(empty).count() == 0 and similar.keep_first(empty).count() == 0


def crowded_rows(families=6, variants=100, words=400, seed=1):
    """Families of a text ``a``, a ``b`` at 0.817 of it (one block of edits) and variants at 0.70 to 0.73."""
    rng, rows = random.Random(seed), []
    for f in range(families):
        a = [f"f{f}w{rng.randrange(10**6)}" for _ in range(words)]
        for v in range(variants + 2):
            lost = 0 if v == 0 else 36 if v == 1 else rng.randrange(58, 67)
            at = rng.randrange(1, words - lost)
            rows.append(" ".join(a[:at] + [f"f{f}v{v}n{k}" for k in range(lost)] + a[at + lost :]))
    return list(enumerate(rows, 1))


def test_a_crowd_below_the_threshold_hides_no_link(docs):
    rows = crowded_rows()
    expected, got = brute_components(rows), found(docs(rows))
    assert all(expected[102 * f + 2] == 102 * f + 1 for f in range(6))
    assert got == expected
    old = similar.BLOCK
    similar.BLOCK = 20
    try:
        assert found(docs(rows)) == expected
    finally:
        similar.BLOCK = old


def test_texts_meet_by_their_simhash_fingerprints(docs, monkeypatch):
    """Fingerprints are plain SimHash; without any band, those within three bits still meet and pass the exact check."""
    rng, words = random.Random(4), np.random.default_rng(4)
    for size in (0, 1, 4, 9001):
        hashes = np.unique(words.integers(0, 2**63, size, np.uint64) * np.uint64(2))
        plain = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))
        assert similar.fingerprint(hashes) % 2**64 == plain
    rows = []
    for d in range(40):
        text = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
        rows += [" ".join(text), " ".join([*text[:-1], f"last{d}"])]
    rows += [" ", "", "\t"]
    rows = list(enumerate(rows, 1))
    monkeypatch.setattr(similar, "band_keys", lambda shingles, bands: np.empty(0, np.int64))
    expected, got = brute_components(rows), found(docs(rows))
    assert all(expected[got[i]] == expected[i] for i in got)
    assert sum(got[i] != i for i in got) >= 0.8 * sum(expected[i] != i for i in expected)
