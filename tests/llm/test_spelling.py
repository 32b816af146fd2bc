import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarden.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_variants(rows, min_letters=5, min_count=3):
    counted = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counted[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counted.items() if len(w) >= min_letters and c >= min_count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n[w], form[w], root(w), len(near[w]), n.get(form[w])) for w in n)


def rows_of(df):
    return sorted((r["word"], r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in df.collect())


@pytest.mark.parametrize("seed,group", [(1, 20_000), (1, 3), (2, 10), (3, 1)])
def test_variants_equal_brute_force(docs, seed, group):
    random = np.random.default_rng(seed)
    letters = np.array(list("aabBé"))
    words = ["".join(random.choice(letters, random.integers(4, 9))) for _ in range(150)]
    rows = [(int(i), " ".join(random.choice(words, 40, p=None)) + "1x×Ā" + words[i % 7] * 2) for i in range(60)]
    assert rows_of(spelling.variants(docs(rows), group=group)) == plain_variants(rows)


def test_chains_and_ties(docs):
    rows = [(k, " ".join(["abcdefg"] * 40 + ["abcdefh"] * 20 + ["abcdeih"] * 10 + ["abcjeih"] * 5 + ["bbcdefg"] * 40 + ["zzzzz"] * 3)) for k in (1, 2)]
    assert rows_of(spelling.variants(docs(rows))) == plain_variants(rows)
    assert {r[0]: r[3] for r in plain_variants(rows)}["abcjeih"] == "abcdefg"


def test_odd_rows_long_runs_and_empty_table(docs, odd, empty):
    from tests.llm.conftest import ODD

    assert rows_of(spelling.variants(odd, 1, 1)) == plain_variants(ODD, 1, 1)
    long = [(k, ("a" * 3000 + " ") * 5 + ("a" * 2999 + " ") * 3 + ("b" + "a" * 2999 + " ") * 9) for k in range(3)]
    assert rows_of(spelling.variants(docs(long))) == plain_variants(long)
    assert spelling.variants(empty).count() == 0


def test_counts_survive_a_hand_over(docs, monkeypatch):
    rows = [(k, f"words of {chr(97 + k % 26) * 6} again words") for k in range(80)]
    monkeypatch.setattr(spelling, "KEPT_WORDS", 2)
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs(rows)).filter(F.char_length("word") > 4).collect()}
    assert sorted(got.items()) == sorted((r[0], r[1]) for r in plain_variants(rows, 5, 1))
