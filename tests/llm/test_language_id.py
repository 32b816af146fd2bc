import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewarden.llm import language_id
from tidewarden.llm.words import bytes_of


def parser_of(samples):
    return language_id.Parser(list(samples), [language_id.suffix_automaton(b"\0".join(s)) for s in samples.values()], [sum(map(len, s)) for s in samples.values()])


def plain_phrases(text, pieces):
    """Blocks are parsed on their own; a symbol that no piece holds is a phrase."""
    n = 0
    for at in range(0, len(text), language_id.BLOCK):
        rest = text[at : at + language_id.BLOCK]
        while rest:
            size = 1
            while size < len(rest) and any(rest[: size + 1] in p for p in pieces):
                size += 1
            rest, n = rest[size:], n + 1
    return n


@pytest.mark.parametrize("seed", range(4))
def test_phrases_equal_brute_force(seed):
    random = np.random.default_rng(seed)
    text = lambda n, of="abc": "".join(random.choice(list(of), n))
    samples = {"x": [text(60).encode(), text(9).encode()], "y": [text(40, "aab").encode()], "z": [text(30, "bc d").encode()]}
    texts = [text(n, "aabcdé ") for n in (1, 5, 80, 511, 512, 513, 1500)]
    got = parser_of(samples).phrases(*bytes_of(pa.array(texts)))
    assert got.tolist() == [[plain_phrases(t.encode(), s) for t in texts] for s in samples.values()]


def test_scores_equal_brute_force(spark, folder):
    """The query's rows against plain parsing of whole texts with the learnt samples' sizes."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = docs.filter(~language_id.held_out("doc_id"))
    pieces = {}
    for lang, text in known.select("lang", "text").collect():
        held = language_id.plain(pa.array([text])).to_pylist()[0]
        for at in range(0, len((held or "").encode()), language_id.PIECE):
            pieces.setdefault(lang, set()).add(held.encode()[at : at + language_id.PIECE])
    total = 4 * max(sum(map(len, p)) for p in pieces.values()) + 4 * language_id.PIECE  # every piece is learnt
    got = {r["doc_id"]: r for r in language_id.languages(docs, total).collect()}
    some = docs.filter("char_length(text) < 300").select("doc_id", "text").limit(25).collect()
    names = sorted(pieces)
    for doc_id, text in some:
        plain = (language_id.plain(pa.array([text])).to_pylist()[0] or "").encode()
        rates = [plain_phrases(plain, pieces[n]) * math.log2(sum(map(len, pieces[n])) + 1) / len(plain) for n in names]
        assert got[doc_id]["lang_pred"] == names[int(np.argmin(rates))]
        assert got[doc_id]["score"] == pytest.approx(1 - sorted(rates)[0] / sorted(rates)[1])


def test_held_out_accuracy_and_no_leak(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = entry.queries()["op11_language_id"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in got)
    # Labels of held-out rows, sources and the order of rows play no part.
    other = docs.withColumns({"lang": F.when(language_id.held_out("doc_id"), "xx").otherwise(F.col("lang")), "source": F.lit("s")}).repartition(7)
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.languages(other).collect()}
    assert again == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}


def test_copies_do_not_crowd_out_a_language(spark, docs):
    rows = [(k, "the very same words again and again") for k in range(400)] + [(1000 + k, f"other words of number {chr(97 + k)} here") for k in range(20)]
    known = docs(rows)
    parser = language_id.learnt(known, total=600)
    assert parser.languages == ["en"] and 2 ** parser.bits[0] > 300


def test_odd_rows(spark, odd, docs, empty):
    got = {r["doc_id"]: r for r in language_id.languages(odd).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 8)] == ["und"] * 4 and got[8]["score"] == 0
    assert got[5]["lang_pred"] == "en" and got[5]["score"] == 1 and got[None]["held_out"] is False
    nothing = language_id.languages(docs([(1, "abc"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)] * 2
    assert language_id.languages(empty).count() == 0
