"""The registered corpus queries against their SQL or against plain versions."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from tests.llm.conftest import ODD
from tools.check_oracle import TABLES, normal
from tidewarden.llm import fuzzy_hash, hilbert, mixing, packing, quality_model, quality_rules, repeats, simhash, token_counts, url_templates
from tidewarden.llm.catalog import TARGETS, URL_RULES, tokenizer_file


@pytest.fixture(scope="module")
def con(folder):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op10_quality_rules", "op12_resampling", "op13_spelling_variants"])
def test_query_equals_sql(spark, folder, con, name):
    got = entry.queries()[name](spark, folder).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


def test_every_number_is_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


# --- substring dedup


def brute_repeats(rows, window):
    words = [(i, (t or "").split()) for i, t in rows]
    first = {}
    for i, w in words:
        for s in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[s : s + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {s + k for s in range(len(w) - window + 1) if i is not None and first[tuple(w[s : s + window])] < i for k in range(window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [5, 13])
def test_repeats_equal_brute_force(docs, window):
    random = np.random.default_rng(3)
    passage = [f"p{k}" for k in range(60)]
    rows = [r for r in ODD if not (r[1] and "\x0b" in r[1])]
    for i in range(20, 60):
        words = [f"w{random.integers(0, 40)}" for _ in range(random.integers(0, 80))]
        if i % 3 == 0:
            at = random.integers(0, 40)
            words[len(words) // 2 : len(words) // 2] = passage[at : at + random.integers(5, 20)]
        rows.append((i, " ".join(words)))
    got = [tuple(r) for r in repeats.repeat_digest(docs(rows), window).collect()]
    assert sorted(got, key=repr) == brute_repeats(rows, window)


def test_cutting_keeps_rows_columns_and_other_white_space(docs):
    passage = " ".join(f"q{k}" for k in range(60))
    df = docs([(1, f"a\n{passage}\nb"), (2, f"x\n\ty {passage}\n\nz  w"), (3, "nothing\n shared  here"), (4, None)])
    out = {r["doc_id"]: r for r in repeats.without_repeats(df).collect()}
    assert out[1]["text"] == f"a\n{passage}\nb" and out[2]["text"] == "x\n\ty\n\nz  w" and out[3]["text"] == "nothing\n shared  here"
    assert out[4]["text"] is None or out[4]["text"] == ""
    assert out[2]["row"] == "mine" and out[2]["n_words"] == 7 and len(out) == 4


# --- near-duplicates


def plain_simhash(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, bits=3):
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(prints[i] ^ prints[j]).count("1") <= bits and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    named = {}
    for i, x in zip(ids, label):
        if i is not None:
            named[x] = min(named.get(x, i), i)
    return [named.get(x) for x in label]


def test_simhash_query_equals_brute_force(spark, folder, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in entry.queries()["op3_simhash"](spark, folder).collect()}
    prints = [plain_simhash(t, 3) for _, t in texts]
    want = plain_components([i for i, _ in texts], prints)
    assert got == {i: (f"{p:016x}", c) for (i, _), p, c in zip(texts, prints, want)}


def test_links_at_up_to_three_bits_are_all_found(spark):
    random = np.random.default_rng(5)
    base = [int(x) for x in random.integers(0, 2**63, 40)] + [0]
    prints = list(base)
    for b in base:  # neighbours at exactly 1 to 4 bits, in chains
        for n in range(1, 5):
            x = b
            for bit in random.choice(64, n, replace=False):
                x ^= 1 << int(bit)
            prints.append(x)
    signed = [(i, int(np.array(p, np.uint64).view(np.int64))) for i, p in enumerate(prints)]
    got = dict(simhash.linked(spark.createDataFrame(signed, "doc_id long, fp long")).select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(prints))] == plain_components(list(range(len(prints))), prints)


def test_a_group_larger_than_a_block_stays_one(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    prints = [(i, i << 40) for i in range(128)]  # differ in seven bits of the upper half
    got = simhash.linked(spark.createDataFrame(prints, "doc_id long, fp long"))
    assert {r["component_id"] for r in got.collect()} == {0}


def test_one_document_of_each_group_stays(docs, odd, empty):
    text = " ".join(f"w{k}" for k in range(300))
    df = docs([(5, text), (3, text), (9, text.replace("w7 ", "w7 ")), (4, "quite another text of its own"), (4, "quite another text of its own")])
    kept = simhash.keep_first(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4] and kept.columns == df.columns
    assert simhash.keep_first(empty).count() == 0 and None in [r["doc_id"] for r in simhash.keep_first(odd).collect()]


# --- fingerprints


def plain_likeness(x, y):
    if x == y:
        return 1.0
    (s, a1, a2), (t, b1, b2) = x.split(":"), y.split(":")
    s, t = int(s), int(t)
    best = 0.0
    for a, b in [(a1, b1), (a2, b2)] if s == t else [(a1, b2)] if s == 2 * t else [(a2, b1)] if t == 2 * s else []:
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = table[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(table[i - 1][j], table[i][j - 1])
        need = min(max(min(len(a), len(b)) // 4, 1), 7)
        run = any(a[i : i + need] in b for i in range(len(a) - need + 1))
        if a and b and run:
            best = max(best, 2 * table[-1][-1] / (len(a) + len(b)))
    return best


def plain_fingerprint(data):
    """Byte by byte: a rolling hash of seven bytes cuts, a polynomial of a piece's bytes names its character."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rolled = []
    for i in range(len(data)):
        total = 0
        for j in range(i - 6, i + 1):
            total = (total * 0x01000193 + (data[j] if j >= 0 else 0) + 1) % 2**32
        total = (total ^ total >> 15) * 0x2C1B3C6D % 2**32
        rolled.append(total ^ total >> 12)

    def signature(size):
        out, start = "", 0
        for i in range(len(data)):
            last = i == len(data) - 1
            if last or (rolled[i] % size == size - 1 and len(out) < 63):
                value = sum((b + 1) * pow(0x5851F42D4C957F2D, k, 2**64) for k, b in enumerate(data[start : i + 1])) % 2**64
                value = (value ^ value >> 29) * 0xBF58476D1CE4E5B9 % 2**64
                out, start = out + letters[value >> 58], i + 1
        return out

    size = 3
    while size * 64 < len(data):
        size *= 2
    while size > 3 and sum(r % size == size - 1 for r in rolled) + 1 < 32:
        size //= 2
    return f"{size}:{signature(size)}:{signature(2 * size)}"


def test_fingerprints_equal_a_plain_version(texts):
    bodies = [t.encode() for _, t in texts if len(t) < 3000][:60] + [b"", b"a", b"same " * 400, bytes(range(256)) * 5, b"x" * 1000]
    assert [fuzzy_hash.fingerprint(b) for b in bodies] == [plain_fingerprint(b) for b in bodies]


def test_edits_and_likeness(spark, folder, texts):
    got = {r["doc_id"]: r for r in entry.queries()["op2_fuzzy_hash"](spark, folder).collect()}
    assert len(got) == len(texts)
    prints = [fuzzy_hash.fingerprint(t.encode()) for _, t in texts]
    for k, (i, t) in enumerate(texts):
        after, half = texts[(k + 1) % len(texts)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        row = got[i]
        assert row["n_chars"] == len(t) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == prints[k] and row["edited_fingerprint"] == fuzzy_hash.fingerprint(edited.encode())
        assert row["near_next"] == pytest.approx(plain_likeness(prints[k], prints[(k + 1) % len(texts)]))
        assert row["near_edited"] == pytest.approx(plain_likeness(prints[k], row["edited_fingerprint"]))


def test_an_edit_moves_few_characters():
    random = np.random.default_rng(1)
    text = bytes(random.integers(97, 123, 20_000, dtype=np.uint8))
    near, far = text[:9000] + b"inserted" + text[9000:], bytes(random.integers(97, 123, 20_000, dtype=np.uint8))
    values = fuzzy_hash.likeness([fuzzy_hash.fingerprint(text)] * 2, [fuzzy_hash.fingerprint(near), fuzzy_hash.fingerprint(far)])
    assert values[0] > 0.9 and values[1] < 0.1


def test_fingerprints_of_odd_rows(odd, empty):
    rows = fuzzy_hash.compare_with_edits(odd).collect()
    assert len(rows) == len(ODD) and {r["fingerprint"] for r in rows if r["n_chars"] == 0} == {"3::"}
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert fuzzy_hash.compare_with_edits(empty).count() == 0


def edits_of(rows):
    """The checksums of all edited texts of (id, text), in the order of (id, text hash), null ids first."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).view(np.int64)))
    out = []
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        out.append((i, hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
    return sorted(out, key=str)


def edits_got(found):
    return sorted(((r["doc_id"], r["edited_sha256"]) for r in found.collect()), key=str)


def test_more_ranges_than_an_expression_is_deep(docs, monkeypatch):
    monkeypatch.setattr(fuzzy_hash, "RANGE", 32)  # 40 KB in 1,300 ranges
    rows = [(i, f"text {i} " + "abcdef"[i % 6] * (i % 30)) for i in range(2000)]
    assert edits_got(fuzzy_hash.compare_with_edits(docs(rows))) == edits_of(rows)


def test_copies_without_an_id_are_dealt_over_ranges(docs):
    rows = [(None if i % 3 else i, "the same text" if i % 2 else f"text {i % 50} of some") for i in range(3000)] + [(7, "again")] * 500
    assert edits_got(fuzzy_hash.compare_with_edits(docs(rows))) == edits_of(rows)
    sizes = [r["count"] for r in fuzzy_hash._ranges(docs(rows), "doc_id", "text").groupBy("part").count().collect()]
    assert sum(sizes) == 3500 and max(sizes) < 3 * 3500 / fuzzy_hash.MIN_RANGES


@pytest.mark.parametrize("rows", [[(1, "alone in its table")], [(2, "second"), (1, None)], ODD])
def test_ends_of_few_rows_meet(docs, rows):
    assert edits_got(fuzzy_hash.compare_with_edits(docs(rows))) == edits_of(rows)


# --- mixing


def test_raking_meets_all_margins():
    tokens = np.array([[[50.0, 10], [5, 20]], [[30, 30], [10, 45]]])
    margins = [np.array([0.4, 0.6]), np.array([0.6, 0.4]), np.array([0.5, 0.5])]
    got = mixing.raked(tokens, margins, 0.5)
    assert (got <= tokens + 1e-9).all()
    for axis, m in enumerate(margins):
        assert np.allclose(got.sum(axis=tuple(i for i in range(3) if i != axis)) / got.sum(), m, atol=1e-6)


def test_scarce_values_shrink_the_sample_and_not_the_targets():
    langs, others = np.array([0.93, 0.02, 0.03, 0.02]), np.array([0.3, 0.7])
    tokens = 1e6 * langs[None, :, None] * others[:, None, None] * np.full(4, 0.25)
    margins = [np.array([0.3, 0.7]), np.array([0.58, 0.17, 0.15, 0.1]), np.full(4, 0.25)]
    got = mixing.raked(tokens, margins, 0.75)
    assert (got <= tokens * (1 + 1e-9)).all()
    for axis, m in enumerate(margins):
        assert np.allclose(got.sum(axis=tuple(i for i in range(3) if i != axis)) / got.sum(), m, atol=1e-5)
    assert 0.99 * 0.02 / 0.17 < got.sum() / tokens.sum() < 1.01 * 0.02 / 0.17  # no larger sample can have them
    with pytest.warns(UserWarning, match="no weights can meet"):
        mixing.raked(np.array([[1.0, 0], [0, 3]]), [np.array([0.5, 0.5]), np.array([0.2, 0.8])], 0.75)


def test_mixture_has_the_target_shares(spark, folder):
    rows = mixing.mixture(spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet"), TARGETS, keep=0.6).toPandas()
    expected = rows.n_tokens * rows.probability
    assert abs(expected.sum() / rows.n_tokens.sum() - 0.6) < 0.01
    for lang, share in TARGETS["lang"].items():
        assert abs(expected[rows.lang == lang].sum() / expected.sum() - share) < 0.01
    assert abs(rows.selected.mean() - rows.probability.mean()) < 0.05 and rows.probability.between(0, 1).all()


def test_registered_mixture_meets_every_target(spark, folder):
    rows = entry.queries()["op4_mixing"](spark, folder.replace("sf0.001", "sf0.01")).toPandas()
    for column in (rows.n_tokens * rows.weight, rows.n_tokens * rows.probability):
        assert abs(column[rows.source == "src0"].sum() / column.sum() - 0.3) < 1e-4
        for axis in ("lang", "topic"):
            for value, share in TARGETS[axis].items():
                assert abs(column[rows[axis] == value].sum() / column.sum() - share / sum(TARGETS[axis].values())) < 1e-4


def test_sampling_odd_rows(odd, empty):
    out = mixing.sample(odd, {}, keep=1.0)
    assert out.columns == odd.columns and out.count() == len(ODD) and mixing.sample(empty, TARGETS).count() == 0


# --- packing


def test_packing_is_whole_gapless_and_tight(spark, folder, texts):
    from tokenizers import Tokenizer

    got = entry.queries()["op6_packing"](spark, folder).toPandas()
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = set()
    for i, t in texts:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        want |= {(i, k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()))
                 for k, s in enumerate(range(0, len(ids), 4096))}
    assert {tuple(r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)} == want
    ordered = got.sort_values(["sequence_id", "offset"])
    before = ordered.groupby("sequence_id").length.cumsum() - ordered.length
    assert (before == ordered.offset).all() and got.groupby("sequence_id").length.sum().max() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1


def test_two_pieces_replace_the_smallest():
    counts = np.zeros(11, np.int64)
    for n in (6, 3, 2, 2):  # greedy would leave 6 + 3; 6 + 2 + 2 is full
        counts[n] += 1
    assert sorted(map(sorted, packing.best_two_fit(counts, 10))) == [[2, 2, 6], [3]]


def test_packing_uses_every_piece_once():
    random = np.random.default_rng(2)
    sizes = random.integers(1, 101, 3000)
    bins = list(packing.best_two_fit(np.bincount(sizes, minlength=101), 100))
    assert sorted(x for b in bins for x in b) == sorted(sizes) and max(map(sum, bins)) <= 100
    assert len(bins) <= 1.01 * sizes.sum() / 100 + 1


def test_tokens_of_odd_texts():
    import pyarrow as pa

    known = packing.WordIds(tokenizer_file("word_bpe_49k.json"))
    odd = ["It's don't 'tis 's.", "<|endoftext|> <|ENDOFTEXT|>. x<|startoftext|>y", "", None, "Ångström café... ΣΑΣ. 12,5 a.b.c. !?'s x'!!", "  \n", "é. z\x0bA! ß."]
    ids, sizes = packing.token_ids(pa.array(odd, pa.large_string()), known)
    want = [e.ids for e in known.tokenizer.encode_batch([t or "" for t in odd], add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


# --- token counts


def test_token_counts_equal_greedy_longest_match(spark, folder, texts):
    pieces = set(map(tuple, token_counts.pieces_of(tokenizer_file("word_bpe_49k.json")))) | {(s,) for s in range(512)}

    def greedy(word):
        symbols, n, i = [*word[:-1], word[-1] + 256], 0, 0
        while i < len(symbols):
            i = next(j for j in range(len(symbols), i, -1) if tuple(symbols[i:j]) in pieces)
            n += 1
        return n

    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in entry.queries()["op7_token_counts"](spark, folder).collect()}
    memo = {}
    for i, t in texts:
        words = t.encode().lower().split()
        for w in words:
            memo.setdefault(w, None)
            memo[w] = memo[w] or greedy(w)
        assert got[i] == (len(words), sum(memo[w] for w in words))


def test_links_skip_back_over_several_pieces():
    built = token_counts.Automaton([list(b"abcd"), list(b"bc"), list(b"abcdef"), list(b"cde")])
    assert built.lengths([b"abcdex", b"abcdef", b"abcde", b""]).tolist() == [3, 3, 2, 0]


# --- url templates


def test_url_parts_and_rules(spark):
    urls = [None, "no scheme", "HTTP://Ex.NET/a?b#c", "x://A.example.com/de/1", "x://example.net/en/", "x://example.net", "a://b://c/d", "x://É.org/fr/é"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_templates.judged(df, URL_RULES).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("ex.net", "/a", "net/", "block"),
        3: ("a.example.com", "/de/1", "example.com/de/", "block"), 4: ("example.net", "/en/", "example.net/en/", "allow"),
        5: ("example.net", "", None, "allow"), 6: ("b:", "//c/d", None, "allow"), 7: ("É.org", "/fr/é", "org/fr/", "allow"),
    }
    assert url_templates.judged(df.filter("page_id < 0"), URL_RULES).count() == 0


def test_variable_segments_become_wildcards_and_impure_ways_are_rejected(spark):
    rows = [(i, "h", f"/shop/{i}", 1 if i < 30 else None) for i in range(40)] + [(100 + i, "h", f"/news/{i}", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, host string, path string, label int")
    ways = {r["page_id"]: r["way"] for r in url_templates.templates(df).collect()}
    assert ways[3] == ways[39] == "/shop/*" and ways[105] == "/news/*"


def test_sister_branches_of_like_rates_merge(spark):
    rows = [(k * 100 + i, "h", f"/{seg}/{i}", bad) for k, (seg, bad) in enumerate([("a", 1), ("b", 1), ("c", 0)]) for i in range(50)]
    df = spark.createDataFrame(rows, "page_id long, host string, path string, label int")
    ways = {r["way"] for r in url_templates.templates(df).collect()}
    assert ways == {"/a|b/*", "/c/*"}


def test_labelled_pages_do_not_block_the_clean_pages_beside_them(spark):
    urls = [(k, f"x://blog.example.com/de/{k}") for k in range(4)] + [(10 + k, f"x://blog.example.com/fr/{k}") for k in range(4)]
    urls += [(20 + k, f"x://many.example.com/{k}") for k in range(60)] + [(100 + k, f"x://many.example.com/de/{k}") for k in range(4)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    got = {r["page_id"]: r for r in url_templates.judged(df, {"example.com/de/": "block"}).collect()}
    assert all(got[k]["verdict"] == "block" for k in (*range(4), *range(100, 104)))
    assert all(got[k]["verdict"] == "allow" for k in (*range(10, 14), *range(20, 80)))


def test_a_small_branch_of_a_hot_host_keeps_its_template(spark):
    rows = [(i, "h", f"/big/{i}", None) for i in range(1000)] + [(2000 + i, "h", f"/de/{i}", 1) for i in range(9)]
    rows += [(3000 + 10 * k + i, "h", f"/b{k}/{i}", None) for k in range(60) for i in range(6)]
    rows += [(5000 + i, "h", "/1/2/3/4/5/6/7/8/" + "ab"[i % 2] + f"/{i}", None) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, host string, path string, label int")
    ways = {r["page_id"]: r["way"] for r in url_templates.templates(df).collect()}
    assert ways[2003] == "/de/*" and ways[3000] == "/b0/*" and ways[3590] == "/b59/*"
    assert ways[5000].endswith("/8/a/*") and ways[5001].endswith("/8/b/*")


# --- quality model


def test_held_out_accuracy(spark, folder):
    sf = folder.replace("sf0.001", "sf0.01")
    scores = entry.queries()["op8_quality_model"](spark, sf).toPandas()
    labels = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").df()
    both = scores.merge(labels, on="doc_id")
    assert (scores.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in scores.doc_id]).all()
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > max(held.quality.mean(), 0.95) and scores.score.between(0, 1).all()


def test_labels_of_held_out_rows_change_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality")
    first, second = (quality_model.quality_scores(docs, x).toPandas().sort_values("doc_id").score.to_numpy() for x in (labels, turned))
    assert np.array_equal(first, second)


def test_scores_of_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_model.quality_scores(odd, none).collect()} == {0.5}
    labels = spark.createDataFrame([(2, 1), (4, 1), (None, 0), (6, None)], "doc_id long, quality int")
    assert quality_model.quality_scores(odd, labels).count() == len(ODD) and quality_model.quality_scores(empty, labels).count() == 0


# --- sharding


def test_curve_visits_every_cell_by_neighbours():
    points = sorted(((x, y, z) for x in range(8) for y in range(8) for z in range(8)), key=lambda p: hilbert.hilbert_index(list(p), 3))
    assert sorted(hilbert.hilbert_index(list(p), 3) for p in points) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(points, points[1:]))


def test_shards_are_even_whole_and_gapless(spark, folder, texts, odd, empty):
    got = entry.queries()["op9_hilbert_shards"](spark, folder).toPandas()
    want = {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts}
    assert {r.doc_id: (r.size_, r.text_crc32) for r in got.rename(columns={"size": "size_"}).itertuples()} == want
    counts = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["min"] == 0).all()
    assert (counts["max"] == counts["count"] - 1).all() and (counts["nunique"] == counts["count"]).all()
    few = hilbert.sharded(odd, 8).toPandas()
    sizes = few.groupby("shard").slot.count()
    assert len(few) == len(ODD) and sizes.max() - sizes.min() <= 1 and hilbert.sharded(empty).count() == 0


def test_written_shards_have_narrow_boxes(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    boxes = hilbert.write_shards(docs, str(tmp_path / "out"), 4).toPandas()
    assert boxes["rows"].sum() == docs.count() and (boxes.max_size - boxes.min_size).min() < docs.toPandas().text.str.len().max()


# --- quality rules


def test_ledger_of_odd_rows(odd, empty):
    rows = {(r["doc_id"], r["n_words"]): r for r in quality_rules.ledger(odd).collect()}
    assert rows[5, 6000]["n_repeat_words"] == 6000 and rows[1, 0]["failed"] & 1 and rows[8, 15]["n_dup_lines"] == 2
    assert rows[8, 15]["n_symbols"] == 15 and rows[7, 7]["word_chars"] == 22
    assert quality_rules.ledger(empty).count() == 0 and quality_rules.keep_good(odd).columns == odd.columns


def test_ablations_are_bitwise(odd):
    rows = quality_rules.ledger(odd)
    bits = [r["failed"] for r in rows.collect()]
    for r in quality_rules.ablations(rows).collect():
        bit = 1 << quality_rules.RULES.index(r["rule"])
        assert r["failed"] == sum(b & bit > 0 for b in bits) and r["only_this"] == sum(b == bit for b in bits)
