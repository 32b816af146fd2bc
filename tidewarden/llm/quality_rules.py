"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule. A
policy is a named, versioned set of rules, so a new policy, or the question what a rule alone removes, is a
bitwise look at the ledger and never another pass over the texts. Everything is one projection of built-in
functions: no shuffle, no Python.

Defined cases: a null or empty text has no words and all measurements 0, so it fails ``few_words``. Documents
are judged one by one: repeated rows and null ids are judged like any other. Very long texts are measured
whole. Extra columns, whatever their names, pass through ``keep_good`` unchanged. An empty table gives an
empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.words import packed_rows, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _rules() -> dict[str, Column]:
    """Rule name -> failed, over the measurements; the position is the rule's bit."""
    c = F.col
    return {
        "few_words": c("n_words") < 10,
        "repeated_windows": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "many_symbols": 100 * c("n_symbols") > 10 * c("n_words"),
        "repeated_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
        "long_words": c("word_chars") > 30 * c("n_words"),
    }


RULES = ["few_words", "repeated_windows", "many_symbols", "repeated_lines", "long_words"]
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "2": ["few_words", "repeated_windows", "many_symbols"],
    "3": RULES,
}
LATEST = "3"


def mask_of(rules: Iterable[str]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Append the measurements of ``text`` (all long) to the other columns, in place of the text.

    Words in repeated windows: hashes of the words, then of five neighbouring hashes; only a document in which
    some window hash comes twice sorts its (hash, place) pairs and counts the words that such windows cover.
    """
    rest = [c for c in df.columns if c != text]
    body = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    parts = body.select(
        *rest,
        words_of(F.col(text)).alias("_words"),
        F.char_length(F.translate(F.col(text), " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(F.col(text), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    counted = parts.select(
        *rest, "word_chars", "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    hashes = F.col("_hashes")
    windows = counted.withColumn(
        "_windows",
        F.when(F.size(hashes) >= WINDOW, F.transform(
            F.slice(hashes, 1, F.size(hashes) - (WINDOW - 1)),
            lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]),
        )).otherwise(F.array().cast("array<bigint>")),
    ).drop("_hashes")
    places = windows.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )).drop("_windows")
    pairs = F.col("_sorted")

    def twice(pair: Column, i: Column) -> Column:
        before = F.coalesce(F.when(i > 0, F.get(pairs, i - 1)["h"]) == pair["h"], F.lit(False))
        return before | F.coalesce(F.get(pairs, i + 1)["h"] == pair["h"], F.lit(False))

    repeated = places.withColumn(
        "_starts", F.sort_array(F.transform(F.filter("_sorted", twice), lambda p: p["i"]))
    ).drop("_sorted")
    starts = F.col("_starts")
    covered = F.aggregate(
        F.transform(starts, lambda s, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), s - F.get(starts, i - 1)))),
        F.lit(0).cast("long"), lambda total, n: total + n,
    )
    return repeated.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).select(*rest, *MEASURES)


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, the measurements and ``failed``, the bits of the rules it fails."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _with_bits(measured(slim))


def _with_bits(df: DataFrame) -> DataFrame:
    bits = [F.when(failed, F.lit(1 << RULES.index(name))).otherwise(F.lit(0)) for name, failed in _rules().items()]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return df.withColumn("failed", total.cast("long"))


def passes(version: str = LATEST) -> Column:
    """Whether a ledger row passes the policy of that version."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[version]))) == 0


def ablations(rows: DataFrame, version: str = LATEST) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it removes. One aggregation."""
    mask = mask_of(POLICIES[version])
    under = F.col("failed").bitwiseAND(F.lit(mask))
    named = [(r, 1 << RULES.index(r)) for r in POLICIES[version]]
    sums = rows.agg(*[
        F.struct(
            F.lit(version).alias("version"), F.lit(r).alias("rule"),
            F.count(F.when(under.bitwiseAND(F.lit(bit)) != 0, 1)).alias("failed"),
            F.count(F.when(under == bit, 1)).alias("only_this"),
        ).alias(r) for r, bit in named
    ])
    return sums.select(F.inline(F.array(*[r for r, _ in named])))


def keep_good(docs: DataFrame, version: str = LATEST, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the policy, with exactly their columns.

    The row number stops the optimizer from moving the condition below the measurements, where it would put each
    measurement's definition into every place that uses it.
    """
    judged = _with_bits(measured(packed_rows(docs, text=F.col(text)))).withColumn("n", F.monotonically_increasing_id())
    return judged.filter(passes(version) & (F.col("n") >= 0)).select("row.*")
