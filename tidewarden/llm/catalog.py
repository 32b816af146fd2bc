"""The registered corpus queries and, where SQL can express them, the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import (
    fuzzy_hash, hilbert, language_id, mixing, packing, quality_model, quality_rules, repeats, resampling, simhash, spelling,
    token_counts, url_templates,
)

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TARGETS = {
    "source": {"src0": 0.3},
    "lang": {"en": 0.57, "de": 0.17, "fr": 0.15, "es": 0.1},
    "topic": {"t0": 0.25, "t1": 0.25, "t2": 0.25, "t3": 0.25},
}


def tokenizer_file(name: str) -> str:
    """Where an installed public tokenizer's file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_substring_dedup", r"""with words as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
places as (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from words),
windows as (select doc_id, i, min(doc_id) over (partition by list_aggregate(ws[i:i + 12], 'string_agg', ' ')) as first from places),
gone as (select distinct doc_id, i + k as i from windows, unnest(range(0, 13)) u(k) where first < doc_id),
flat as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from words),
kept as (select f.doc_id, string_agg(f.w, ' ' order by f.i) as t from flat f anti join gone g on f.doc_id = g.doc_id and f.i = g.i group by 1),
cut as (select doc_id, count(*) as n from gone group by 1)
select doc_id, len(ws)::bigint as n_words, coalesce(c.n, 0)::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from words left join kept k using (doc_id) left join cut c using (doc_id)""")
def _(spark, sf_dir):
    kept = repeats.repeat_digest(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_mixing")
def _(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents"), TARGETS)


@query("op2_fuzzy_hash")
def _(spark, sf_dir):
    return fuzzy_hash.compare_with_edits(table(spark, sf_dir, "documents"))


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


@query("op5_url_templates")
def _(spark, sf_dir):
    return url_templates.judged(table(spark, sf_dir, "pages"), URL_RULES)


@query("op7_token_counts")
def _(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op8_quality_model")
def _(spark, sf_dir):
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_hilbert_shards")
def _(spark, sf_dir):
    found = hilbert.sharded(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


@query("op6_packing")
def _(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op3_simhash")
def _(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)


WORDS_SQL = r"""docs as (select doc_id, coalesce(text, '') as t from documents),
words as (select doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from docs)"""

@query("op10_quality_rules", f"""with {WORDS_SQL},
places as (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from words),
windows as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]) as n from places),
covered as (select doc_id, count(distinct i + k) as n from windows, unnest(range(0, 5)) u(k) where windows.n > 1 group by doc_id),
lines as (select doc_id, len(l) as n_lines, len(l) - len(list_distinct(l)) as dup from (
  select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from docs)),
measures as (select w.doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, dup::bigint as n_dup_lines,
  coalesce(c.n, 0)::bigint as n_repeat_words, n_lines::bigint as n_lines from words w join lines using (doc_id) left join covered c using (doc_id)),
bits as (select *, (case when n_words < 10 then 1 else 0 end) + (case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end)
  + (case when 100 * n_symbols > 10 * n_words then 4 else 0 end) + (case when 100 * n_dup_lines > 50 * n_lines then 8 else 0 end)
  + (case when word_chars > 30 * n_words then 16 else 0 end) as failed from measures)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 as base_failed, failed = 0 as kept,
  failed::bigint as failed from bits""")
def _(spark, sf_dir):
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(
        "doc_id", *measures, (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes().alias("kept"), "failed"
    )


@query("op11_language_id")
def _(spark, sf_dir):
    return language_id.languages(table(spark, sf_dir, "documents"))


# CRC-32 in SQL: the checksums of all single bytes by eight halvings, and the fold of a text's bytes over them.
HALVED = "select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from ("
CRC_TABLE_SQL = f"crc_table as (select list(c order by i) as tab from ({HALVED * 8}select i, i::bigint as c from range(256) r(i){')' * 8}))"


def crc_sql(text: str) -> str:
    """The checksum of a text's UTF-8 bytes, where ``crc_table`` is joined."""
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode({text}))),
  lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
RUN_WORDS_SQL = rf"list_filter(string_split_regex({LOWER_SQL}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def runs_sql(table: str, columns: str = "") -> str:
    return f"""select {columns}array_to_string(ws[i:i + k - 1], ' ') as run
  from (select {columns}ws, k, unnest(range(1, len(ws) - k + 2)) as i from {table}, range(1, 4) r(k))"""


@query("op12_resampling", f"""with {CRC_TABLE_SQL},
docs as (select doc_id, {RUN_WORDS_SQL} as ws from documents),
target as (select {RUN_WORDS_SQL} as ws from benchmark),
runs as ({runs_sql("docs", "doc_id, ")}),
target_runs as ({runs_sql("target")}),
known as (select run, {crc_sql("run")} % 10000 as bucket from (select run from runs union select run from target_runs), crc_table),
held as (select doc_id, bucket from runs join known using (run)),
s as (select bucket, count(*) as s from held group by 1),
t as (select bucket, count(*) as t from target_runs join known using (run) group by 1),
gains as (select bucket, floor(1000 * ln((coalesce(t, 0)::double + 1) * ((select count(*) from held)::double + 10000)
  / ((s::double + 1) * ((select count(*) from target_runs)::double + 10000))))::bigint as gain from s left join t using (bucket)),
weights as (select doc_id, count(*)::bigint as n_features, sum(gain)::bigint as weight from held join gains using (bucket) group by 1),
scored as (select doc_id, len(ws) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score
  from docs left join weights using (doc_id)),
placed as (select *, n_words >= 20 as long, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place,
  count(*) over (partition by n_words >= 20) as n from scored)
select doc_id, n_features, weight, score, case when long and place <= 5 * n // 100 then place end::bigint as rank from placed""")
def _(spark, sf_dir):
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_spelling_variants", f"""with recursive {CRC_TABLE_SQL},
runs as (select doc_id, unnest(regexp_extract_all({LOWER_SQL}, '[a-z\u00C0-\u00FF]+')) as run from documents),
digests as (select doc_id, run, {crc_sql("(doc_id || ':' || run)")} as h from (select distinct doc_id, run from runs), crc_table),
counted as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, count(*) as n
  from runs join digests using (doc_id, run) group by 1),
words as (select word, n from counted where length(word) >= 5 and n >= 3),
holes as (select word, k, substr(word, 1, k) || substr(word, k + 2) as rest from words, unnest(range(0, length(word))) u(k)),
shorter as (select distinct h.word as a, w.word as b from holes h join words w on h.rest = w.word),
near as (select a.word as a, b.word as b from holes a join holes b on a.rest = b.rest and a.k = b.k and a.word <> b.word
  union select a, b from shorter union select b, a from shorter),
ranked as (select a as word, b, w.n as m, count(*) over (partition by a) as n_near, row_number() over (partition by a order by w.n desc, b) as k
  from near join words w on w.word = b),
formed as (select word, n, case when m >= 2 * n then b end as form, coalesce(n_near, 0)::bigint as n_near, case when m >= 2 * n then m end::bigint as form_n
  from words left join (from ranked where k = 1) using (word)),
chain(word, last) as (select word, word from formed union all select c.word, f.form from chain c join formed f on f.word = c.last where f.form is not null)
select f.word, f.n::bigint as n, f.form, c.last as root, f.n_near, f.form_n from formed f join chain c using (word)
  where not exists (from formed g where g.word = c.last and g.form is not null)""")
def _(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))
