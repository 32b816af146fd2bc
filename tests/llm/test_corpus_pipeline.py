"""The corpus pipeline, stage by stage, and planted cases."""

import subprocess
import sys

import corpus_pipeline
from tests.llm.conftest import ODD


def test_stages_keep_the_columns_and_only_real_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder).cache()
        assert out.columns == docs.columns, name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        kept = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= ids, name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_planted_cases(spark, docs, folder):
    clean = [(i, " ".join(f"word{i}of{k * 31 % 997}" for k in range(200))) for i in range(1, 20)]
    passage = " ".join(f"shared{k}" for k in range(60))
    rows = clean + [(50, clean[0][1]), (51, f"{passage} {clean[1][1][::-1]}"), (52, f"{clean[2][1][::-1]} {passage}"), (53, "junk " * 50), (54, "short")]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs(rows), folder)
    left = {r["doc_id"] for r in good.collect()}
    assert not left & {53, 54} and {i for i, _ in clean} <= left
    unique = {r["doc_id"] for r in stages["simhash_near_dedup"](spark, good, folder).collect()}
    assert 50 not in unique and {i for i, _ in clean} <= unique
    cut = {r["doc_id"]: r for r in stages["substring_dedup"](spark, good, folder).collect()}
    assert passage in cut[51]["text"] and "shared0 " not in cut[52]["text"] and cut[52]["n_chars"] == len(cut[52]["text"])
    assert all(cut[i]["text"] == t for i, t in clean)


def test_odd_rows_pass_every_stage(spark, docs, folder):
    given = {(r["doc_id"], r["lang"], r["source"], r["row"], r["n_words"]) for r in docs(ODD).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs(ODD), folder)
        rows = out.collect()
        assert out.columns == docs(ODD).columns and 0 < len(rows) <= len(ODD), name
        assert {(r["doc_id"], r["lang"], r["source"], r["row"], r["n_words"]) for r in rows} <= given, name
        assert stage(spark, docs(ODD).filter("doc_id < 0"), folder).count() == 0, name
    name, pack = corpus_pipeline.STAGES[-1]
    assert {r["doc_id"] for r in pack(spark, docs(ODD), folder).collect()} == {i for i, _ in ODD}, name
    assert pack(spark, docs(ODD).filter("doc_id < 0"), folder).count() == 0, name


def test_the_rest_imports_without_the_corpus_part():
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None\n"
        "import builtins, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('tidewarden.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "del sys.modules['corpus_pipeline']; sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and 'w1_flow_windows' in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])
