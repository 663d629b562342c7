"""The pipeline's stages on small tables, each against its own brute force."""

import pytest

import corpus_pipeline as cp
import test_line_dedup
import test_near_dedup
from llm_helpers import edge_rows, rows_of
from sievekit.llm import line_dedup
from sievekit.llm.common import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """(stage name, its input, its result) of a run over the small tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        result = cut(stage(spark, docs, SF), "test-stage")
        out[name] = (docs, result)
        docs = result
    return out


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


def test_columns_of_documents_stay(spark, steps):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "bpe"]
    assert all(steps[n][1].schema == schema for n, _ in cp.STAGES[:-1])


def test_quality_stage_keeps_clean_documents(spark, steps):
    from sievekit.llm import quality_rules
    docs, kept = steps["quality_rules"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality_rules.judge(docs, labels)
    assert rows_of(kept, "doc_id") == rows_of(judged.where("kept"), "doc_id")
    clean = judged.where("NOT base_failed").join(labels.where("quality = 1"), "doc_id")
    assert clean.join(kept, "doc_id", "left_anti").isEmpty()


def test_line_stage(steps):
    docs, cleaned = steps["line_dedup"]
    import hashlib
    want = {x[0]: x[3] for x in map(eval, test_line_dedup.brute(pairs(docs), line_dedup.FULL))}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in pairs(cleaned)} == want
    assert cleaned.where("n_chars <> length(text)").isEmpty()


def test_near_stage(steps):
    docs, kept = steps["near_dedup"]
    want = [eval(x) for x in test_near_dedup.brute(pairs(docs), 5)]
    assert sorted(i for i, _ in pairs(kept)) == sorted(x[0] for x in want if x[3])


def test_mix_stage(steps):
    from sievekit.llm import mixing
    docs, mixed = steps["mix_sources"]
    copies = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.mix_report(docs).collect()}
    got = {}
    for i, _ in pairs(mixed):
        got[i] = got.get(i, 0) + 1
    assert got == {i: c for i, c in copies.items() if c}


def test_token_stage(steps):
    from tokenizers import Tokenizer
    from sievekit.llm.queries import tokenizer_path
    docs, tokens = steps["bpe"]
    t = Tokenizer.from_file(tokenizer_path())
    want = sorted((i, len(t.encode(x, add_special_tokens=False).ids)) for i, x in pairs(docs))
    assert sorted((r.doc_id, r.n_tokens) for r in tokens.collect()) == want


def test_run_is_the_stages(spark, steps):
    assert rows_of(cp.run(spark, SF)) == rows_of(steps["bpe"][1])


def test_stages_take_edge_rows(spark, edge_docs, no_docs):
    for name, stage in cp.STAGES:
        if name != "line_dedup":  # it sets n_chars, which these rows lack or hold as text
            assert stage(spark, edge_docs, SF).count() >= 0
        assert stage(spark, no_docs, SF).count() == 0
    assert cp.dedup_lines(spark, edge_docs, SF).count() == len(edge_rows())
