import hashlib
from collections import defaultdict

import pytest

from llm_helpers import edge_rows, rows_of
from sievekit.llm import exact_dedup as ed


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[ed.normalise(text)].append((-len(text or ""), doc_id is None, doc_id or 0))
    best = {body: min(g) for body, g in groups.items()}
    return {(doc_id, None if best[b][1] else best[b][2], len(groups[b]), hashlib.sha256(b).hexdigest())
            for doc_id, text in rows for b in [ed.normalise(text)]}


@pytest.mark.parametrize("options", [{}, {"key_bits": 2}, {"min_capacity": 200, "max_buckets": 64}])
def test_edge_rows(edge_docs, options):
    """With 2 key bits most texts share a key: chains must tell them apart."""
    got = ed.exact_dedup(edge_docs, **options).collect()
    assert len(got) == len(edge_rows())
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got} == brute(edge_rows())
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_hot_text(spark):
    """A third of all rows are one text; white space and length decide who stays."""
    rows = [(i, "a b" if i % 6 else "a  b") if i % 3 == 0 else (i, f"text {i % 700}") for i in range(6000)]
    got = ed.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()} == brute(rows)
    assert got.where("kept").count() == len({ed.normalise(t) for _, t in rows})


def test_one_text_in_a_million_rows(spark):
    """Lists of ids stay bounded although one partition holds a single text."""
    docs = spark.range(1_000_000).coalesce(1).selectExpr("id doc_id", "'same' text", "id uid")
    entries = docs.mapInArrow(ed._entries(ed.KEY_BITS), ed.ENTRY).selectExpr("rows", "size(ids) n").collect()
    assert sum(e.rows for e in entries) == 1_000_000 and max(e.n for e in entries) <= 2 * ed.BATCH_ROWS
    got = ed.exact_dedup(docs.select("doc_id", "text"))
    assert got.selectExpr("count(*)", "max(group_size)", "count_if(kept)", "max(keep_id)").first() == (
        1_000_000, 1_000_000, 1, 0)


def test_directory_splits_overfull_buckets(spark):
    rows = [(k << 50, "x" * 1000) for k in range(256)] + [(7, "y")]
    entries = spark.createDataFrame(rows, "key long, body string").selectExpr("key", "cast(body as binary) body")
    starts = ed.build_directory(entries, 60, 40_000, 64)
    assert starts[0] == 0 and starts == sorted(set(starts)) and len(starts) > 4
    sizes = [sum(1064 for k, b in rows if lo <= k < hi) for lo, hi in zip(starts, [*starts[1:], 1 << 60])]
    assert max(sizes) <= 40_000


def test_empty_table(no_docs):
    assert rows_of(ed.exact_dedup(no_docs)) == []
