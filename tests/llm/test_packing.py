import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_helpers import edge_rows
from sievekit.llm import packing
from sievekit.llm.queries import op13_packing, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def plain(lengths, capacity):
    """First fit by looking at every bin in turn."""
    bins, out = [], []
    for n in lengths:
        at = next((i for i, used in enumerate(bins) if used + n <= capacity), len(bins))
        bins += [0] * (at == len(bins))
        out.append((at, bins[at]))
        bins[at] += n
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_tree_equals_first_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    assert packing.first_fit_decreasing(lengths, 50) == plain(lengths, 50)


def test_tree_sizes():
    for n in (1, 2, 3, 4, 5, 31, 32, 33):
        assert packing.first_fit_decreasing([50] * n, 50) == [(i, 0) for i in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=200))
def test_ids_of_any_text(text):
    test_ids_of_any_text.t = t = getattr(test_ids_of_any_text, "t", None) or Tokenizer.from_file(tokenizer_path())
    assert packing.tokens(tokenizer_path())(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_ids_of_long_runs(library):
    encode = packing.tokens(tokenizer_path())
    draw = random.Random(3)
    for text in (" " * 300_000, " \n" * 150_000 + "x", "ab" * 5000, "=" * 20_000, "a<|endoftext|>" * 50,
                 "".join(draw.choice(" \t\na") for _ in range(5000))):
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def want_ids(library, rows):
    return [(i, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(pieces, documents, size):
    """Each id in one piece, sequences gapless and within the size."""
    cut = sorted((str(i), len(ids), at, crc(ids[at:at + size]), len(ids[at:at + size]))
                 for i, ids in documents for at in range(0, len(ids), size))
    assert sorted((str(p.doc_id), p.doc_tokens, p.start, p.ids_crc32, p.length) for p in pieces) == cut
    held = {}
    for p in pieces:
        held.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in held.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= size
    return len(held)


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    documents = want_ids(library, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    n = check(op13_packing(spark, SF).collect(), documents, packing.SEQUENCE)
    assert n <= sum(len(ids) for _, ids in documents) / packing.SEQUENCE + 2  # one group: one bin partly empty


@pytest.mark.parametrize("size, group", [(64, 5), (2048, 4096), (1, 3)])
def test_edge_rows(spark, edge_docs, library, size, group):
    rows = [(i, t) for i, t in edge_rows() if size > 1 or len(t or "") < 1000]
    docs = edge_docs.where("text is null or length(text) < 1000") if size == 1 else edge_docs
    check(packing.report(docs, tokenizer_path(), size, group).collect(), want_ids(library, rows), size)


def test_equals_plain_packing(spark, edge_docs):
    """One group: the sequences are those of the plain rule."""
    got = [r for r in packing.report(edge_docs, tokenizer_path(), 512, 10**6).collect() if r.length < 512]
    want = plain(sorted((r.length for r in got), reverse=True), 512)
    assert sorted((r.length, r.offset) for r in got) == sorted(
        (n, at) for n, (_, at) in zip(sorted((r.length for r in got), reverse=True), want))
    assert len({r.sequence_id for r in got}) == len({b for b, _ in want})


def test_sequences(spark, edge_docs, library):
    documents = {}
    for i, ids in want_ids(library, edge_rows()):
        documents.setdefault(i, []).append(ids)
    for r in packing.sequences(edge_docs, tokenizer_path(), 256, 8).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.n_tokens <= 256
        for s in r.spans:
            assert any(ids[s.offset:s.offset + s.length] == d[s.start:s.start + s.length] for d in documents[s.doc_id])


def test_one_key_holds_most_rows(spark):
    """Repeated rows are dealt over the groups like any others."""
    docs = spark.range(3000).selectExpr("if(id % 3 > 0, 7, id) doc_id", "repeat('word ', int(id % 3 * 100)) text")
    got = packing.report(docs, tokenizer_path(), 256, 100).collect()
    assert len(got) >= 3000 and sum(r.length for r in got) == sum(
        r.doc_tokens for r in got if r.start == 0)
    groups = {}
    for r in got:
        if r.length < 256:
            groups[r.sequence_id >> 33] = groups.get(r.sequence_id >> 33, 0) + 1
    assert len(groups) == 30 and max(groups.values()) < 200


def test_no_rows(spark, no_docs):
    assert packing.report(no_docs, tokenizer_path()).collect() == []
    assert packing.sequences(no_docs, tokenizer_path()).collect() == []
