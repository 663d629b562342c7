import array
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_helpers import edge_rows
from sievekit.llm import bpe
from sievekit.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def narrow():
    """An encoder whose window is as small as the lookahead allows."""
    return bpe.Encoder(bpe.vocabulary(tokenizer_path()), window=1)


def ids_of(encoder, text, block=bpe.BLOCK):
    out = array.array("I")
    for packed in encoder.encode(text, block):
        out.frombytes(packed)
    return out.tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=200))
def test_any_text(text):
    library_ = Tokenizer.from_file(tokenizer_path()) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = library_
    e = bpe.encoder(tokenizer_path())
    want = library_.encode(text, add_special_tokens=False).ids
    assert ids_of(e, text) == want and ids_of(e, text, 16) == want
    machine = bpe.Decoder(bpe.vocabulary(tokenizer_path()))
    got = "".join([machine.feed(p) for p in e.encode(text, 16)] + [machine.feed(b"", True)])
    assert got == library_.decode(want, skip_special_tokens=False)


def test_every_code_point_splits_alike(library):
    e = bpe.encoder(tokenizer_path())
    for low in range(0, 0x110000, 1024):
        text = "".join(f" a{chr(c)}b  {chr(c)}1" for c in range(low, low + 1024) if not 0xD800 <= c < 0xE000)
        assert ids_of(e, text) == library.encode(text, add_special_tokens=False).ids, hex(low)


def test_long_pieces_stream(library, narrow):
    draw = random.Random(5)
    for alphabet in ("ab", "aeiouth", "étà", "=-", " \t\n", "the", "0123456789", "日本語"):
        text = "".join(draw.choice(alphabet) for _ in range(6000))
        want = library.encode(text, add_special_tokens=False).ids
        for block in (50, 700, 1 << 16):
            assert ids_of(narrow, text, block) == want, (alphabet, block)


def test_contractions_at_the_end_of_a_block(library):
    e = bpe.encoder(tokenizer_path())
    for text in ("we're they've she'll ''re 'r 'v 'l 'x I'd it's ", "we'll日本're they've'll'l're", "'re've'll'r'v'l" * 3):
        want = library.encode(text, add_special_tokens=False).ids
        for block in range(1, len(text) + 1):
            assert ids_of(e, text, block) == want, (text, block)
    far = "x" * (bpe.BLOCK - 8) + " they're" + " going" * 9
    for gap in range(9):
        assert ids_of(e, " " * gap + far) == library.encode(" " * gap + far, add_special_tokens=False).ids


def test_lookahead_of_a_small_merge_list():
    # ab, then bc, then cd: whether a|b stays depends on nothing further right,
    # a merge of x with b waits for ab's rivals in order of rank.
    token_of = dict(enumerate([b"a", b"b", b"c", b"d", b"cd", b"bc", b"ab"]))
    merges = {(2, 3): (0, 4), (1, 2): (1, 5), (0, 1): (2, 6)}
    assert bpe.sufficient_lookahead(merges, token_of) == 3
    assert bpe.sufficient_lookahead({(0, 1): (0, 6), (1, 2): (1, 5), (2, 3): (2, 4)}, token_of) == 1


def test_heap_and_short_merges_agree():
    v, draw = bpe.vocabulary(tokenizer_path()), random.Random(2)
    for _ in range(300):
        ids = [v.byte_id[b] for b in "".join(draw.choice("aehinorst ") for _ in range(draw.randint(0, 60))).encode()]
        assert bpe.merge_short(list(ids), v.rank_of, v.merged_of) == bpe.merge_window(list(ids), v.merges)


def test_table_turns_over(monkeypatch, library):
    monkeypatch.setattr(bpe, "TABLE_SIZE", 3)
    e = bpe.Encoder(bpe.vocabulary(tokenizer_path()))
    text = "one two three four five one two six one " * 5
    assert ids_of(e, text) == library.encode(text, add_special_tokens=False).ids and len(e.recent) <= 3


def test_report_on_edge_rows(spark, edge_docs, library):
    import hashlib
    got = bpe.report(edge_docs, tokenizer_path()).collect()
    want = []
    for doc_id, text in edge_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_ids_column(edge_docs, no_docs, library):
    got = bpe.encode_ids(edge_docs, tokenizer_path())
    assert got.columns == [*edge_docs.columns, "ids"]
    for r in got.select("text", "ids").collect():
        assert array.array("I", bytes(r.ids)).tolist() == library.encode(r.text or "", add_special_tokens=False).ids
    assert bpe.report(no_docs, tokenizer_path()).count() == 0
