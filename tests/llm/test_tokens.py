"""Operators 2, 3 and 5 against a public encoder and exact round trips."""

from __future__ import annotations

import base64

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import bpe, lexicon, token_counts, token_ids
from siftwell.llm.spark_io import vocabulary_path

PATH = vocabulary_path()
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TEXTS = ["", "hello world", "I'm you're  they'll'd 's", "  lead\n\n trail  ", "a" * 300, "x1y22 333", "été 中文字 ½ 　 z", "don't''re", "\n\n\n", "tab\t\ttab", "'", " '", "' s", "  nbsp x"]


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab 'sdmtlrve\n\t1²."), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_encoder_is_exact(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if not hasattr(test_encoder_is_exact, "e") else test_encoder_is_exact.e
    test_encoder_is_exact.e = own
    got = [ids[x:y].tolist() for _, _, ids, per in bpe.Encoder(PATH).rows(texts) for x, y in zip(np.cumsum(per) - per, np.cumsum(per), strict=True)]
    assert got == [own.encode_ordinary(t) for t in texts]


def test_long_texts_are_cut_where_it_does_not_matter(public, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 50)
    for t in [" ".join(TEXTS) * 5, "a  b" * 100, "z" * 500, " " * 300]:
        assert bpe.Encoder(PATH).encode(t) == public.encode_ordinary(t)


def test_whole_tokens_encode_alone(public):
    strings = token_counts.whole_tokens(PATH)
    assert len(strings) > 40_000
    assert all(public.encode_ordinary(s) == [public.encode_single_token(s)] for s in strings[::37])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 25), st.data())
def test_packing_round_trip(width, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**width - 1), max_size=3000)), np.int64)
    packed = token_ids.pack(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    assert token_ids.unpack(packed, width, len(ids)).tolist() == ids.tolist()


def test_random_access():
    ids = np.random.RandomState(1).randint(0, 50256, 5000)
    packed = token_ids.pack(ids, 16)
    offsets = list(range(0, len(packed), token_ids.BLOCK * 2))
    for a, b in ((0, 1), (1000, 1030), (1024, 2048), (4990, 6000), (7, 7)):
        assert token_ids.read_range(packed, offsets, 16, 5000, a, b).tolist() == ids[a:b].tolist()


def test_automaton():
    words = [b"", b"cat", b"cats", b"bat", b"bats", b"rat", b"\xff\x00"]
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        f.write(lexicon.compile_lexicon(words, [[i, i + 1] for i in range(len(words))]))
        f.flush()
        lex = lexicon.Lexicon(f.name)
        ids, counts, had = lex([*words, b"ca", b"catss", b"dog"])
    assert had.tolist() == [False] + [True] * 6 + [False] * 3  # the empty word is never looked up
    assert ids.tolist() == [x for i in range(1, 7) for x in (i, i + 1)]
    assert len(lex.final) < sum(map(len, words))  # suffixes are shared
    with tempfile.NamedTemporaryFile() as f:
        f.write(lexicon.compile_lexicon([], []))
        f.flush()
        assert not lexicon.Lexicon(f.name)([b"x"])[2].any()


def test_odd_rows(odd, public):
    rows = odd.select("doc_id", "text").collect()
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1:]))
    want = sorted(((r.doc_id, public.encode_ordinary(r.text or "")) for r in rows), key=key)
    enc = lexicon.encode_documents(odd, words=10)
    assert sorted(((r.doc_id, r.token_ids) for r in enc.collect()), key=key) == want
    assert all(r.round_trip for r in enc.collect())
    back = {(r.doc_id, r.text) for r in lexicon.decode_documents(enc).collect()}
    assert back == {(r.doc_id, r.text or "") for r in rows}
    counts = sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd).collect()), key=key)
    assert counts == sorted(((i, len(x)) for i, x in want), key=key)
    packed = token_ids.pack_documents(odd)
    assert sorted(((r.doc_id, r.token_ids) for r in token_ids.unpack_documents(packed).collect()), key=key) == want
    for f in (lexicon.encode_documents, token_counts.count_tokens, token_ids.pack_documents):
        assert f(odd.limit(0)).count() == 0


def test_batches_are_read_in_slices():
    """Python strings are made of a few rows at a time; every row comes, in order."""
    import pyarrow as pa

    from siftwell.llm.spark_io import in_rows, release

    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64())], ["x"]) for a, b in ((0, 1201), (1201, 1201), (1201, 1300))]
    got = [*in_rows(batches)]
    assert max(b.num_rows for b in got) == 500 and [v for b in got for v in b.column(0).to_pylist()] == [*range(1300)]
    release()
