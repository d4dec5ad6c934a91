"""Operators 8 and 9: exact round trips, offsets and packing against brute force."""

import zlib

import frames
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from headrace.llm import packing, simple8b
from headrace.llm.tokens import Memory, TextIds

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["a  b", "a   b \n c", " x", "x ", "a\n\nb", "", "\n", "a\tb", "a b\x1cc", "it's 'll we've", "<|endoftext|> a", "é É",
       "a\xa0b", "a　 b", "Σας ΣΑΣ İ", "a\x00 b\x00c 12 34", "x" * 300, "12345 ... !!! a,b;c", "́ a"]


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_tokenizer(name):
    mine, theirs = TextIds(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for text in [*ODD, frames.prose(3, 400), frames.prose(4, 50).replace(" ", "\n")]:
        assert mine.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids, text[:40]


@pytest.mark.parametrize("name", FILES)
def test_ids_of_white_space_runs_beside_other_white_space(name):
    """As many words as spaces and line ends and one, though not each space stands alone."""
    mine, theirs = TextIds(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for text in ("a b\tc\td\n\n", "one\xa0two three\xa0four\n\n", "a\n\n\nb\tc\td", "a\u3000b  c", " a\x85b"):
        assert mine.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é'\n\t s9.,́\xa0", max_size=40))
def test_ids_equal_the_tokenizer_on_any_text(text):
    for name in FILES:
        mine = TextIds(public_tokenizers.path(name))
        assert mine.encode(text).tolist() == mine.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_words_round_trip(values):
    v = np.array(values, np.uint64)
    assert simple8b.unpack(simple8b.pack(v), len(v)).tolist() == values


def test_words_take_as_many_ids_as_fit():
    assert len(simple8b.pack(np.ones(120, np.uint64))) == 2
    assert len(simple8b.pack(np.full(8, 40_000, np.uint16))) == 3  # 20 bits each
    assert len(simple8b.pack(np.full(8, 30_000, np.uint16))) == 2  # 15 bits each


def ids_by_hand(name, text, end):
    return [*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_archive(spark, monkeypatch):
    monkeypatch.setattr(simple8b, "FILE_BYTES", 400)
    df = frames.awkward(spark)
    got = sorted(tuple(r) for r in simple8b.token_archive(df, public_tokenizers.path(FILES[0])).collect() if r.doc_id is not None)
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "", r.text) for r in df.collect())
    want, start = [], 0
    for known, doc, _, text in rows:
        ids = ids_by_hand(FILES[0], text, 2)
        if known:
            want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == sorted(want)
    assert simple8b.token_archive(df.filter("false"), public_tokenizers.path(FILES[0])).count() == 0


def test_best_fit_against_a_list_of_bins():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 65, 400)
    bins, offsets = packing.best_fit_decreasing(lengths, 64)
    rooms, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - lengths[i])
        else:
            rooms.append(64 - lengths[i])
        want[i] = min(fits, default=64)
    assert len(rooms) == bins.max() + 1
    assert [64 - o for o in offsets] == [want[i] for i in range(len(lengths))]


@pytest.mark.parametrize("size", [2048, 16])
def test_packing(spark, monkeypatch, size):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    df = frames.awkward(spark)
    rows = packing.packed_sequences(df, public_tokenizers.path(FILES[1]), size).collect()
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= size
    for text, doc in [(r.text, r.doc_id) for r in df.distinct().collect()]:
        ids = ids_by_hand(FILES[1], text, 0)
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)]
        want = [(k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        mine = {(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc}
        assert set(want) <= mine
    total = sum(r.length for r in rows)
    assert len(filled) <= -(-total // size) + 1 + len(rows) // 20
    assert packing.packed_sequences(df.filter("false"), public_tokenizers.path(FILES[1]), size).count() == 0


def test_words_are_remembered_once():
    """A word that is one piece takes one place of the memories; a memory keeps to its own size, and ids stay the same."""
    own = TextIds(public_tokenizers.path("word_bpe_49k.json"))
    text = "River dams, river flows 2020"
    want = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert own.encode(text).tolist() == want and own.encode(text).tolist() == want
    assert set(own.words) == {"River", "dams,", "river", "flows", "2020"} and not {"river", "flows"} & set(own.pieces)
    small = Memory(lambda key: key, 3)
    assert [small[i] for i in range(10)] == [*range(10)] and len(small) <= 3 and len(small.old) <= 3


def test_the_pipeline_remembers_few_words(spark, monkeypatch):
    """The bound reaches the workers' memory, and ids do not depend on it."""
    path = public_tokenizers.path(FILES[1])
    few, many = TextIds(path, 10), TextIds(path)
    texts = [frames.prose(i, 40) for i in range(20)]
    assert all((few.encode(t) == many.encode(t)).all() for t in texts)
    assert max(len(m) for m in (few.words, few.led, few.pieces)) <= 10 < max(len(m) for m in (many.words, many.led, many.pieces))
    asked = []
    monkeypatch.setattr(packing, "pieces", lambda *a, f=packing.pieces, **k: asked.append((*a, *k.values())[-1]) or f(*a, **k))
    corpus_pipeline.best_fit_packing(spark, frames.docs(spark, list(enumerate(texts))), "").count()
    assert asked == [corpus_pipeline.REMEMBERED] and asked[0] <= 100_000
