"""Operators 11 and 12: byte-level BPE, divergence of sources."""

import base64
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import frames
import public_tokenizers
import pytest
import tiktoken

from headrace.llm import bpe, divergence

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash():
    keys = [str(i * i).encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert table.find(keys).tolist() == list(range(3000))  # n keys, n places
    assert set(table.find([b"", b"no", b"x" * 999]).tolist()) <= set(range(3000))
    assert bpe.PerfectHash([b"a"]).find([b"a", b"b"]).tolist() == [0, 0]


def test_ids_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 2000)
    monkeypatch.setattr(bpe, "BLOCK", 700)
    monkeypatch.setattr(bpe, "REMEMBERED", 500)
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab \n\t\xa0éü'sl19!?漢\U0001f600\x1c\x85") for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += [frames.prose(5, 900), "a" * 3000, "ab" * 3000, " " * 3000 + "x", "x" + "\n" * 3000, "<|endoftext|>", "", None, frames.LONG]
    encoder = bpe.Encoder(bpe.encoder(RANKS, public_tokenizers.PATTERN).vocabulary, public_tokenizers.PATTERN)
    assert [ids.tolist() for ids in encoder.encode(texts)] == [library.encode_ordinary(t or "") for t in texts]


def test_bpe_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "ROW_IDS", 300)
    df = frames.awkward(spark)
    want = sorted((str(i), len(ids := library.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for i, t in df.select("doc_id", "text").collect())
    assert sorted((str(r[0]), *r[1:]) for r in bpe.round_trip(df, RANKS).collect()) == want
    assert bpe.round_trip(df.filter("false"), RANKS).count() == 0


def test_decode_any_ids(spark):
    rows = [(1, [50255, 0, 200], "x"), (2, [], "y"), (3, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, bytes string")
    tokens = bpe.read_ranks(RANKS)
    got = {r.doc_id: bytes(r.bytes) for r in bpe.decoded(df, RANKS).collect()}
    assert got == {1: b"".join(tokens[i] for i in rows[0][1]), 2: b"", 3: b""}


def test_ranks_must_be_whole(tmp_path):
    broken = tmp_path / "ranks"
    broken.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(255)))
    with pytest.raises(ValueError):
        bpe.read_ranks(str(broken))


def brute_divergence(rows, least, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    count, found, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        count[lang, source].update(terms)
        found[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in found[lang].items() if n >= least]
        whole = sum((count[lang, s] for g, s in groups if g == lang), Counter())

        def share(c):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}

        own, of_lang = share(count[lang, source]), share(whole)
        pairs = []
        for g, other in groups:
            if g == lang and other != source:
                theirs = share(count[g, other])
                pairs.append((other, sum(abs(own[t] - theirs[t]) for t in kept)))
        terms = [(t, own[t] - of_lang[t]) for t in kept if count[lang, source][t] and own[t] > of_lang[t]]
        for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, small):
    monkeypatch.setattr(divergence, "LEAST_DOCS", 3)
    monkeypatch.setattr(divergence, "TOP_TERMS", 4)
    if small:  # many blocks, pieces and flushes
        for name, size in (("BLOCK_ROWS", 20), ("GATHERED", 5), ("TASK_WORDS", 50), ("PIECE", 100)):
            monkeypatch.setattr(divergence, name, size)
    rng = random.Random(7)
    words = ["Dam", "été", "flow", "x1y", "tie", "Tie-b", "ÉTÉ", "\x00q", "zz", "漢字"]
    rows = [(rng.choice(["en", "de"]), rng.choice("abcde") * rng.randrange(1, 3), " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for _ in range(90)]
    rows += [("en", "hot", "flow flow tie")] * 40 + [(None, "a", "flow"), (None, None, None), ("xx", "only", "one two"), ("en", "none", "12 !?"), ("en", None, ""), ("de", "long", "Dam été " * 2000)]
    df = spark.createDataFrame([(i, *r, "t", 1) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int")
    got = [tuple(r) for r in divergence.divergence(df).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, 3, 4)
    assert divergence.divergence(df.filter("false")).count() == 0


def test_shares_beyond_64_bits(spark):
    big = spark.createDataFrame([(9_000_000_000_000, 10_000_000_000_000, 3), (0, 0, 0)], "n long, t long, k long")
    got = [r[0] for r in big.select(divergence.share("n", "t", "k")).collect()]
    assert got == [1 + 10**9 * (9_000_000_000_000 + 5) // (10_000_000_000_000 + 15), None]


def test_block_sums_are_symmetric_parts():
    rng = random.Random(1)
    import numpy as np
    dense = np.array([[rng.choice([0, rng.randrange(5, 90)]) for _ in range(12)] for _ in range(5)])
    zeros = np.array([rng.randrange(1, 9) for _ in range(5)])
    group, term = np.nonzero(dense)
    sums = np.array([s for _, s in divergence.block_sums(group, term, dense[group, term], zeros)])
    full = np.where(dense > 0, dense, zeros[:, None])
    for a, b in itertools.combinations(range(5), 2):
        assert sums[a, b] + sums[b, a] + 12 * abs(zeros[a] - zeros[b]) == np.abs(full[a] - full[b]).sum()
