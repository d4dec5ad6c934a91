"""Operator 11: byte-level BPE encoding and decoding by a table of ranks.

A text is split by a pattern into pre-tokens. All different pre-tokens of a block are looked up at once
in a minimal perfect hash of the vocabulary; those that it does not hold are merged from their bytes
with a heap over a linked list.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice, product

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from headrace.llm.common import find_code
from headrace.llm.shingles import mixed
from headrace.llm.tokens import REMEMBERED

#: Pre-tokens that are encoded at a time.
BLOCK = 200_000
#: Texts longer than this many characters are split piecewise.
LONG = 1_000_000
#: Ids of the rows that leave a task together.
ROW_IDS = 4_000_000
#: Keys per bucket of the perfect hash, on average.
LOAD = 4
#: Displacements tried at a time, and per bucket before the hash takes another seed.
TRIES, MOST_TRIES = 256, 1 << 22
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id. Ids are ranks and have no gaps; all 256 bytes are among the tokens."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    tokens = [ranks[i] for i in range(len(ranks))]
    if len(set(tokens)) != len(tokens) or not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError("ranks must number distinct tokens from 0 and hold every byte")
    return tokens


def hashed(keys: list[bytes], seed: int) -> np.ndarray:
    """Two 64-bit words per key."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k, seed) for k in keys), ">u8").reshape(-1, 2).astype(np.uint64)


class PerfectHash:
    """Minimal perfect hash by displacement: n keys fill n places.

    A key's first word names its bucket; the second one, mixed with the bucket's displacement, gives
    the place. Buckets are placed from the largest down; those of one key take the places that are
    left, and their displacement is that place, negated.
    """

    def __init__(self, keys: list[bytes], seed: int = 0):
        self.size, self.seed = len(keys), seed
        while not self._placed(hashed(keys, self.seed)):
            self.seed += 1

    def _bucket(self, words: np.ndarray) -> np.ndarray:
        return (words[:, 0] % np.uint64(len(self.moves))).astype(np.int64)

    def _place(self, words: np.ndarray, move: np.ndarray) -> np.ndarray:
        return (mixed(words[:, 1] + move.astype(np.uint64) * GOLDEN) % np.uint64(self.size)).astype(np.int64)

    def _placed(self, words: np.ndarray) -> bool:
        self.moves = np.zeros(max(1, self.size // LOAD), np.int64)
        self.keys = np.full(self.size, -1, np.int64)
        bucket = self._bucket(words)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=len(self.moves))
        ends = np.cumsum(sizes)
        for b in np.argsort(-sizes, kind="stable").tolist():
            if sizes[b] < 2:
                break
            members = order[ends[b] - sizes[b]:ends[b]]
            for first in range(0, MOST_TRIES, TRIES):
                tries = np.arange(first, first + TRIES)
                places = self._place(np.tile(words[members], (TRIES, 1)), np.repeat(tries, len(members))).reshape(TRIES, -1)
                good = (self.keys[places] < 0).all(1)
                for k in np.flatnonzero(good).tolist():
                    if len(set(places[k].tolist())) == len(members):
                        break
                else:
                    continue
                self.moves[b] = first + k
                self.keys[places[k]] = members
                break
            else:
                return False  # as good as never; another seed will do
        single = np.flatnonzero(sizes == 1)
        left = np.flatnonzero(self.keys < 0)
        self.keys[left] = order[ends[single] - 1]
        self.moves[single] = -left - 1
        return True

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The only index whose key can equal each of ``keys``. The caller compares the keys themselves."""
        words = hashed(keys, self.seed)
        move = self.moves[self._bucket(words)]
        return self.keys[np.where(move < 0, -move - 1, self._place(words, np.maximum(move, 0)))]


class Vocabulary:
    """Tokens by id, their perfect hash, and the merges of two ids into a third."""

    def __init__(self, path: str):
        self.tokens = read_ranks(path)
        self.hash = PerfectHash(self.tokens)
        ids = {t: i for i, t in enumerate(self.tokens)}
        self.of_byte = [ids[bytes([b])] for b in range(256)]
        self.merges = {(ids[t[:k]], ids[t[k:]]): i for i, t in enumerate(self.tokens) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
        self.byte_pairs = [ids.get(bytes(pair), -1) for pair in product(range(256), repeat=2)]


def merged(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of a pre-token: of all neighbours that make a token, those of the least rank join first, the leftmost on ties.

    A heap entry is rank and place in one integer. Its pair may be gone by then; ``at`` holds the rank of the pair
    that begins at each place now, -1 for none.
    """
    two, get = vocabulary.byte_pairs, vocabulary.merges.get
    at = [two[a << 8 | b] for a, b in zip(piece, piece[1:])]
    at.append(-1)
    ids = [vocabulary.of_byte[b] for b in piece]
    heap = [rank << 32 | i for i, rank in enumerate(at) if rank >= 0]
    heapq.heapify(heap)
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        entry = heapq.heappop(heap)
        i = entry & 0xFFFFFFFF
        rank = entry >> 32
        if at[i] != rank:
            continue
        j = after[i]
        ids[i] = rank
        ids[j] = at[j] = -1
        after[i] = j = after[j]
        if j < n:
            before[j] = i
            at[i] = up = get((rank, ids[j]), -1)
            if up >= 0:
                heapq.heappush(heap, up << 32 | i)
        else:
            at[i] = -1
        j = before[i]
        if j >= 0:
            at[j] = up = get((ids[j], rank), -1)
            if up >= 0:
                heapq.heappush(heap, up << 32 | j)
    return [i for i in ids if i >= 0]


class Encoder:
    """Ids of texts, block by block."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        #: Ids of pre-tokens met lately: the recent generation and the one before; bounded, and a matter of time only.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while block := list(islice(found, BLOCK)):
            yield block

    def resolve(self, pieces: set[str]) -> None:
        """Put the ids of all ``pieces`` into ``known``, as 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        for piece in pieces & self.older.keys():
            self.known[piece] = self.older[piece]
        new = list(pieces - self.known.keys())
        spelled = list(map(str.encode, new))
        tokens = self.vocabulary.tokens
        for i, piece, raw in zip(self.vocabulary.hash.find(spelled).tolist(), new, spelled):
            ids = [i] if tokens[i] == raw else merged(raw, self.vocabulary)
            self.known[piece] = array("i", ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush():
            self.resolve(set().union(*(block for _, block in held)))
            for row, block in held:
                out[row].append(b"".join(map(self.known.__getitem__, block)))
            held.clear()

        for row, text in enumerate(texts):
            for block in self.pieces(text or ""):
                held.append((row, block))
                size += len(block)
                if size >= BLOCK:
                    flush()
                    size = 0
        flush()
        return [np.frombuffer(b"".join(parts), "<i4") for parts in out]


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker. The vocabulary is a file that every executor has; its hash is built in a second."""
    return Encoder(Vocabulary(path), pattern)


def encoded(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) per row of ``docs``: the ids of the whole text by the tiktoken file ``ranks``.

    NULL and empty texts have no ids. A NULL doc_id and repeated rows stay. Each match of ``pattern`` is encoded
    by itself; special tokens are ordinary text. No documents: no rows. Extra columns are ignored.
    """
    find_code(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(ranks, pattern)
        for b in batches:
            # characters are an upper bound of pre-tokens, so slices of the batch bound the ids in memory
            texts, at, size = b.column("text").to_pylist(), 0, 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1] or "")
                if size >= ROW_IDS or end == len(texts):
                    ids = made.encode(texts[at:end])
                    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, end - at), lists], names=["doc_id", "ids"])
                    at, size = end, 0

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, ids array<int>")


def decoded(tokens: DataFrame, ranks: str) -> DataFrame:
    """``tokens`` (any columns, ids array<int>) with ``bytes``: the tokens of the ids one after another.

    NULL and empty lists decode to no bytes. Bytes need not be UTF-8, since ids may be any list. A column that
    is named ``bytes`` already is replaced.
    """
    find_code(tokens.sparkSession)
    given = tokens.drop("bytes")
    names = given.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(read_ranks(ranks), pa.large_binary())
        for b in batches:
            lists = b.column("ids").fill_null([])
            text = known.take(lists.flatten())
            _, offsets, data = text.buffers()
            bounds = np.frombuffer(offsets, np.int64) if offsets else np.zeros(1, np.int64)
            bounds = bounds[text.offset:] if len(text) else np.zeros(1, np.int64)
            places = lists.offsets.to_numpy()
            ends = bounds[places - places[0]]
            whole = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.tobytes()), data])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), whole.cast(pa.binary())], names=[*names, "bytes"])

    return given.mapInArrow(rows, StructType([*given.schema.fields, StructField("bytes", BinaryType())]))


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of ``encoded`` and of what its ids decode to."""
    both = decoded(encoded(docs, ranks), ranks)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("bytes", 256).alias("decoded_sha256"))
