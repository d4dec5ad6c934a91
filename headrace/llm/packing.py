"""Operator 9: best-fit decreasing packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headrace.llm.common import stored
from headrace.llm.tokens import WORDS_REMEMBERED, text_ids

#: Pieces that one group packs together. Groups get a hashed, hence like, mix of lengths, so each
#: loses about one sequence in some ten thousand against packing all pieces at once.
GROUP_PIECES = 200_000


class OpenBins:
    """Open sequences by remaining capacity, in a segment tree over capacities 0..size.

    A node counts the open bins below it; the tightest bin that takes a piece is found by one walk
    up and one down the tree.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, bin) of the open bin with the least room that is at least ``length``."""
        count, i = self.count, length + self.leaves
        if not count[i]:
            while i & 1 or not count[i + 1]:
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; ``lengths`` within 1..size, ties in the given order."""
    order = np.argsort(-np.asarray(lengths), kind="stable")
    bins, offsets = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    opened, new = OpenBins(size), 0
    for i in order.tolist():
        length = int(lengths[i])
        found = opened.take(length)
        if found is None:
            found, new = (size, new), new + 1
        room, bins[i] = found
        offsets[i] = size - room
        if room > length:
            opened.put(room - length, int(bins[i]))
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = 0, remembered: int = WORDS_REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of the whole text (NULL: empty) and an end id.

    Only documents longer than ``size`` are cut: all pieces but the first have ``size`` ids.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_ids(tokenizer, remembered)
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encoder.encode(text), encoder.dtype.type(end_id)).astype("<u4")
                raw, at, n = memoryview(ids.tobytes()), 0, len(ids)
                length = n % size or size
                for k in range(-(-n // size)):
                    rows.append((i, k, at, length, zlib.crc32(raw[4 * at:4 * (at + length)])))
                    at, length = at + length, size
            table = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)),
                 *(pa.array(table[:, j]) for j in (2, 3, 4))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, size: int) -> DataFrame:
    """Add sequence_id and offset to pieces.

    Full pieces fill a sequence each. The others go to hashed groups of about ``GROUP_PIECES``; a
    group holds only lengths and ids of pieces. Repeated rows are pieces of their own.
    """
    cut = stored(cut)
    n_groups = max(1, -(-cut.filter(F.col("length") < size).count() // GROUP_PIECES))
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_groups))
    full = cut.filter(F.col("length") == size)
    alone = full.select("*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit_decreasing(group.column("length").to_numpy(), size)
        first = group.column("part")[0].as_py() << 32
        return group.drop_columns("part").append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))

    rest = cut.filter(F.col("length") < size).withColumn("part", key).groupBy("part").applyInArrow(packed, alone.schema)
    return alone.unionByName(rest)


def packed_sequences(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, remembered: int = WORDS_REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece of ``docs``.

    NULL and empty texts are one piece of the end id. No documents: no rows. Extra columns are ignored.
    ``remembered``: words whose ids a Python worker keeps; time and memory depend on it, results do not.
    """
    return pack(pieces(docs, tokenizer, size, end_id, remembered), size)
