"""Operator 8: token ids in word-aligned Simple-8b blocks, in archive files written and read by Spark."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headrace.llm.common import partitions_for, shared_folder, stored
from headrace.llm.tokens import text_ids

#: Fixed values of the format. Selector k packs COUNTS[k] ids of WIDTHS[k] bits into the low 60 bits.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
#: Selector 15: an id over 60 bits follows whole in the next word.
ESCAPE = 15
_STEPS = np.array([*COUNTS, 1, 1])
_BITS16 = np.array([v.bit_length() for v in range(1 << 16)], np.uint8)
#: Maxima over c ids from those over a and, a places on, b ids.
_WINDOWS = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (4, 2), 7: (4, 3), 8: (4, 4), 10: (5, 5), 12: (6, 6), 15: (10, 5),
            20: (10, 10), 30: (15, 15), 60: (30, 30)}
#: Ids of a block; each block starts at a word of its own, listed in the file's block table.
BLOCK = 1 << 16
MAGIC = b"S8B1"
#: Stands for a NULL doc_id in files; such documents come first.
NO_ID = -(1 << 63)
#: Bytes of words after which a file is closed.
FILE_BYTES = 8 << 20


def pack(values: np.ndarray) -> np.ndarray:
    """Words (uint64) of one block: each word takes as many of the next ids as fit one selector.

    Maxima of bits over 1 to 60 ids show for each place at once which selectors fit there; the walk
    over the block then takes one step per word. A last word with room is filled up with zeros.
    """
    n = len(values)
    if n == 0:
        return np.empty(0, np.uint64)
    # widest[c][i]: the most bits of the c ids from i on; ids past the end have none
    widest = {1: np.concatenate([_bits(np.asarray(values)), np.zeros(max(COUNTS), np.uint8)])}
    for c, (a, b) in _WINDOWS.items():
        tail = widest[b][a:]
        widest[c] = np.maximum(widest[a][:len(tail)], tail[:len(widest[a])])
    best = np.full(n, ESCAPE, np.uint8)
    for k in range(len(WIDTHS) - 1, -1, -1):
        np.copyto(best, k, where=widest[COUNTS[k]][:n] <= WIDTHS[k])
    starts, i, ahead = [], 0, _STEPS[best].tolist()
    while i < n:
        starts.append(i)
        i += ahead[i]
    starts = np.array(starts)
    kinds = best[starts]
    size = np.where(kinds == ESCAPE, 2, 1)
    at = np.cumsum(size) - size
    words = np.zeros(int(at[-1] + size[-1]), np.uint64)
    padded = np.concatenate([np.asarray(values).astype(np.uint64), np.zeros(max(COUNTS), np.uint64)])
    for k in np.flatnonzero(np.bincount(kinds)).tolist():
        where = kinds == k
        source, target = starts[where], at[where]
        packed = np.full(len(source), np.uint64(k) << np.uint64(60))
        if k == ESCAPE:
            words[target + 1] = padded[source]
        else:
            for j in range(COUNTS[k]):
                packed |= padded[source + j] << np.uint64(j * WIDTHS[k])
        words[target] = packed
    return words


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    if values.dtype == np.uint16:
        return _BITS16[values]
    out, left = np.zeros(len(values), np.uint8), values.astype(np.uint64)
    for shift in (48, 32, 16, 0):
        part = _BITS16[((left >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)]
        np.copyto(out, part + np.uint8(shift), where=(out == 0) & (part > 0))
    return out


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of one block, selector by selector without a loop over words."""
    words = np.asarray(words, np.uint64)
    if n == 0:
        return np.empty(0, np.uint64)
    kinds = (words >> np.uint64(60)).astype(np.int64)
    if (kinds == ESCAPE).any():  # the word after an escape is data, whatever its top bits say
        follows, i, marks = [], 0, kinds.tolist()
        while i < len(marks):
            if marks[i] == ESCAPE:
                follows.append(i + 1)
                i += 1
            i += 1
        kinds[follows] = 14
    counts = np.array([*COUNTS, 1, 0])[kinds]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for k in np.unique(kinds):
        where = np.flatnonzero(kinds == k)
        if k == 14:
            out[at[where]] = words[where]
        elif k != ESCAPE:
            mask = np.uint64((1 << WIDTHS[k]) - 1)
            for j in range(COUNTS[k]):
                out[at[where] + j] = (words[where] >> np.uint64(j * WIDTHS[k])) & mask
    return out[:n]


def archive(shard: int, number: int, docs: list[tuple[int, int]], ids: np.ndarray) -> bytes:
    """One file: header, documents (id, count), words of each block, words of all blocks, line end.

    Header: magic, shard, number in the shard, documents, ids, blocks (little-endian). The block
    table makes any block readable by itself.
    """
    blocks = [pack(ids[i:i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    ends = np.cumsum([len(b) for b in blocks]).astype("<u8")
    head = struct.pack("<4sQQQQQ", MAGIC, shard, number, len(docs), len(ids), len(blocks))
    table = np.array(docs, "<i8").reshape(-1, 2)
    words = np.concatenate(blocks).astype("<u8") if blocks else np.empty(0, "<u8")
    return b"".join([head, table.tobytes(), ends.tobytes(), words.tobytes()])


def read_archive(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(shard, number, documents (id, count), ids) of a file."""
    magic, shard, number, n_docs, n_ids, n_blocks = struct.unpack_from("<4sQQQQQ", data)
    if magic != MAGIC:
        raise ValueError("not an archive of this format")
    at = struct.calcsize("<4sQQQQQ")
    docs = np.frombuffer(data, "<i8", 2 * n_docs, at).reshape(-1, 2)
    at += 16 * n_docs
    ends = np.frombuffer(data, "<u8", n_blocks, at).astype(np.int64)
    at += 8 * n_blocks
    words = np.frombuffer(data, "<u8", int(ends[-1]) if n_blocks else 0, at)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    parts = [unpack(words[a:b], min(BLOCK, n_ids - i * BLOCK)) for i, (a, b) in enumerate(zip(starts, ends))]
    return shard, number, docs, np.concatenate(parts) if parts else np.empty(0, np.uint64)


def write_archives(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2) -> None:
    """Encode every whole text (NULL: empty), an end id after each, into files at ``path``.

    Documents are dealt to shards by ranges of doc_id and sorted in each (ties by text), so shard
    and file numbers follow ascending doc_id. A file closes after ``FILE_BYTES`` of ids; one very
    long text makes one longer file. The files are written by Spark's own writer and commit
    protocol: one text row a file, whose line end closes the format.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").repartitionByRange(
        partitions_for(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    numbered = ordered.select("doc_id", "text", F.spark_partition_id().cast("long").alias("shard"))

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = text_ids(tokenizer)
        end = np.array([end_id], encoder.dtype)
        table, parts, held, number, shard = [], [], 0, 0, 0
        for batch in batches:
            for doc, text, shard in zip(batch["doc_id"], batch["text"], batch["shard"]):
                ids = encoder.encode(text)
                table.append((doc, len(ids) + 1))
                parts += [ids, end]
                held += 2 * len(ids) + 18
                if held >= FILE_BYTES:
                    yield pd.DataFrame({"data": [archive(shard, number, table, np.concatenate(parts))]})
                    table, parts, held, number = [], [], 0, number + 1
        if table:
            yield pd.DataFrame({"data": [archive(shard, number, table, np.concatenate(parts))]})

    made = numbered.mapInPandas(files, "data binary")
    made.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """One row per document of the files at ``path``: shard, number, place, doc_id, before, n_tokens, ids_crc32.

    ``before`` counts the ids of the file before the document; the ids themselves can be had by
    ``read_archive``. Each task holds one file.
    """
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                shard, number, docs, ids = read_archive(data)
                ends = np.cumsum(docs[:, 1])
                starts = ends - docs[:, 1]
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts, ends)]
                yield pd.DataFrame({"shard": shard, "number": number, "place": np.arange(len(docs)), "doc_id": docs[:, 0],
                                    "before": starts, "n_tokens": docs[:, 1], "ids_crc32": crc})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return found.mapInPandas(rows, "shard long, number long, place long, doc_id long, before long, n_tokens long, "
                                   "ids_crc32 long")


def token_archive(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per row of ``docs``, read back from the written files.

    Repeated doc_ids each keep a row. No documents: no rows. ``start`` adds the totals of earlier
    files; these totals (one row a file of some MB) are summed by shard before the running sum.
    """
    spark = docs.sparkSession
    path = shared_folder(spark)
    write_archives(docs, tokenizer, path, end_id)
    return _with_starts(stored(read_archives(spark, path)))


def _with_starts(rows: DataFrame) -> DataFrame:
    """Offsets in two steps: files within a shard, and shards (as many as partitions) among themselves."""
    files = rows.groupBy("shard", "number").agg(F.sum("n_tokens").alias("ids"))
    inside = Window.partitionBy("shard").orderBy("number")
    files = files.select("shard", "number", (F.sum("ids").over(inside) - F.col("ids")).alias("in_shard"), "ids")
    shards = files.groupBy("shard").agg(F.sum("ids").alias("ids"))
    shards = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    offsets = files.join(shards, "shard").select("shard", "number", (F.col("base") + F.col("in_shard")).alias("base"))
    return rows.join(offsets, ["shard", "number"]).select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
