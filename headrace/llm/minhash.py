"""Operator 2: MinHash fingerprints of documents and near duplicates by signature bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headrace.llm.common import LOWER, find_code, partitions_for, small_batches, space_words, stored
from headrace.llm.jaccard import distinct_texts, linked_classes
from headrace.llm.shingles import WORDS, shingle_hashes, shingle_set

#: Hash permutations; a fingerprint keeps the low 8 bits of each minimum.
PERMUTATIONS = 128
#: Bands of PERMUTATIONS / BANDS minima for the candidate join.
BANDS = 32
#: Shingles hashed at a time, so that the table of hashes stays in the cache.
BLOCK = 256
_RNG = np.random.default_rng(11)
_FACTOR = (_RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """Least values of PERMUTATIONS multiply-add-shift hashes over 64-bit shingles, before the shift; all ones without shingles.

    h(x) = (a x + b mod 2^64) >> 32 on 32-bit x is a strongly universal family. The shift keeps order,
    so it is taken after the minimum.
    """
    x = shingles >> np.uint64(32)
    least = np.full(PERMUTATIONS, np.uint64(0xFFFFFFFFFFFFFFFF))
    table = np.empty((min(BLOCK, len(x)), PERMUTATIONS), np.uint64)
    for i in range(0, len(x), BLOCK):
        part = x[i:i + BLOCK, None]
        hashes = table[:len(part)]
        np.multiply(part, _FACTOR, out=hashes)
        np.add(hashes, _SHIFT, out=hashes)
        np.minimum(least, hashes.min(0), out=least)
    return least


def shifted(least: np.ndarray) -> np.ndarray:
    return (least >> np.uint64(32)).astype(np.uint32)


def signature(text: str | None) -> np.ndarray | None:
    """The ``minima`` of a text's shingles; None without words."""
    x = shingle_set(space_words(text))
    return shifted(minima(x)) if len(x) else None


def short(sig: np.ndarray | None) -> bytes:
    return b"" if sig is None else (sig & np.uint32(255)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Jaccard similarity as two fingerprints show it, 0 to 1: the share of equal bytes less the 1/256 that
    agree by chance. Two texts without words are alike, one without is unlike all others."""
    if not a or not b:
        return float(a == b)
    same = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / len(a)
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the next text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


class Signed(NamedTuple):
    """A text read once: its signature, and what the signature of its ``edited`` form takes from it."""

    text: str
    n_shingles: int
    words: list[bytes]
    sig: np.ndarray | None
    head: np.ndarray  # minima of the shingles that end before the last word of the kept three quarters
    seam: list[bytes]  # kept words that follow them
    tail: bytes  # a last kept word, which what follows may lengthen


def signed(text: str) -> Signed:
    words, kept_text = space_words(text), text[:len(text) - len(text) // 4]
    x, kept = shingle_hashes(words), space_words(kept_text)
    n, c = len(np.unique(x)), max(0, len(kept) - WORDS)
    before, after = (x[:c], x[c:]) if n == len(x) else (np.unique(x[:c]), np.unique(x[c:]))
    head = minima(before)
    tail = kept.pop() if kept and kept_text[-1] not in " \t\n\v\f\r" else b""
    return Signed(text, n, words, shifted(np.minimum(head, minima(after))) if words else None, head, kept[c:], tail)


def edited_signature(held: Signed, following: str) -> np.ndarray | None:
    """``signature`` of the edited text; only the shingles that the edit makes are hashed."""
    put = following[:len(held.text) // 4].encode("utf-8", "surrogatepass").translate(LOWER)
    words = held.seam + (held.tail + put).split()
    return shifted(np.minimum(held.head, minima(np.unique(shingle_hashes(words))))) if words else None


#: Digests are stored as bytes, half as long as their digits.
_RESULT = (("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
           ("near_edited", pa.float64()), ("near_next", pa.float64()))
_RESULT_DDL = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_SET = (("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())))
_SET_DDL = "n_shingles long, digest binary, keys array<long>"


def compared(held: Signed, following: Signed) -> tuple:
    changed, print_ = edited(held.text, following.text), short(held.sig)
    changed_print = print_ if changed == held.text else short(edited_signature(held, following.text))
    return (len(held.text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), print_, changed_print,
            likeness(print_, changed_print), likeness(print_, short(following.sig)))


def set_of(words: list[bytes], n_shingles: int, sig: np.ndarray | None) -> tuple:
    """What ``duplicate_classes`` takes of a text. Keys that meet by chance only add pairs to measure."""
    width = PERMUTATIONS // BANDS
    keys = [] if sig is None else [xxhash.xxh3_64_intdigest(sig[k * width:(k + 1) * width].tobytes(), k) - (1 << 63) for k in range(BANDS)]
    return n_shingles, hashlib.md5(b" ".join(words)).digest() if words else None, keys


def columns_of(rows: list[tuple], fields: tuple) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of ``docs``.

    NULL texts are empty. Rows are ordered by doc_id (NULL first, ties by text) in ranges; each range is
    read as a stream that holds two texts. Only the last text of a range and the first of the next
    one are joined afterwards. A single row is followed by itself. No documents: no rows.
    """
    return prints_and_sets(docs)[0]


def prints_and_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``fingerprints``, and the sets that ``duplicate_classes`` takes, by one reading of each text."""
    find_code(docs.sparkSession)
    small_batches(docs.sparkSession)
    field = docs.select("doc_id").schema["doc_id"]
    kind = field.dataType.simpleString()
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(
        partitions_for(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_id = None, None  # the row before
        for b in batches:
            rows, sets, ids, marks, texts = [], [], [], [], []
            for doc, text in zip(b.column("doc_id"), b.column("text").to_pylist()):
                now = signed(text)
                if held is None:
                    rows.append((None,) * 6)
                    sets.append((None,) * 3)
                    ids.append(None)
                    marks.append("first")
                    texts.append(text)
                else:
                    rows.append(compared(held, now))
                    sets.append(set_of(held.words, held.n_shingles, held.sig))
                    ids.append(held_id)
                    marks.append(None)
                    texts.append(None)
                held, held_id = now, doc.as_py()
            if rows:
                type_, part = b.schema.field("doc_id").type, b.column("part")[0].as_py()
                yield made(type_, ids, rows, sets, part, marks, texts)
        if held:
            yield made(type_, [held_id], [(None,) * 6], [set_of(held.words, held.n_shingles, held.sig)], part, ["last"], [held.text])

    def made(type_, ids, rows, sets, part, marks, texts) -> pa.RecordBatch:
        columns = [pa.array(ids, type_), *columns_of(rows, _RESULT), *columns_of(sets, _SET),
                   pa.array([part] * len(rows), pa.int32()), pa.array(marks, pa.string()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *(n for n, _ in _RESULT + _SET), "part", "mark", "text"])

    done = stored(ordered.mapInArrow(stream, f"doc_id {kind}, {_RESULT_DDL}, {_SET_DDL}, part int, mark string, text string"))
    inner = done.filter("mark IS NULL").select("doc_id", *(n for n, _ in _RESULT))
    sets = done.filter("mark IS NULL OR mark = 'last'").select("doc_id", *(n for n, _ in _SET))
    firsts = done.filter("mark = 'first'").select("part", F.col("text").alias("following"))
    # one row a range: the range after it, the first one after the last
    ring = Window.orderBy("part")
    parts = firsts.select("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(ring), F.first("part").over(ring)).alias("next"))
    ends = done.filter("mark = 'last'").select("doc_id", "text", "part").join(after, "part").join(
        firsts.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [compared(signed(t), signed(f)) for t, f in zip(b.column("text").to_pylist(), b.column("following").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns_of(rows, _RESULT)], names=["doc_id", *(n for n, _ in _RESULT)])

    prints = inner.unionByName(ends.mapInArrow(finish, f"doc_id {kind}, {_RESULT_DDL}"))
    digits = {n: F.lower(F.hex(n)) for n, t in _RESULT if t == pa.binary()}
    return prints.withColumns(digits), sets


def duplicate_classes(docs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(doc_id, class_id): documents joined by shared signature bands with a verified similarity of 0.8 or more.

    The documents of a band key are a cell of the Jaccard operator: a pivot stands for the others first. Those of keys
    that then hold more than one class meet again by the rarest shingles they share, where exact bounds rule pairs out, until
    all that may link are measured. Minima take full 32-bit values. A pair of similarity 0.8 shares
    a band of 4 of 128 minima with odds over 1 - 1e-7. class_id: the least doc_id linked. Texts without words
    and rows without a doc_id are classes of their own. ``sets``: from ``prints_and_sets`` of the same ``docs``, if at hand.
    """
    find_code(docs.sparkSession)
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                words = space_words(text)
                rows.append(set_of(words, len(shingle_set(words)), signature(text)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns_of(rows, _SET)], names=["doc_id", *(n for n, _ in _SET)])

    if sets is None:
        sets = stored(docs.select("doc_id", "text").mapInArrow(banded, f"doc_id {kind}, {_SET_DDL}"))
    usable, first = distinct_texts(sets)
    bands = usable.join(first.select(F.col("first").alias("doc_id"), "digest"), ["doc_id", "digest"]).select(
        F.explode("keys").alias("token"), F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"))
    shared = bands.groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("token")
    # no place or share of own tokens is known here: of the bounds, that of the sizes is left
    rows = stored(bands.join(shared, "token").select("token", "doc", "n", F.lit(0).cast("long").alias("u"), F.lit(0).alias("i")))
    return linked_classes(docs, sets, usable, first, rows, coarse=True).select("doc_id", F.col("component_id").alias("class_id"))
