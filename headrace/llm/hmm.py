"""Operator 1: a hidden Markov language model with exact sequence likelihoods.

A state emits a token's class, the class emits the token by its smoothed share. The most frequent
training tokens are classes of their own; all others fall into classes by the end of the word. So
the trained tables have a fixed size, while the counts of all tokens stay distributed.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headrace.llm.common import find_code, small_batches, space_words, stored

#: Size of the model: hidden states, tokens that are classes of their own, classes of all other tokens.
STATES, HEADS, TAILS = 8, 8192, 1024
#: Baum-Welch passes over all training documents.
PASSES = 3
#: Documents whose tokens give the states their first shape, and passes over them.
SEED_DOCS, SEED_PASSES = 400, 12
#: Words of documents whose vocabulary is looked up together.
CHUNK_WORDS = 2_000_000
#: Tokens of documents that run through the recursion side by side.
BATCH_TOKENS = 200_000
#: Pseudo-counts of a transition and of a class in a state.
SMOOTH = 0.5
#: How rows of whole chunks are written. A row is some MB, and both the writer and the reader hold the rows of a row group together.
ROW_BY_ROW = {"parquet.block.row.count.limit": "1"}
#: The end of a text, as a token: no word is empty.
END = b""


def held_out_rows():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


def packed(values: np.ndarray) -> bytes:
    """Bytes of an unsigned array, plane by plane and compressed: the high planes are mostly zero."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = pa.Codec("zstd").decompress(data, decompressed_size=n * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).reshape(-1)


def tail_class(word: bytes) -> int:
    return HEADS + zlib.crc32(word[-3:]) % TAILS


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        return cls((start + SMOOTH) / (start + SMOOTH).sum(), (move + SMOOTH) / (move + SMOOTH).sum(1, keepdims=True),
                   (emit + SMOOTH / STATES) / (emit + SMOOTH / STATES).sum(0))


def batches_by_length(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indexes of documents, longest first, in batches of about ``BATCH_TOKENS`` tokens."""
    order = np.argsort(-lengths, kind="stable")
    total = np.cumsum(lengths[order])
    cut = np.searchsorted(total, np.arange(BATCH_TOKENS, int(total[-1]) + BATCH_TOKENS, BATCH_TOKENS)) + 1 if len(total) else []
    first = 0
    for end in np.minimum(cut, len(order)):  # the last document may reach over a cut before the last
        if end > first:
            yield order[first:end]
            first = end


def _columns(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of documents (longest first) in step order: place of each token, and documents alive at each step."""
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    step = np.repeat(np.arange(lengths[0]), alive)
    doc = np.arange(len(step)) - np.repeat(np.cumsum(alive) - alive, alive)
    return starts[doc] + step, alive


def forward(model: Model, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keep: bool = False):
    """Scaled forward recursion over documents, longest first, all side by side.

    Returns log10 likelihoods of the class sequences; with ``keep`` also the scaled forward
    probabilities, the scales, emissions and the step layout.
    """
    place, alive = _columns(starts, lengths)
    emit = model.emit[classes[place]]
    scales = np.empty(len(place))
    kept = np.empty_like(emit) if keep else None
    at, alpha = 0, None
    for n in alive.tolist():
        part = emit[at:at + n]
        alpha = part * model.start if alpha is None else (alpha[:n] @ model.move) * part
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        scales[at:at + n] = scale
        if keep:
            kept[at:at + n] = alpha
        at += n
    doc = np.arange(len(place)) - np.repeat(np.cumsum(alive) - alive, alive)
    score = np.bincount(doc, np.log10(scales), len(lengths))
    return (score, kept, scales, emit, place, alive) if keep else score


def expected_counts(model: Model, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Baum-Welch counts (start, move, emit) of documents, longest first, and their log10 likelihood."""
    score, alpha, scales, emit, place, alive = forward(model, classes, starts, lengths, keep=True)
    gamma = np.empty_like(alpha)
    move = np.zeros_like(model.move)
    ends = np.cumsum(alive)
    beta = None
    for t in range(len(alive) - 1, -1, -1):
        n, end = int(alive[t]), int(ends[t])
        at = end - n
        if beta is None:
            beta = np.ones((n, STATES))
        elif len(beta) < n:
            beta = np.vstack([beta, np.ones((n - len(beta), STATES))])
        gamma[at:end] = alpha[at:end] * beta
        if t:
            weighted = emit[at:end] * beta / scales[at:end, None]
            before = at - int(alive[t - 1])
            move += alpha[before:before + n].T @ weighted
            beta = weighted @ model.move.T
    counts = np.stack([np.bincount(classes[place], gamma[:, s], HEADS + TAILS) for s in range(STATES)], 1)
    return gamma[:int(alive[0])].sum(0), move * model.move, counts, float(score.sum())


def first_model(classes: list[np.ndarray], weight: np.ndarray) -> Model:
    """States shaped on some documents: each draws its own perturbed unigram, then Baum-Welch refines it."""
    rng = np.random.default_rng(1)
    emit = (weight[:, None] + SMOOTH) * rng.uniform(0.5, 1.5, (len(weight), STATES))
    model = Model(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.1 / STATES) + np.eye(STATES) * 0.9, emit / emit.sum(0))
    if not classes:
        return model
    # a document each, in turn, tilts a state towards its tokens
    for i, c in enumerate(classes[:4 * STATES]):
        model.emit[:, i % STATES] += np.bincount(c, minlength=len(weight)) / len(c) / 4
    model.emit /= model.emit.sum(0)
    lengths = np.array([len(c) for c in classes])
    starts, flat = np.cumsum(lengths) - lengths, np.concatenate(classes)
    for _ in range(SEED_PASSES):
        total = [0, 0, 0]
        for batch in batches_by_length(lengths):
            total = [a + b for a, b in zip(total, expected_counts(model, flat, starts[batch], lengths[batch])[:3])]
        model = Model.from_counts(total[0], total[1], total[2] + 0.05 * weight[:, None] / max(1, weight.sum()) * total[2].sum(0))
    return model


# -- gathering: chunks of documents, and the words of each chunk

def numbering() -> dict[bytes, int]:
    """Numbers of words by first appearance, 0 for the end token. It holds no reference to itself, so it goes with its chunk."""
    numbers = defaultdict(count().__next__)
    numbers[END]
    return numbers


def chunked(docs: DataFrame) -> DataFrame:
    """Documents in chunks: one row of ids, lengths and local token numbers, and the chunk's words with their training counts.

    A row is either a chunk (tokens set) or a slice of its vocabulary (words set). Numbers run by
    first appearance; number 0 is the end token. Stored once, so chunks stay what they are.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk long, doc_ids array<{kind}>, held_out array<boolean>, lengths array<int>, tokens binary, words array<binary>, trained array<long>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, arrow = TaskContext.get().partitionId() << 32, 0, None

        def flush():
            nonlocal made
            flat = np.concatenate(tokens)
            train = np.repeat(~np.array(held), lengths)
            counts = np.bincount(flat[train], minlength=len(numbers))
            out = {"chunk": [base + made], "doc_ids": [ids], "held_out": [held], "lengths": [lengths], "tokens": [packed(flat.astype("<u4"))],
                   "words": [list(numbers)], "trained": [counts]}
            made += 1
            return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

        def fresh():
            return [], [], [], [], numbering(), 0

        ids, held, lengths, tokens, numbers, size = fresh()
        for b in batches:
            arrow = arrow or pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(b.column("doc_id").type)), ("held_out", pa.list_(pa.bool_())),
                                        ("lengths", pa.list_(pa.int32())), ("tokens", pa.binary()), ("words", pa.list_(pa.binary())),
                                        ("trained", pa.list_(pa.int64()))])
            for doc, text, out in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("held").to_pylist()):
                words = space_words(text)
                words.append(END)
                ids.append(doc)
                held.append(bool(out))
                lengths.append(len(words))
                tokens.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                size += len(words)
                if size >= CHUNK_WORDS:
                    yield flush()
                    ids, held, lengths, tokens, numbers, size = fresh()
        if ids:
            yield flush()

    asked = docs.select("doc_id", "text", F.coalesce(held_out_rows(), F.lit(False)).alias("held"))
    return stored(asked.mapInArrow(rows, schema), **ROW_BY_ROW)


def word_counts(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((chunk, number, word) of all words, (word, c) of training words).

    A word is at most one row of a chunk, so a frequent word has as many rows as chunks; counts are
    summed with map-side combine.
    """
    words = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "trained")).alias("number", "w")).select(
        "chunk", "number", F.col("w.words").alias("word"), F.col("w.trained").alias("n"))
    counts = words.filter("n > 0").groupBy("word").agg(F.sum("n").alias("c"))
    return words.select("chunk", "number", "word"), stored(counts)


@dataclass
class Gathered:
    heads: dict[bytes, int]  # class of each head token
    weight: np.ndarray  # training tokens of each class
    total: int  # N
    distinct: int  # V
    tail_total: np.ndarray
    tail_distinct: np.ndarray


def gather(counts: DataFrame) -> Gathered:
    """Totals of all training tokens, the heads, and totals of each tail class. All of fixed size.

    The least count of a head comes from a histogram of counts in sixteenths of an octave, so that at
    most ``HEADS`` words and one row per tail class reach the driver.
    """
    level = F.floor(F.log2("c") * 16).cast("int")
    histogram = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).orderBy(F.desc("level")).collect()
    total, distinct = sum(r["c"] for r in histogram), sum(r["n"] for r in histogram)
    least, seen = 0, 0
    for r in histogram:
        if seen + r["n"] > HEADS:
            break
        seen, least = seen + r["n"], r["level"]
    else:
        least = -1
    least = least if seen else 1 << 20
    names = sorted((bytes(r.word), r.c) for r in counts.filter(level >= least).collect())
    heads, weight = {w: i for i, (w, _) in enumerate(names)}, np.zeros(HEADS + TAILS)
    weight[:len(names)] = [c for _, c in names]
    tail = counts.filter(level < least).groupBy(_tail(F.col("word")).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    tail_distinct = np.zeros(TAILS)
    for r in tail:
        weight[HEADS + r["k"]], tail_distinct[r["k"]] = r["c"], r["n"]
    return Gathered(heads, weight, total, distinct, weight[HEADS:].copy(), tail_distinct)


def _tail(word):
    last = F.substring(word, F.greatest(F.octet_length(word) - 2, F.lit(1)), F.lit(3))
    return F.crc32(last) % TAILS


def classified(chunks: DataFrame, words: DataFrame, counts: DataFrame, found: Gathered) -> DataFrame:
    """One row per chunk: ids, lengths, classes of all tokens, and of each document base_score, n_known and
    the log10 share of its tokens in their classes.

    The vocabulary of a chunk comes back with counts by a join on the word; a chunk and its
    vocabulary (at most ``CHUNK_WORDS`` and one document) meet in one task.
    """
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast(found)
    heads = spark.createDataFrame(list(found.heads.items()), "word binary, k int")  # HEADS rows at most
    looked = words.join(counts, "word", "left").join(F.broadcast(heads), "word", "left").select(
        F.col("chunk").alias("of_chunk"), "number", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("k", _tail(F.col("word")) + HEADS).cast("int").alias("k"))
    kind = chunks.schema["doc_ids"].dataType
    out = f"chunk long, doc_ids {kind.simpleString()}, held_out array<boolean>, lengths array<int>, classes binary, base array<double>, known array<long>, inner array<double>"

    def rows(chunk: pa.Table, vocabulary: pa.Table) -> pa.Table:
        g = shared.value
        vocabulary = vocabulary.sort_by("number")
        c = vocabulary.column("c").to_numpy().astype(np.float64)
        classes = vocabulary.column("k").to_numpy().astype(np.int64)
        tail = np.flatnonzero(classes >= HEADS)
        inner = np.zeros(len(classes))
        k = classes[tail] - HEADS
        inner[tail] = np.log10((c[tail] + 0.5) / (g.tail_total[k] + 0.5 * (g.tail_distinct[k] + 1)))
        base = np.log10((c + 0.5) / (g.total + 0.5 * (g.distinct + 1)))
        lengths = np.array(chunk.column("lengths")[0].as_py())
        tokens = unpacked(chunk.column("tokens")[0].as_py(), int(lengths.sum()), "<u4")
        at = np.cumsum(lengths) - lengths
        per_doc = lambda values: np.add.reduceat(values[tokens], at)  # noqa: E731  no document is without tokens
        return pa.table([chunk.column("chunk"), chunk.column("doc_ids"), chunk.column("held_out"), chunk.column("lengths"),
                         pa.array([packed(classes[tokens].astype("<u2"))], pa.binary()), pa.array([per_doc(base)], pa.list_(pa.float64())),
                         pa.array([per_doc((c > 0).astype(np.int64))], pa.list_(pa.int64())), pa.array([per_doc(inner)], pa.list_(pa.float64()))],
                        names=["chunk", "doc_ids", "held_out", "lengths", "classes", "base", "known", "inner"])

    parts = chunks.select("chunk", "doc_ids", "held_out", "lengths", "tokens")
    return stored(parts.groupBy("chunk").cogroup(looked.groupBy("of_chunk")).applyInArrow(rows, out), **ROW_BY_ROW)


def _training(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, starts, lengths) of a chunk's training documents."""
    lengths = np.array(row["lengths"])
    starts = np.cumsum(lengths) - lengths
    train = ~np.array(row["held_out"])
    return unpacked(row["classes"], int(lengths.sum()), "<u2").astype(np.int64), starts[train], lengths[train]


def baum_welch(chunks: DataFrame, model: Model) -> tuple[Model, float]:
    """One pass over all training documents. A task sends one row per class it met, counts summed in the
    task; sums have a map-side combine. The driver gets one row per class and state."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    size = HEADS + TAILS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for row in b.to_pylist():
                classes, starts, lengths = _training(row)
                for batch in batches_by_length(lengths):
                    new = expected_counts(shared.value, classes, starts[batch], lengths[batch])
                    total = new if total is None else tuple(x + y for x, y in zip(total, new))
        if total:
            table = np.vstack([total[2], total[1], total[0][None], np.full((1, STATES), total[3] / STATES)])
            used = np.flatnonzero(table.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(table[used, s]) for s in range(STATES))], names=["row", *(f"s{s}" for s in range(STATES))])

    sums = chunks.select("held_out", "lengths", "classes").mapInArrow(rows, "row long, " + ", ".join(f"s{s} double" for s in range(STATES)))
    got = sums.groupBy("row").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(STATES)]).toPandas()
    table = np.zeros((size + STATES + 2, STATES))
    table[got["row"].to_numpy(np.int64)] = got[[f"s{s}" for s in range(STATES)]].to_numpy()
    return Model.from_counts(table[size + STATES], table[size:size + STATES], table[:size]), float(table[-1].sum())


def seed(chunks: DataFrame, found: Gathered) -> Model:
    """The first model, from documents of two chunks; passes over all documents follow."""
    weight = found.weight
    ids = [r.chunk for r in chunks.select("chunk").orderBy(F.xxhash64("chunk"), "chunk").limit(2).collect()]
    picked = chunks.filter(F.col("chunk").isin(ids)).select("held_out", "lengths", "classes")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        for b in batches:
            for row in b.to_pylist():
                classes, starts, lengths = _training(row)
                out += [classes[a:a + n] for a, n in zip(starts, lengths)]
        order = np.random.default_rng(2).permutation(len(out))[:SEED_DOCS]
        shaped = first_model([out[i] for i in order], weight)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in (shaped.start, shaped.move, shaped.emit)], pa.binary()), pa.array([0, 1, 2])], names=["data", "part"])

    got = {r.part: np.frombuffer(bytes(r.data)) for r in picked.coalesce(1).mapInArrow(rows, "data binary, part long").collect()}
    if not got:
        return first_model([], weight)
    return Model(got[0], got[1].reshape(STATES, STATES), got[2].reshape(-1, STATES))


def scored(chunks: DataFrame, model: Model, found: Gathered) -> DataFrame:
    """One row per document: the exact log10 likelihood by the scaled forward recursion over its whole text."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    total = found.total
    kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(b.to_pylist()):
                lengths = np.array(row["lengths"])
                classes = unpacked(row["classes"], int(lengths.sum()), "<u2").astype(np.int64)
                starts, score = np.cumsum(lengths) - lengths, np.zeros(len(lengths))
                for batch in batches_by_length(lengths):
                    score[batch] = forward(shared.value, classes, starts[batch], lengths[batch])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_ids")[i].values, pa.array(row["held_out"]), pa.array(lengths, pa.int64()), pa.array(row["known"], pa.int64()),
                     pa.array(np.full(len(lengths), total), pa.int64()), pa.array(row["base"], pa.float64()),
                     pa.array(score + np.array(row["inner"]))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return chunks.mapInArrow(rows, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def language_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    NULL and empty texts are one end token; a NULL doc_id counts as training. Without training tokens
    the base is 0 and the model uniform. Repeated rows are texts of their own. No documents: no rows.
    Extra columns are ignored.
    """
    find_code(docs.sparkSession)
    small_batches(docs.sparkSession)
    chunks = chunked(docs)
    words, counts = word_counts(chunks)
    found = gather(counts)
    ready = classified(chunks, words, counts, found)
    model = seed(ready, found)
    for _ in range(PASSES):
        model, _ = baum_welch(ready, model)
    return scored(ready, model, found)
