"""Operator 4: benchmark passages in documents by a prefix-filtered containment join."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headrace.llm.common import find_code, plain_words, stored, with_results

#: Consecutive words of an item that make a window; an item with fewer words is one window.
WINDOW = 13
#: A document is contaminated if at least one word in this many is hit.
SHARE = 20
#: Benchmark words that one pass over the documents carries; more items make more passes.
BLOCK_WORDS = 500_000


def item_windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


class Index:
    """Windows of a block of items by their rarest word (ties: the least word).

    A document that contains a window contains all its words, so of the words in order of rarity
    the first alone is a necessary prefix. Each entry keeps the word's place in the window: it fixes
    where the window would start, which bounds its length and position in the document.
    """

    def __init__(self, items: list[tuple[str, str]], counts: dict[bytes, int], size: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for window in item_windows(plain_words(text), size):
                owners.setdefault(window, set()).add(item)
        self.by_word: dict[bytes, list[tuple[int, tuple[bytes, ...], frozenset[str]]]] = {}
        for window, names in owners.items():
            place, word = min(enumerate(window), key=lambda x: (counts.get(x[1], 0), x[1], x[0]))
            self.by_word.setdefault(word, []).append((place, window, frozenset(names)))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(spans of words, items) of all windows in a document, each verified word by word."""
        spans, items, n = [], set(), len(words)
        prefix = self.by_word.keys() & set(words)
        if prefix:
            for at, word in enumerate(words):
                if word in prefix:
                    for place, window, names in self.by_word[word]:
                        start = at - place
                        if start >= 0 and start + len(window) <= n and tuple(words[start:start + len(window)]) == window:
                            spans.append((start, start + len(window)))
                            items |= names
        return spans, items


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Items (item_id as string, text) in blocks of about ``BLOCK_WORDS`` words, one at a time; at least one block."""
    rows = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string"), "text")
    block, words, any_block = [], 0, False
    for item, text in rows.toLocalIterator():
        block.append((item, text))
        words += len(plain_words(text))
        if words >= BLOCK_WORDS:
            yield block
            block, words, any_block = [], 0, True
    if block or not any_block:
        yield block


def word_counts(docs: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each wanted word: at most one row per word and batch leaves a task."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = dict.fromkeys(wanted, 0)
        for b in batches:
            for text in b["text"]:
                for word in wanted & set(plain_words(text)):
                    seen[word] += 1
        yield pd.DataFrame([(w, n) for w, n in seen.items() if n], columns=["word", "n"])

    rows = docs.select("text").mapInPandas(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.collect()}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "__n_words long, __spans array<struct<first: long, end: long>>, __items array<string>"


def with_hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], size: int = WINDOW) -> DataFrame:
    """The columns ``keep``, __n_words, __spans (merged) and __items (sorted) of every row.

    The benchmark comes in blocks. Each has its rarity counted over all documents and is one pass
    that adds to what earlier passes found, stored in between: a task holds one block's index.
    """
    carried = list(dict.fromkeys([*keep, "text"]))
    found, spark = None, docs.sparkSession
    for block in benchmark_blocks(benchmark):
        wanted = {w for _, text in block for w in plain_words(text)}
        index = spark.sparkContext.broadcast(Index(block, word_counts(docs, wanted) if wanted else {}, size))

        def compute(texts: list, spans: list, items: list, index=index) -> list[dict]:
            out = []
            for text, old, names in zip(texts, spans, items):
                words = plain_words(text)
                new, more = index.value.hits(words)
                both = merged([*((s["first"], s["end"]) for s in old), *new])
                out.append({"__n_words": len(words), "__spans": [{"first": a, "end": b} for a, b in both], "__items": sorted({*names, *more})})
            return out

        none = docs.select(*carried, F.expr("CAST(array() AS array<struct<first: long, end: long>>)").alias("__spans"),
                           F.expr("CAST(array() AS array<string>)").alias("__items")) if found is None else stored(found)
        found = with_results(none, carried, compute, FOUND, "text", "__spans", "__items")
    return found.select(*keep, "__n_words", "__spans", "__items", F.expr("aggregate(__spans, 0L, (n, s) -> n + s.end - s.first)").alias("__n_hit"))


#: SQL of the contract's rule on a row of ``with_hits``.
CONTAMINATED = f"__n_hit > 0 AND {SHARE} * __n_hit >= __n_words"


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans) per row of ``docs``.

    NULL and empty texts and items have no words; an empty benchmark hits nothing. Items of one id
    are one item. Repeated rows keep a row each; extra columns are ignored.
    """
    find_code(docs.sparkSession)
    return with_hits(docs, benchmark, ["doc_id"]).select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"),
        F.col("__items").alias("items"), F.col("__spans").alias("spans"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    find_code(docs.sparkSession)
    return with_hits(docs, benchmark, docs.columns).filter(f"NOT ({CONTAMINATED})").select(*docs.columns)
