"""Operator 12: how far the sources of a language are from one another in their use of frequent terms.

Counts per (lang, source, term) are summed in Spark. The kept terms are dealt to blocks; a block's
rows make a sparse matrix of groups and terms, and each group's row is multiplied out by Gustavson's
method: its terms lead through the term-major index to the peers that hold them too, and their
differences are added in a dense accumulator with a place per peer. No pair of postings is emitted.
A term that only one of two groups holds is compared with the other's zero baseline, the share of a
term without occurrences; sums over sorted shares give that for all peers at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headrace.llm.common import find_code, stored

#: Documents of its language that hold a kept term, at least.
LEAST_DOCS = 30
#: Added to each count; shares are in units of 1 / SCALE.
ADDED, SCALE = 5, 1_000_000_000
#: Ranks of the part ``term``.
TOP_TERMS = 50
#: Words that a task counts at a time, and bytes of one text that are split at a time.
TASK_WORDS, PIECE = 500_000, 4_000_000
#: (group, term) rows of a block, about.
BLOCK_ROWS = 2_000_000
#: Posting places that are gathered at a time.
GATHERED = 1_000_000
#: A-Z to a-z; ASCII bytes that are no letters become spaces.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def letter_runs(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text in lists of bounded length."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(LETTERS)
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= PIECE else raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def counted(groups: list[tuple[str, str]], owner: list[int], words: list[list[bytes]]) -> pa.RecordBatch:
    """Counts of terms and of documents per group; a row without a term for each group, so that it occurs."""
    coded = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    k = len(coded.dictionary)
    of_doc = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
    cell, n = np.unique(of_doc * k + coded.indices.to_numpy(), return_counts=True)
    doc, term = np.divmod(cell, max(k, 1))
    key, place = np.unique(np.asarray(owner, np.int64)[doc] * k + term, return_inverse=True)
    group, term = np.divmod(key, max(k, 1))
    total = np.zeros(len(key), np.int64)
    np.add.at(total, place, n)
    return rows_of(groups, group, coded.dictionary.cast(pa.string()).take(pa.array(term)), total, np.bincount(place, minlength=len(key)))


def rows_of(groups, group, terms: pa.Array, n, docs) -> pa.RecordBatch:
    every = np.arange(len(groups))
    at = pa.array(np.concatenate([group, every]).astype(np.int64))
    none = np.zeros(len(groups), np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array([g[0] for g in groups], pa.string()).take(at), pa.array([g[1] for g in groups], pa.string()).take(at),
         pa.concat_arrays([terms, pa.nulls(len(groups), pa.string())]), pa.array(np.concatenate([n, none]).astype(np.int64)),
         pa.array(np.concatenate([docs, none]).astype(np.int64))], schema=_COUNTS)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; term NULL stands for the group itself."""
    find_code(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        owner, words, size = [], [], 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text")):
                runs = letter_runs(text.as_py())
                first = next(runs, [])
                more = next(runs, None)
                if more is not None:  # a very long text is counted by itself, so that it counts once per term
                    count = Counter(first)
                    count.update(more)
                    for run in runs:
                        count.update(run)
                    held = pa.array(list(count), pa.binary()).cast(pa.string())
                    yield rows_of([(lang, source)], np.zeros(len(count), np.int64), held, np.fromiter(count.values(), np.int64, len(count)), np.ones(len(count), np.int64))
                    continue
                owner.append(groups.setdefault((lang, source), len(groups)))
                words.append(first)
                size += len(first)
                if size >= TASK_WORDS:
                    yield counted(list(groups), owner, words)
                    groups, owner, words, size = {}, [], [], 0
        if words:
            yield counted(list(groups), owner, words)

    asked = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    made = asked.mapInArrow(rows, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str):
    """1 + floor(SCALE (n + ADDED) / (total + ADDED kept)), exact beyond 64 bits; NULL if no term is kept."""
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(19, 0)) * CAST({n} + {ADDED} AS DECIMAL(19, 0))) "
                  f"DIV CAST({total} + {ADDED} * {kept} AS DECIMAL(19, 0)) END")


def one_sided(shares: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Sum of |p - z| over ``shares`` for each of ``zeros``."""
    ordered = np.sort(shares)
    below = np.concatenate([[0], np.cumsum(ordered)])
    k = np.searchsorted(ordered, zeros)
    return zeros * k - below[k] + (below[-1] - below[k]) - zeros * (len(ordered) - k)


def block_sums(group: np.ndarray, term: np.ndarray, shares: np.ndarray, zeros: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(a, sums per peer) for each group a: its own terms against each peer, less |z_a - z_b| per term of a; terms
    held by both are settled in the row of the lesser group. Row a at b plus row b at a is the sum of |p_a - p_b| - |z_a - z_b|.
    """
    order = np.lexsort((group, term))
    t_group, t_share = group[order], shares[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=int(term.max(initial=-1)) + 1))])
    by_group = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=len(zeros)))
    for a in range(len(zeros)):
        mine = by_group[ends[a - 1] if a else 0:ends[a]]
        apart = np.abs(zeros[a] - zeros)
        sums = one_sided(shares[mine], zeros) - len(mine) * apart
        lengths = starts[term[mine] + 1] - starts[term[mine]]
        reach = np.cumsum(lengths)
        at = 0
        while at < len(mine):
            end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + GATHERED, "right")))
            rows, n = mine[at:end], lengths[at:end]
            places = np.repeat(starts[term[rows]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            own = np.repeat(shares[rows], n)
            peer, theirs = t_group[places], t_share[places]
            later = peer > a
            peer, theirs, own = peer[later], theirs[later], own[later]
            np.add.at(sums, peer, np.abs(own - theirs) - np.abs(own - zeros[peer]) - np.abs(theirs - zeros[a]) + apart[peer])
            at = end
        yield a, sums


def pair_sums(index: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): sums of |p - q| over all kept terms, for each pair of sources of a language."""
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int")
    blocks = groups.groupBy("lang").agg(F.sum("held").alias("rows")).select("lang", n_blocks.alias("blocks"))
    # a group's own row in each block: its zero baseline, and the kept terms in the first block only
    own = groups.join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source",
                                             F.lit(None).cast("string").alias("term"), F.coalesce("zero", F.lit(0)).alias("p"), "kept")
    held = index.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "p", F.lit(0).cast("long").alias("kept"))

    def rows(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        head = table.filter(pc.is_null(table["term"])).sort_by("source")
        body = table.filter(pc.is_valid(table["term"]))
        sources = head["source"].combine_chunks()
        zeros, kept = head["p"].to_numpy(), head["kept"].to_numpy()
        group = pc.index_in(body["source"], value_set=sources).to_numpy().astype(np.int64)
        term = body["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        every = np.arange(len(zeros))
        for a, sums in block_sums(group, term, body["p"].to_numpy(), zeros):
            if key[1].as_py() == 0:
                sums = sums + np.where(every > a, kept * np.abs(zeros[a] - zeros), 0)
            peers = np.delete(every, a)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(key[0], len(peers)).cast(pa.string()), sources.take(pa.array(np.minimum(peers, a))), sources.take(pa.array(np.maximum(peers, a))), pa.array(sums[peers])],
                names=["lang", "lo", "hi", "value"])

    halves = held.unionByName(own).groupBy("lang", "block").applyInArrow(rows, "lang string, lo string, hi string, value long")
    whole = halves.groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("lo").alias("source"), F.col("hi").alias("item")), F.struct(F.col("hi").alias("source"), F.col("lo").alias("item"))))
    return whole.select("lang", both.alias("pair"), "value").select("lang", "pair.*", "value")


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): see the module. ``pair`` rows rank all other sources of the language,
    ``term`` rows the TOP_TERMS kept terms that the group uses more than its language.

    NULL text, lang and source are ''. Every row of ``docs`` is a document, repeated ones too; the doc_id is not read.
    A group without terms has rows of part ``pair``; a language of one source has none. No documents: no rows.
    Extra columns are ignored.
    """
    counts = stored(term_counts(docs))
    terms = counts.filter("term IS NOT NULL")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).filter(F.col("docs") >= LEAST_DOCS).select("lang", "term", "n_lang")
    used = stored(terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    of_lang = used.groupBy("lang", "term").agg(F.max("n_lang").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("all_lang"))
    of_group = used.groupBy("lang", "source").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("held"))
    zero = F.lit(0).cast("long")
    groups = counts.filter("term IS NULL").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("all", "held", "kept", "all_lang")])
    groups = stored(groups.withColumn("zero", share("0", "all", "kept")))
    index = stored(used.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share("n", "all", "kept").alias("p"), share("n_lang", "all_lang", "kept").alias("q")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = index.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    top = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP_TERMS)
    pairs = pair_sums(index, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(top)
