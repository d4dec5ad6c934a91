"""Operator 3: exact Jaccard self-join of documents in pivot regions.

Distance is 1 - Jaccard similarity of shingle sets; two documents link at distance 0.2 or less.
Unrelated texts are all at distance 1, so no set of global pivots tells them apart. Regions are
therefore opened only where distances below 1 are possible: a *cell* is all documents that hold a
token of the necessary prefix (a linked pair shares one of the rarest fifth of either's shingles).
In each open cell a pivot is drawn and the others' distances to it are measured exactly. What lies
within 0.2 of the pivot is one component (the inner region); by the triangle inequality the rest
can only link inside windows of 0.2 around its own distance, which replicates the boundary. Cells
whose documents are of one component are closed, others are split by new pivots, and at last all
pairs of different components that are left in a cell are joined exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headrace.llm.common import find_code, passing, small_batches, space_words, stored
from headrace.llm.shingles import shingle_set
from headrace.operators.graph import connected_components

#: Documents that share a shingle within one task before the shingle counts as frequent there.
FREQUENT_IN_TASK = 4
#: Frequent shingles that go last in the order of rarity, at most. Any order gives the same links.
FREQUENT_KEPT = 250_000
#: Shingles that a task looks over at a time.
TASK_SHINGLES = 1_000_000
#: Rounds of pivots before what is left is joined.
ROUNDS = 2
#: Tokens before a place that a row carries, to tell whether a pair has met already.
LOOK_BACK = 4
#: Pairs of one pivot that a task takes; more are spread by the other document.
PAIRS_OF_PIVOT = 256
#: Ids up to this count are broadcast to pick texts (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def most_rest(n: str) -> str:
    """SQL of ceil(0.8 n): the elements beyond the prefix and one."""
    return f"CAST((4 * {n} + 4) DIV 5 AS BIGINT)"


def linked(common: int, a: int, b: int) -> bool:
    """Similarity of 0.8 or more."""
    return 100 * common >= 80 * (a + b - common)


def prefix_length(n: np.ndarray | int):
    """A linked set shares at least ceil(0.8 n) elements, so one of any n - ceil(0.8 n) + 1."""
    return n - (4 * n + 4) // 5 + 1


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the most frequent shingles; counts from all documents, task by task.

    A task drops what it met fewer than ``FREQUENT_IN_TASK`` times, so counts are lower bounds. They
    only order shingles by rarity.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= FREQUENT_IN_TASK
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], names=["token", "n"])
        for b in batches:
            for text in b.column("text"):
                held.append(shingle_set(space_words(text.as_py())))
                size += len(held[-1])
                if size >= TASK_SHINGLES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    with passing(docs.sparkSession) as put:
        rows = put(docs.select("text").mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
        level = F.floor(F.log2("n")).cast("int")
        least, held = 64, 0
        for level_, count in sorted(map(tuple, rows.groupBy(level.alias("level")).count().collect()), reverse=True):  # 64 levels at most
            held += count
            if held > FREQUENT_KEPT:
                break
            least = level_
        top = rows.filter(level >= least).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top["n"].to_numpy(np.int64)[order]


def rarest(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The necessary prefix of a sorted set: its rarest tokens by (count, hash)."""
    known, counts = frequent
    p = prefix_length(len(tokens))
    if not len(known):
        return tokens[:p]
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    count = np.where(known[at] == tokens, counts[at], 0)
    if not count.any():
        return tokens[:p]
    return tokens[np.lexsort((tokens, count))[:p]]


def described(docs: DataFrame, frequent) -> DataFrame:
    """(doc_id, n_shingles, digest of the words, prefix) per row with a doc_id. To be stored once, read often."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, prefixes = [], [], []
            for text in b.column("text"):
                words = space_words(text.as_py())
                tokens = shingle_set(words)
                n.append(len(tokens))
                digests.append(hashlib.md5(b" ".join(words)).digest() if words else None)
                prefixes.append(rarest(tokens, shared.value).view(np.int64) if words else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "n_shingles", "digest", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n_shingles long, digest binary, prefix array<long>")


def cells(sets: DataFrame, first: DataFrame) -> DataFrame:
    """(token, doc, n, u, i): prefix tokens that at least two distinct texts share, with their place ``i`` in the
    order of rarity; ``u``: prefix tokens of the document that no other holds in its prefix.

    Only the first document of each exact text takes part. Counting has a map-side combine, and the
    join back is on a unique key, so a token of very many documents is never gathered.
    """
    rows = sets.join(first.select(F.col("first").alias("doc_id"), "digest"), ["doc_id", "digest"]).select(
        F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("i", "token"))
    with passing(sets.sparkSession) as put:
        rows = put(rows)
        shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("token")
        kept = put(rows.join(shared, "token").select("token", "doc", "n", "i"))
        held = kept.groupBy("doc", "n").agg(F.count(F.lit(1)).alias("held"))
        alone = held.select("doc", "n", (F.expr(f"n - {most_rest('n')} + 1") - F.col("held")).alias("u"))
        return stored(kept.join(alone, ["doc", "n"]).select("token", "doc", "n", "u", "i"))


def compatible(na: str, nb: str, ua: str, ub: str, ia: str, ib: str):
    """Bounds that a linked pair meets at one of its shared tokens at least.

    A link needs an overlap of m = ceil(4/9 (na + nb)). Of two prefixes, that which ends earlier in the order
    of rarity holds no common token that the other prefix lacks, so its u are not in the overlap: n - u >= m.
    The other's u may count common tokens beyond the first prefix. At most n - overlap of the first prefix
    are not common, so the other's n - u is short of m by no more than its ceil(0.8 n) is short of the first's.
    Of the first n - m + 1 tokens of either set, the pair shares one; at that token (places ia and
    ib) the overlap is at most what lies before the first and behind the second. Texts that share a
    common passage only, and copies too far apart, fail here.
    """
    m = f"((4 * ({na} + {nb}) + 8) DIV 9)"
    longer = f"greatest({most_rest(na)}, {most_rest(nb)})"
    return F.expr(f"5 * least({na}, {nb}) >= 4 * greatest({na}, {nb}) "
                  f"AND least({na} - {ua} - {most_rest(na)}, {nb} - {ub} - {most_rest(nb)}) + {longer} >= {m} "
                  f"AND {ia} <= {na} - {m} AND {ib} <= {nb} - {m} AND least({ia}, {ib}) + 1 + least({na} - {ia} - 1, {nb} - {ib} - 1) >= {m}")


def measured(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, distance, link) of pairs, from whole texts. Moves the texts of these documents only.

    A document ``a`` of very many pairs is copied to several salts, over which its pairs are spread by ``b``.
    """
    with passing(docs.sparkSession) as put:
        return _measured(pairs, docs, put)


def _measured(pairs: DataFrame, docs: DataFrame, put) -> DataFrame:
    pairs = put(pairs.select("a", "b").distinct())
    n_pairs = pairs.count()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # counts of the pairs bound the others, which are counted only where that bound is too large
    ids = F.broadcast(ids) if 2 * n_pairs <= BROADCAST_IDS or ids.count() <= BROADCAST_IDS else ids
    texts = put(docs.select("doc_id", "text").join(ids, "doc_id"))
    parts = F.ceil(F.col("held") / PAIRS_OF_PIVOT)
    hot = put(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > PAIRS_OF_PIVOT).select("a", parts.alias("parts")))
    hot = F.broadcast(hot) if n_pairs <= PAIRS_OF_PIVOT * BROADCAST_IDS or hot.count() <= BROADCAST_IDS else hot
    spread = F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0).cast("long"))
    salted = pairs.join(hot, "a", "left").select("a", "b", spread.alias("salt"))
    copies = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).join(hot, "a", "left").select(
        "a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0)).cast("long"))).alias("salt"))
    both = salted.join(copies, ["a", "salt"]).join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            distance, last, set_a = [], None, None
            for x, y in zip(b.column("text_a"), b.column("text_b")):
                x, y = x.as_py(), y.as_py()
                if x != last:
                    set_a, last = shingle_set(space_words(x)), x
                set_b = shingle_set(space_words(y))
                common = len(np.intersect1d(set_a, set_b, assume_unique=True))
                union = len(set_a) + len(set_b) - common
                distance.append((1 - common / union if union else 1.0, linked(common, len(set_a), len(set_b))))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array([d[0] for d in distance], pa.float64()),
                                              pa.array([d[1] for d in distance], pa.bool_())], names=["a", "b", "distance", "link"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(rows, f"a {kind}, b {kind}, distance double, link boolean"))


def regions(links: DataFrame) -> DataFrame:
    """(doc, comp): the pivot with the largest inner region that holds the document, followed once more from that pivot.

    ``links``: (a, b) with a the pivot, each pair once. Documents with the same ``comp`` are connected; the reverse is left to the last join.
    """
    inner = links.select("a", "b")
    size = inner.groupBy("a").agg(F.count(F.lit(1)).alias("held"))
    among = inner.join(size, "a").unionByName(size.withColumn("b", F.col("a")))
    with passing(links.sparkSession) as put:
        best = put(among.groupBy(F.col("b").alias("doc")).agg(F.max(F.struct("held", "a")).alias("m")).select("doc", F.col("m.a").alias("comp")))
        onward = best.select(F.col("doc").alias("comp"), F.col("comp").alias("next"))
        return stored(best.join(onward, "comp").select("doc", F.col("next").alias("comp")))


def with_components(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Add ``comp`` of ``doc``: its region so far, itself if in none."""
    if labels is None:
        return rows.withColumn("comp", F.col("doc"))
    return rows.join(labels, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))


def open_cells(rows: DataFrame) -> DataFrame:
    """Rows of the cells that hold more than one component."""
    mixed = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    return rows.join(mixed, "token")


def region_round(rows: DataFrame, docs: DataFrame, before: DataFrame | None) -> DataFrame:
    """Draw a pivot for each open cell and measure the distances to it that may be within reach.

    The pivot is a document in no region yet, the one with the least share of tokens of its own: the
    text that the others of a family were made from has none, and most of them lie within 0.2 of it.
    ``before``: distances of earlier rounds; their pivots come last.
    """
    if before is None:
        rows = rows.withColumn("free", F.lit(0))
    else:
        used = before.select(F.col("a").alias("doc"), F.lit(2).alias("used")).distinct()
        rows = rows.join(used, "doc", "left").withColumn("free", F.coalesce("used", F.when(F.col("comp") != F.col("doc"), 1).otherwise(0)))
    draw = F.struct("free", (F.col("u") / F.col("n")).alias("own"), "doc", "n", "u", "i", "comp")
    pivots = rows.groupBy("token").agg(F.min(draw).alias("p")).select(
        "token", F.col("p.doc").alias("a"), F.col("p.n").alias("na"), F.col("p.u").alias("ua"), F.col("p.i").alias("ia"), F.col("p.comp").alias("pc"))
    pairs = rows.join(pivots, "token").filter("doc <> a and comp <> pc").filter(compatible("na", "n", "ua", "u", "ia", "i")).select(
        "a", F.col("doc").alias("b")).distinct()
    return measured(pairs if before is None else pairs.join(before.select("a", "b"), ["a", "b"], "left_anti"), docs)


def last_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of different components that share a cell and may link.

    In each cell the most frequent component meets only the others: pairs are (others x all), so a
    cell of one large component and few others stays linear. A pair arises at the first token it shares, where
    ``compatible`` holds: a later one is left out if one of the ``LOOK_BACK`` tokens before it, in both documents,
    is shared too. Cells of a pair's tokens are open together, so the first one is always here.
    """
    before = Window.partitionBy("doc").orderBy("i", "token").rowsBetween(-LOOK_BACK, -1)  # at most the tokens of a document
    rows = rows.withColumn("met", F.collect_list("token").over(before))
    sizes = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("held"))
    major = sizes.groupBy("token").agg(F.max(F.struct("held", "comp")).alias("m")).select("token", F.col("m.comp").alias("major"))
    marked = rows.join(major, "token")
    minor = marked.filter("comp <> major").select("token", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("u").alias("ua"), F.col("i").alias("ia"), F.col("comp").alias("ca"),
                                                       F.col("met").alias("ma"))
    other = marked.select("token", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("u").alias("ub"), F.col("i").alias("ib"), F.col("comp").alias("cb"),
                          (F.col("comp") == F.col("major")).alias("main"), F.col("met").alias("mb"))
    pairs = minor.join(other, (minor.token == other.token) & F.expr("ca <> cb AND (main OR a < b)") & compatible("na", "nb", "ua", "ub", "ia", "ib")
                       & ~F.arrays_overlap("ma", "mb"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def within_windows(pairs: DataFrame, distances: DataFrame) -> DataFrame:
    """Drop pairs whose distances to a common pivot differ by over 0.2: they can't link.

    ``distances``: (a, b, distance) with a the pivot. The slack of 1e-9 only lets more pairs stay.
    """
    to = distances.select(F.col("a").alias("pivot"), F.col("b").alias("doc"), "distance")
    near = pairs.join(to.select(F.col("doc").alias("a"), "pivot", F.col("distance").alias("da")), "a")
    apart = near.join(to.select(F.col("doc").alias("b"), "pivot", F.col("distance").alias("db")), ["b", "pivot"]).filter(
        F.abs(F.col("da") - F.col("db")) > 0.2 + 1e-9).select("a", "b").distinct()
    return pairs.join(apart, ["a", "b"], "left_anti")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    NULL, empty and blank texts have no shingles and are their own component; a NULL doc_id has a NULL
    component and links with nothing. Rows that repeat a doc_id are one document that links by
    any of its texts; each row is returned. No documents: no rows. Extra columns are ignored.
    """
    find_code(docs.sparkSession)
    small_batches(docs.sparkSession)
    sets = stored(described(docs, frequent_shingles(docs)))
    usable, first = distinct_texts(sets)
    return linked_classes(docs, sets, usable, first, cells(usable, first))


def prefix_cells(docs: DataFrame, first: DataFrame) -> DataFrame:
    """``cells`` of ``docs``, by their own order of rarity. ``first``: the distinct texts among which they count."""
    with passing(docs.sparkSession) as put:
        return cells(usable_sets(put(described(docs, frequent_shingles(docs)))), first)


def usable_sets(sets: DataFrame) -> DataFrame:
    return sets.filter(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())


def distinct_texts(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a doc_id and words; (digest, first): the least doc_id of each exact text."""
    usable = usable_sets(sets)
    return usable, stored(usable.groupBy("digest").agg(F.min("doc_id").alias("first")))


def next_regions(rows: DataFrame, texts: DataFrame, distances: DataFrame | None, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``distances`` with those of one more round, and the regions that all of them show."""
    with passing(rows.sparkSession) as put:
        found = region_round(put(open_cells(with_components(rows, labels))), texts, distances)
    distances = found if distances is None else distances.unionByName(found)
    return distances, regions(distances.filter("link"))


def linked_classes(docs: DataFrame, sets: DataFrame, usable: DataFrame, first: DataFrame, rows: DataFrame, coarse: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``sets``: documents joined by links between those that share a cell.

    ``usable``, ``first``: its ``distinct_texts``; ``rows``: (token, doc, n, u, i) as from ``cells``. In each cell all pairs of different components that may
    link are measured, by pivots or at last one by one. ``coarse``: the cells of ``rows`` know no places (u and i are 0), which rules out few pairs.
    Then documents of cells that stay open after a round are dealt to the cells of their prefixes, so that a family under the limit does not meet as a whole.
    """
    texts = docs.filter(F.col("doc_id").isNotNull())
    distances, labels = None, None
    if coarse:
        distances, labels = next_regions(rows, texts, distances, labels)
        ids = stored(open_cells(with_components(rows, labels)).select(F.col("doc").alias("doc_id")).distinct())
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        rows = prefix_cells(texts.join(ids, "doc_id"), first)
    for _ in range(ROUNDS):
        distances, labels = next_regions(rows, texts, distances, labels)
    still = stored(open_cells(with_components(rows, labels)))
    with passing(docs.sparkSession) as put:
        rest = measured(within_windows(put(last_pairs(still)), distances), texts)
    links = distances.unionByName(rest).filter("link").select("a", "b")
    # a doc_id that repeats with several texts joins them
    owners = usable.join(first, "digest").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    several = owners.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).filter("lo <> hi").select("a")
    same = owners.join(several, "a").select("a", "b")
    with passing(docs.sparkSession) as put:
        graph = stored(connected_components(put(links.unionByName(same))))
    known = graph.select(F.col("node").alias("first"), "component")
    of_text = first.join(known, "first", "left").select("digest", F.coalesce("component", "first").alias("component_id"))
    known_id = F.col("doc_id").isNotNull()
    return sets.join(of_text, "digest", "left").select("doc_id", "n_shingles", F.when(known_id, F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the least doc_id, with all columns; its repeated rows stay one row.

    Rows without a doc_id stay.
    """
    groups = components(docs).filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    kept = docs.join(groups, "doc_id", "left_semi").withColumn("__row", F.row_number().over(order)).filter("__row = 1").select(*docs.columns)
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))
