"""Operators 1, 2, 3 and the pipeline against brute force."""

import gc
import hashlib
import math
import random
import re
import time
import weakref
import zlib
from collections import Counter
from pathlib import Path

import frames
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from headrace.llm import hmm, jaccard, minhash, queries
from headrace.llm.common import shared_folder, stored
from headrace.session import reliable_checkpoint


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def changed(text, n, seed):
    rng, w = random.Random(seed), text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def family(spark, extra=()):
    """Exact copies, chains of near copies at and about the limit, unrelated texts that share a passage."""
    base, rows, passage = frames.prose(50, 120), [], frames.prose(51, 60)
    rows += [(i, base) for i in range(10, 18)]
    for i in range(20, 60):
        rows.append((i, changed(base, 1 + i % 6, i)))
    rows += [(i, frames.prose(i, 70) + " " + passage + " " + frames.prose(i + 500, 70)) for i in range(100, 130)]
    rows += [(i, passage + f" tail{i} more{i}") for i in range(130, 140)]
    for i in range(200, 260):
        text = frames.prose(i // 2, 40 + i % 7)
        rows.append((i, text if i % 2 else changed(text, 1, i)))
    rows += [(300, "a b c"), (301, "A  b\nc"), (302, "a b c d"), (303, "a b c d e f g h i j"), (304, "a b c d e f g h i j k"), (305, None), (306, ""), (307, " "),
             (308, ""), (None, base), (10, base), (310, frames.LONG), (311, frames.LONG + " z")]
    return frames.docs(spark, rows + list(extra))


def classes_by_hand(rows):
    sets = {}
    for r in rows:
        if r.doc_id is not None:
            sets.setdefault(r.doc_id, []).append(shingles(r.text))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("frequent", [4, 10**9])
def test_components(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT_IN_TASK", frequent)
    df = family(spark, [(11, frames.prose(60, 40)), (400, frames.prose(60, 40))])  # 11 has two texts and joins both groups
    rows = df.collect()
    want = classes_by_hand(rows)
    got = jaccard.components(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == \
        sorted((str(r.doc_id), len(shingles(r.text)), want.get(r.doc_id)) for r in rows)
    kept = jaccard.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", *(str(i) for i, c in want.items() if i == c)])
    assert jaccard.components(df.filter("false")).count() == 0


def test_components_of_longer_texts(spark):
    """The same text with 10 to 25 % of words appended, alone with it in their cells."""
    rows = []
    for i in range(96):
        n, more = (100, 200, 40)[i % 3] + 4, (100, 200, 40)[i % 3] * (10 + i // 3 % 16) // 100
        text = " ".join(f"p{i}w{j}" for j in range(n))
        rows += [(2 * i, text), (2 * i + 1, text + "".join(f" p{i}z{j}" for j in range(more)))]
    df = frames.docs(spark, rows)
    want = classes_by_hand(df.collect())
    assert all(want[2 * i + 1] == 2 * i for i in range(96))
    assert {r.doc_id: r.component_id for r in jaccard.components(df).collect()} == want


def test_last_pairs_of_one_template(spark, monkeypatch):
    """Texts of one template, most at a similarity of 0.6 to 0.79: a pair arises at the first token it shares."""
    rng, rows = random.Random(5), []
    for i in range(40):
        text = [f"t{j}" for j in range(404)]
        for j in range(20):
            text[17 * j] = f"choice{rng.randrange(3)}x{j}"
        rows.append((i, " ".join(text[: 404 - i % 5])))
    rows += [(1000 + i, frames.prose(i, 60)) for i in range(80)]
    df = frames.docs(spark, rows)
    sets = {i: shingles(t) for i, t in rows}
    sets_now = jaccard.described(df, jaccard.frequent_shingles(df))
    cells = jaccard.with_components(jaccard.cells(*jaccard.distinct_texts(sets_now)), None)
    held = {}
    for r in cells.collect():
        held.setdefault(r.doc, {})[r.token] = (r.i, r.n, r.u)
    may = jaccard.compatible("na", "nb", "ua", "ub", "ia", "ib")
    shared = [(a, b, t, x[1], y[1], x[2], y[2], x[0], y[0]) for a in held for b in held if a < b for t in held[a].keys() & held[b].keys()
              for x, y in [(held[a][t], held[b][t])]]
    every = spark.createDataFrame(shared, "a long, b long, t long, na long, nb long, ua long, ub long, ia int, ib int").filter(may)
    old = {(r.a, r.b) for r in every.select("a", "b").distinct().collect()}
    got = [(r.a, r.b) for r in jaccard.last_pairs(cells).collect()]
    assert len(got) == len(set(got)) and set(got) <= old
    linked = {(a, b) for a in sets for b in sets if a < b and sets[a] and jaccard.linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]))}
    assert linked <= set(got)
    # rows of the join, before repeated pairs go
    monkeypatch.setattr(type(cells), "distinct", lambda frame: frame)
    made = {}
    for back in (1, 4, 1000):
        monkeypatch.setattr(jaccard, "LOOK_BACK", back)
        made[back] = jaccard.last_pairs(cells).count()
    assert made[1000] == len(got) and every.count() > made[1] > made[4] > made[1000]


def test_measured_spreads_a_hot_pivot(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS_OF_PIVOT", 4)
    base = frames.prose(9, 60)
    rows = [(0, base), *((i, changed(base, i % 5, i)) for i in range(1, 60))]
    pairs = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(1, 2), (3, 2), (0, 5)], "a long, b long")
    got = {(r.a, r.b): (r.distance, r.link) for r in jaccard.measured(pairs, frames.docs(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    assert len(got) == 61
    for (a, b), (distance, link) in got.items():
        common, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        assert distance == pytest.approx(1 - common / union) and link == (100 * common >= 80 * union)


def test_fingerprints(spark):
    df = family(spark)
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    got = minhash.fingerprints(df).collect()
    assert len(got) == len(rows)
    want, near = Counter(), {}
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        a, b = r.text or "", nxt.text or ""
        n = len(a) // 4
        e = a[:len(a) - n] + b[:n]
        want[r.doc_id, len(a), hashlib.sha256(e.encode()).hexdigest()] += 1
        for key, other in (("e", e), ("n", b)):
            x, y = shingles(a), shingles(other)
            near[r.doc_id, key] = len(x & y) / len(x | y) if x | y else 1.0
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    for r in got:
        if r.doc_id not in (10, None):
            assert abs(r.near_edited - near[r.doc_id, "e"]) < 0.25 and abs(r.near_next - near[r.doc_id, "n"]) < 0.25
    prints = {}
    for r in got:
        prints.setdefault({x.doc_id: x.text or "" for x in rows}[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    alone = frames.docs(spark, [(1, "a b c d e f g h")])
    assert [(r.near_next, r.n_chars) for r in minhash.fingerprints(alone).collect()] == [(1.0, 15)]
    assert minhash.fingerprints(df.filter("false")).count() == 0


def test_duplicate_classes(spark):
    df = family(spark)
    want = classes_by_hand(df.collect())
    got = {r.doc_id: r.class_id for r in minhash.duplicate_classes(df).collect() if r.doc_id is not None}
    assert all(want[i] == want[c] for i, c in got.items())  # nothing joined that isn't
    assert sum(want[i] != c for i, c in got.items()) <= 2  # bands find nearly all


def test_duplicate_classes_miss_none(spark, monkeypatch):
    """All keys are shared by all documents: those that fail against the least doc_id of a key must still meet."""
    base = frames.prose(80, 200)
    far = [(i, changed(base, 7, i)) for i in range(1000, 1040)]
    df = family(spark, [(0, base), *far, *((i + 100, changed(t, 1, i)) for i, t in far)])
    monkeypatch.setattr(minhash, "signature", lambda text: np.zeros(minhash.PERMUTATIONS, np.uint32) if (text or "").split() else None)
    want = classes_by_hand(df.collect())
    assert want[1001] != 0 and want[1101] == want[1001]
    assert {r.doc_id: r.class_id for r in minhash.duplicate_classes(df).collect()} == {**want, None: None}


def test_band_keys_of_one_family_do_not_square(spark, monkeypatch):
    """Texts of one template, all under 0.8 to each other but for a few copies: those of one band key meet by rare shingles only."""
    base = [f"t{j}" for j in range(300)]
    rows = []
    for i in range(150):
        text = list(base)
        for j in range(i % 7, 300, 30):
            text[j] = f"own{i}x{j}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, rows[20 * i][1] + " end") for i in range(5)]
    df = frames.docs(spark, rows)
    made, inner = [], jaccard.last_pairs
    monkeypatch.setattr(jaccard, "last_pairs", lambda cells: made.append(inner(cells)) or made[-1])
    want = classes_by_hand(df.collect())
    assert [i for i in want if want[i] != i] == [1000 + i for i in range(5)]
    assert {r.doc_id: r.class_id for r in minhash.duplicate_classes(df).collect()} == want
    assert made[0].count() < len(rows)


def test_edited_signature_of_odd_texts():
    """The signature of an edited text from what was kept of the text before equals that of the whole edited text."""
    rng = random.Random(4)
    texts = ["", " ", "abc", "a b c", "one two three four", "A b  c d e f\tg h i j k l m n o p", " lead and tail  ", "\u00e9\u4e2d " * 9, "x" * 50, "w " * 40, "\x1ca\x85b " * 6]
    texts += ["".join(rng.choice("ab \n") for _ in range(rng.randrange(120))) for _ in range(60)] + [frames.prose(i, 3 + 7 * i) for i in range(8)]
    for a in texts:
        now = minhash.signed(a)
        assert now.n_shingles == len(shingles(a)) and np.array_equal(minhash.short(now.sig), minhash.short(minhash.signature(a)))
        for b in texts:
            assert minhash.short(minhash.edited_signature(now, b)) == minhash.short(minhash.signature(minhash.edited(a, b)))


def test_sets_of_the_one_pass(spark):
    df = family(spark)
    prints, sets = minhash.prints_and_sets(df)
    assert prints.count() == sets.count() == df.count()
    own = {(r.doc_id, r.class_id) for r in minhash.duplicate_classes(df).collect()}
    assert {(r.doc_id, r.class_id) for r in minhash.duplicate_classes(df, sets).collect()} == own


def test_batches_of_texts_are_small(spark):
    """A task's Python worker gets long texts by a few MB, not 10,000 rows at a time; a size set by the user stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('word and ', 1000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    try:
        spark.conf.unset(key)
        jaccard.components(df.limit(0))
        got = [r.n for r in df.mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 27_000_000 and max(got) < 6_000_000
        spark.conf.set(key, "1m")
        jaccard.components(df.limit(0))
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)


def test_minhash_query_has_classes(spark, tmp_path):
    """Near copies that are not the next doc_id are found; each row stays one row."""
    base, other = frames.prose(90, 120), frames.prose(91, 120)
    rows = [(1, base), (2, other), (3, changed(base, 1, 3)), (4, None), (5, other), (5, other), (None, base)]
    frames.docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(str(r.doc_id), r.class_id) for r in queries.op2_minhash(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([("1", 1), ("2", 2), ("3", 1), ("4", 4), ("5", 2), ("5", 2), ("None", None)], key=str)


def test_hash_family_is_uniform():
    sig = np.array([minhash.signature(f"word{i} a b c d") for i in range(2000)]).astype(float) / 2**32
    assert abs(sig.mean() - 0.5) < 0.01


def likelihood(model, classes):
    alpha = model.start * model.emit[classes[0]]
    for c in classes[1:]:
        alpha = (alpha @ model.move) * model.emit[c]
    return math.log10(alpha.sum())


def test_forward_is_exact_and_training_climbs(monkeypatch):
    monkeypatch.setattr(hmm, "HEADS", 6)
    monkeypatch.setattr(hmm, "TAILS", 2)
    rng = np.random.default_rng(0)
    model = hmm.Model(rng.dirichlet(np.ones(8)), rng.dirichlet(np.ones(8), 8), rng.dirichlet(np.ones(8), 8).T)
    lengths = np.array([9, 5, 5, 2, 1])
    classes, starts = rng.integers(0, 8, lengths.sum()), np.cumsum(lengths) - lengths
    assert np.allclose(hmm.forward(model, classes, starts, lengths), [likelihood(model, classes[s:s + n]) for s, n in zip(starts, lengths)])
    last = -np.inf
    for _ in range(10):
        start, move, emit, score = hmm.expected_counts(model, classes, starts, lengths)
        assert np.allclose([start.sum(), move.sum(), emit.sum()], [5, (lengths - 1).sum(), lengths.sum()])
        assert score >= last - 1e-9
        model, last = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)), score


def test_expected_moves_by_paths(monkeypatch):
    """Counts equal those of all state paths, one by one."""
    import itertools
    monkeypatch.setattr(hmm, "STATES", 2)
    monkeypatch.setattr(hmm, "HEADS", 2)
    monkeypatch.setattr(hmm, "TAILS", 1)
    rng = np.random.default_rng(3)
    model = hmm.Model(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(3), 2).T)
    seq = np.array([0, 2, 1, 0])
    move, emit, total = np.zeros((2, 2)), np.zeros((3, 2)), 0
    for path in itertools.product(range(2), repeat=4):
        p = model.start[path[0]] * np.prod([model.emit[c, s] for c, s in zip(seq, path)]) * np.prod([model.move[a, b] for a, b in zip(path, path[1:])])
        total += p
        for a, b in zip(path, path[1:]):
            move[a, b] += p
        for c, s in zip(seq, path):
            emit[c, s] += p
    _, m, e, score = hmm.expected_counts(model, seq, np.array([0]), np.array([4]))
    assert np.allclose(m, move / total) and np.allclose(e, emit / total) and np.isclose(score, math.log10(total))


def test_language_scores(spark, monkeypatch):
    df = family(spark)
    for chunk in (hmm.CHUNK_WORDS, 500):
        monkeypatch.setattr(hmm, "CHUNK_WORDS", chunk)
        rows = hmm.language_scores(df).collect()
        train = Counter()
        for r in df.collect():
            if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
                train.update([*words(r.text), b""])
        n, v = sum(train.values()), len(train)
        want = Counter()
        for r in df.collect():
            w = [*words(r.text), b""]
            want[r.doc_id, len(w), sum(x in train for x in w), round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)] += 1
        assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
        assert {r.train_tokens for r in rows} == {n}
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
        held = [r for r in rows if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm.language_scores(df.filter("false")).count() == 0


def test_batches_hold_every_document_once(monkeypatch):
    """Also where the last document reaches over a cut: no batch is empty."""
    monkeypatch.setattr(hmm, "BATCH_TOKENS", 10)
    rng = np.random.default_rng(4)
    for lengths in ([8, 3], [10], [1], [25, 4, 2], [], *(rng.integers(1, 30, rng.integers(1, 9)) for _ in range(300))):
        lengths = np.array(lengths, np.int64)
        batches = list(hmm.batches_by_length(lengths))
        assert all(len(b) for b in batches)
        assert sorted(i for b in batches for i in b) == list(range(len(lengths)))
        for b in batches:
            assert (np.diff(lengths[b]) <= 0).all() and lengths[b][:-1].sum() < hmm.BATCH_TOKENS


def test_a_task_holds_one_chunk_at_a_time(spark, monkeypatch):
    """However many chunks a task makes, each is a row group of its own, and its words go with it."""
    monkeypatch.setattr(hmm, "CHUNK_WORDS", 100)
    chunks = hmm.chunked(family(spark).coalesce(1))
    words, counts = hmm.word_counts(chunks)
    ready = hmm.classified(chunks, words, counts, hmm.gather(counts))
    assert chunks.count() == ready.count() > 20
    for df in (chunks, ready):
        files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in df.inputFiles()]
        assert {m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)} == {1}

    class Word:
        pass

    numbers, word = hmm.numbering(), Word()
    assert (numbers[hmm.END], numbers[word], numbers[word]) == (0, 1, 1)
    gone = weakref.ref(word)
    gc.disable()
    try:
        del numbers, word
        assert gone() is None
    finally:
        gc.enable()


def test_model_is_a_distribution(spark):
    """Shares of known tokens and one unknown per tail class add up to one for each state."""
    df = family(spark)
    chunks = hmm.chunked(df)
    _, counts = hmm.word_counts(chunks)
    found = hmm.gather(counts)
    assert found.total == counts.groupBy().sum("c").first()[0] and found.distinct == counts.count()
    assert np.isclose(found.weight.sum(), found.total)
    tails = [r for r in counts.collect() if bytes(r.word) not in found.heads]
    mass = np.zeros(hmm.TAILS)
    for r in tails:
        k = hmm.tail_class(bytes(r.word)) - hmm.HEADS
        mass[k] += (r.c + 0.5) / (found.tail_total[k] + 0.5 * (found.tail_distinct[k] + 1))
    mass += 0.5 / (found.tail_total + 0.5 * (found.tail_distinct + 1))
    assert np.allclose(mass, 1)


def test_pipeline(spark, tmp_path):
    bench = frames.prose(70, 20)
    junk = [(i, " ".join(w.upper() + "$$$!!" for w in frames.prose(i, 40).split())) for i in range(500, 540)]
    clean = [(i, frames.prose(i, 90)) for i in range(600, 700)]
    near = [(i, changed(clean[0][1], 1, i)) for i in range(700, 705)]
    dirty = [(i, frames.prose(i, 30) + " " + bench + " " + frames.prose(i + 1, 30)) for i in range(710, 716)]
    frames.docs(spark, junk + clean + near + dirty, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 0, 0) for i, _ in junk] + [(i, 1, 0) for i, _ in clean], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert len(corpus_pipeline.STAGES) == 4
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i for i, _ in clean}


def test_stored_tables_leave_no_shuffle_files_or_texts(spark):
    """The shuffle files of a write go when it ends; no copy stays of texts that were measured; digests are stored as bytes."""
    base = Path(shared_folder(spark).removeprefix("file:")).parent
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffle_files() -> int:
        files = disk.getAllFiles()
        return sum("/shuffle_" in str(files.apply(i)) for i in range(files.size()))

    df, tables, held = family(spark).repartition(2), set(base.glob("*/*.parquet")), shuffle_files()
    written = stored(df.groupBy("text").count())
    for _ in range(50):
        if shuffle_files() <= held:
            break
        time.sleep(0.1)
    assert shuffle_files() <= held and written.count() > 10
    prints, sets = minhash.prints_and_sets(df)
    minhash.duplicate_classes(df, sets)
    fields = [pq.read_schema(f) for f in set(base.glob("*/*.parquet")) - tables]
    assert [f for f in fields if "digest" in f.names] and not [f for f in fields if "text" in f.names and "fingerprint" not in f.names and "count" not in f.names]
    assert {str(f.field(c).type) for f in fields for c in ("edited_sha256", "fingerprint", "edited_fingerprint") if c in f.names} == {"binary"}


def test_passing_tables_and_checkpoints_leave_no_files(spark):
    """Tables that one step reads go with it, and so do the shuffle files of a checkpoint."""
    base = Path(shared_folder(spark).removeprefix("file:")).parent
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffle_files() -> int:
        files = disk.getAllFiles()
        return sum("/shuffle_" in str(files.apply(i)) for i in range(files.size()))

    df, tables, held = family(spark).repartition(2), set(base.glob("*/*.parquet")), shuffle_files()
    kept = reliable_checkpoint(df.groupBy("text").count())
    for _ in range(50):
        if shuffle_files() <= held:
            break
        time.sleep(0.1)
    assert shuffle_files() <= held and kept.count() > 10
    jaccard.components(df)
    left = {tuple(pq.read_schema(f).names) for f in set(base.glob("*/*.parquet")) - tables}
    assert ("a", "b", "distance", "link") in left
    assert not left & {("a", "b"), ("a", "parts"), ("token", "n"), ("token", "doc", "n", "i"), ("doc_id", "text")}
