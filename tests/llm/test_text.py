"""Operators 4, 5, 7: contamination, licences and quality against plain code."""

import hashlib
import re
import zlib

import frames
import numpy as np
import pytest

from headrace.llm import decontaminate, licenses, quality

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def windows(text):
    w = words(text)
    return [w[i:i + 13] for i in range(max(1, len(w) - 12))] if w else []


def test_words_follow_the_pattern():
    from headrace.llm.common import plain_words, space_words
    for text in ("A-b_c D9é\x7fÀÉ x\x0bq", None, "", "!!", frames.LONG[:500]):
        assert plain_words(text) == words(text)
        assert space_words(text) == re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def test_contamination(spark, monkeypatch):
    item, near, short = frames.prose(20, 30), frames.prose(21, 15), "Only THREE words"
    docs = frames.docs(spark, [
        (0, frames.prose(30, 60) + " " + item + " " + frames.prose(31, 60)), (1, "x " + short.lower() + "! y"), (2, None), (3, ""),
        (4, frames.prose(32, 600) + " " + " ".join(near.split()[:13]) + " z"), (5, " ".join(near.split()[:12])), (5, frames.prose(33, 10)),
        (6, item), (6, item), (None, item), (7, frames.LONG)])
    bench = spark.createDataFrame([(1, item, "t"), (2, near, "t"), (3, short, "t"), (4, None, "t"), (5, "", "t"), (10, item, "t"), (None, item, "t"),
                                   (11, "absent words here", "t")], "item_id long, text string, doc_id string")

    def by_hand(text):
        w, hit, items = words(text), set(), set()
        for r in bench.collect():
            for win in windows(r.text) if r.item_id is not None else ():
                for i in range(len(w) - len(win) + 1):
                    if w[i:i + len(win)] == win:
                        hit.update(range(i, i + len(win)))
                        items.add(str(r.item_id))
        names = ",".join(sorted(items))
        return len(w), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)

    want = sorted((str(r.doc_id), *by_hand(r.text)) for r in docs.collect())
    for block in (decontaminate.BLOCK_WORDS, 20):  # one block and several
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = decontaminate.contamination(docs, bench).drop("items", "spans").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == want
        clean = decontaminate.keep_clean(docs, bench)
        assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)
    assert sum(w[-1] for w in want) >= 5
    assert decontaminate.contamination(docs, bench.filter("false")).filter("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.contamination(docs.filter("false"), bench).count() == 0


def licence_by_hand(text):
    w = words(text)
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.encode().split()]
    return (len(w), len(places), min((p[0] for p in places), default=None), max((p[0] for p in places), default=None),
            ",".join(sorted({p[1] for p in places})))


def test_licences(spark):
    texts = ["MIT License MIT license, mit-license", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0. gnu General  public\nLICENSE",
             "mit licenses", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */ x", None, "", "permit license",
             "spdx-license-identifier: nonsense and more", frames.LONG + " MIT License", "SPDX-License-Identifier: MIT."]
    df = frames.docs(spark, [*enumerate(texts), (0, texts[0]), (None, texts[1])])
    rows = licenses.license_scan(df).collect()
    assert sorted((str(r.doc_id), *map(str, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in rows) == \
        sorted((str(r.doc_id), *map(str, licence_by_hand(r.text))) for r in df.collect())
    by_id = {r.doc_id: r for r in rows}
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    assert by_id[2].labels == "cc-by,cc-by-nc,gpl" and by_id[4].labels == "apache-2.0,gpl-2.0-only,mit"
    assert abs(by_id[4].score - 0.37) < 1e-9 and by_id[8].labels == "" and by_id[10].score == 0.95
    assert licenses.license_scan(df.filter("false")).count() == 0


@pytest.mark.parametrize("tag, labels, score", [
    ("MIT AND Artistic-2.0", "artistic-2.0,mit", 0.05), ("Apache-2.0 OR EUPL-1.2", "apache-2.0,eupl-1.2", 0.9),
    ("CDDL-1.0", "cddl-1.0", 0.05), ("WTFPL", "wtfpl", 0.05), ("PostgreSQL or curl", "curl,postgresql", 0.05),
    ("(OFL-1.1 OR MIT) AND GPL-2.0-only", "gpl-2.0-only,mit,ofl-1.1", 0.3), ("MIT and more", "mit", 0.95)])
def test_unlisted_licences_are_labels(tag, labels, score):
    found = licenses.scan(f"// SPDX-License-Identifier: {tag}")
    assert found["labels"] == labels and abs(found["score"] - score) < 1e-9


def test_shunting_yard():
    post = lambda s: licenses.to_postfix(re.findall(r"[()]|[^\s()]+", s))
    assert post("MIT OR Apache-2.0 AND GPL-2.0") == ["MIT", "Apache-2.0", "GPL-2.0", "and", "or"]
    assert post("(MIT OR ISC) AND GPL-2.0 WITH x") == ["MIT", "ISC", "or", "GPL-2.0", "x", "with", "and"]
    for bad in ("MIT ISC", "AND MIT", "(MIT", "MIT)", "MIT OR", "()", ""):
        assert post(bad) is None


def test_quality(spark):
    good = [(i, frames.prose(i, 60 + i)) for i in range(120)]
    bad = [(200 + i, " ".join(w + "$$$" for w in frames.prose(i, 50).split()).upper()) for i in range(60)]
    odd = [(1000, None), (1001, ""), (1002, frames.LONG), (None, "plain words"), (0, good[0][1])]
    docs = frames.docs(spark, good + bad + odd)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(1000, None, 1), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    truth = {**{i: 1 for i, _ in good}, **{i: 0 for i, _ in bad}}
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 20 and all(r.held_out and r.predicted == truth[r.doc_id] for r in held)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    # held-out labels change nothing
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert sorted(map(str, quality.quality_scores(docs, flipped).collect())) == sorted(map(str, rows))
    assert {r.score for r in quality.quality_scores(docs, labels.filter("false")).collect()} == {0.5}
    assert quality.quality_scores(docs.filter("false"), labels).count() == 0


def test_trees_split_where_labels_do():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(2000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.3)).astype(float)
    assert ((quality.fit(x, y).score(x) > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("text, labels", [
    ("SPDX License Identifier: MIT", "mit"), ("spdx_license--identifier = (Apache-2.0 OR MIT)", "apache-2.0,mit"),
    ('{"SPDX-License-Identifier": "MPL-2.0"}', "mpl-2.0"), ("/* SPDX-License-Identifier:\n * GPL-2.0-only OR MIT\n */", "gpl-2.0-only,mit"),
    ("x SPDX-License-Identifier:\r\n# BSD-3-Clause", "bsd-3-clause"), ("é SPDX-License-Identifier: ISC\nSPDX License\tIdentifier: Zlib", "isc,zlib"),
    ("SPDX-License-Identifier:\nThe Foo is free", ""), ("the SPDX license identifier is used here", ""), ("SPDX License Identifier List", ""),
    ("SPDX-License-Identifier:", ""), ("SPDX-License-Identifier:\n\n", ""), ("xSPDX-License-Identifier: MIT", "")])
def test_tag_forms(text, labels):
    assert licenses.scan(text)["labels"] == labels
