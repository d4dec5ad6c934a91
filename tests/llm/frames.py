"""Small frames with the awkward cases that every operator must take."""

from __future__ import annotations

import random

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(("river", "dam", "water", "the", "of", "flow", "Gate", "été", "year")) + str(rng.randrange(60)) for _ in range(n))


def docs(spark, rows, extra: bool = True):
    """(doc_id, text) rows with the other columns of documents and, if ``extra``, names that clash."""
    full = [(i, t, "en", "src0", len(t or ""), 1, "x", 2.0) for i, t in rows]
    frame = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                        "piece int, quality_score string, score double")
    return frame if extra else frame.drop("piece", "quality_score", "score")


def awkward(spark):
    """NULL id, NULL, empty and blank texts, a repeated row, copies, ties and a very long text."""
    a, b = prose(1, 80), prose(2, 80)
    return docs(spark, [(0, a), (1, None), (2, ""), (3, " \n\t "), (4, a), (4, a), (5, a + " end"), (6, b), (None, b), (7, LONG), (8, "one two")])


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, first int")
