"""Operator 5: licence notices and identifier tags found by one automaton, expressions by shunting-yard."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame

from headrace.llm.common import plain_words, with_results

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices, by words as in the base phrases.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "bsd license": "bsd", "isc license": "isc",
    "boost software license": "bsl", "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0 1 0": "cc0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
}
#: The words of an identifier tag.
TAG = "spdx license identifier"
#: How freely text under a licence may be used, 0 to 1. Labels of tags are matched by their longest known start.
FREEDOM = {
    "cc0": 1.0, "0bsd": 1.0, "unlicense": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95, "bsl": 0.95, "zlib": 0.95,
    "apache": 0.9, "cc-by": 0.85, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2,
    "cc-by-nd": 0.2, "cc-by-nc": 0.1, "licenseref": 0.05,
}
#: Value of identifiers that are not in ``FREEDOM``: terms unknown here, as of a ``LicenseRef``.
UNKNOWN = 0.05
#: Identifiers of the SPDX list that look like plain words when written in small letters.
WORDS = frozenset(
    "aal abstyles afmparse aml ampas bahyph barr beerware blessing borceux caldera checkmk crossword crystalstacker cube curl diffmark doc dotseqn "
    "dsdp dtoa dvipdfm egenix entessa eurosym fair freeimage ftl giftware glide glulxe glwtpl gnuplot gtkbook haskellreport hdparm hpnd icu ijg "
    "imagemagick imatix intel ipa jpnic json kastrup kazlib leptonica libpng libtiff loop lsof magaz mailprio makeindex metamail miros mitnfa "
    "motosoto mplus mtll mup naumen ncsa netcdf newsletr ngpl nlpl nokia noweb nrl ntp ogtsl oml openssl openvision padl pkgconf plexus pnmstitch "
    "postgresql psfrag psutils qhull radvd rdisc ruby saxpath scea sendmail sissl sleepycat smlnj snia snprintf softsurfer soundex swl swrule tcl "
    "threeparttable tmate ulem vim vostrom wsuipa wtfpl xerox xfig xinetd xlock xnet xpp xskat xzoom zed zeeff".split())
#: Precedence of the operators: ``with`` binds closest.
RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
#: What stands between a tag's words and its expression: quotes, a colon or equals sign, and on a new line comment marks.
_AFTER = re.compile(r"[-\s\"'`*]*[:=][ \t\"'`*]*(?P<next>\r?\n[\s#/*;\"'`-]*)?")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def named(token: str) -> bool:
    """Whether an operand is written as an identifier: any but a plain word in small letters that names no licence."""
    return not (token.isalpha() and token.islower()) or token in FREEDOM or token in WORDS


def freedom(name: str) -> float:
    """Value of a licence identifier by its longest known start; ``UNKNOWN`` without one."""
    name = name.lower()
    parts = name.split("-")
    for k in range(len(parts), 0, -1):
        if (value := FREEDOM.get("-".join(parts[:k]))) is not None:
            return value
    return UNKNOWN


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard; None if the tokens are no expression. Operators in any letter case."""
    out, stack, operand = [], [], True
    for token in tokens:
        low = token.lower()
        if token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif low in RANK:
            if operand:
                return None
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str]) -> tuple[float, set[str]] | None:
    """(value, identifiers): ``or`` lets one choose the freer side, ``and`` binds to both, ``with``
    adds a permission (a tenth of what is missing). None if an operand is a word of prose."""
    stack: list[tuple[float | None, set[str]]] = []
    for token in postfix:
        if token in RANK:
            (b, right), (a, left) = stack.pop(), stack.pop()
            if a is None or token != "with" and b is None:
                return None
            value = max(a, b) if token == "or" else min(a, b) if token == "and" else a + (1 - a) / 10
            stack.append((value, left if token == "with" else left | right))
        else:
            stack.append((freedom(token) if named(token) else None, {token.lower()}))
    value, names = stack[0]
    return None if value is None else (value, names)


def expression(text: str, whole: bool = False) -> tuple[float, set[str]] | None:
    """The longest expression at the start of a line's rest; prose may follow it, unless the ``whole`` rest is asked for.
    Unlisted identifiers are part of it."""
    tokens, at = [], 0
    while m := _TOKEN.match(text, at):
        tokens.append(m[1].rstrip(".:") or m[1])
        at = m.end()
    if whole and text[at:].strip(" \t\r\"'`*/;,>-"):
        return None
    for k in range(len(tokens), len(tokens) - 1 if whole else 0, -1):
        if (postfix := to_postfix(tokens[:k])) and (found := evaluate(postfix)):
            return found
    return None


@cache
def automaton():
    """All phrases and the tag, with a space on both sides so that only whole words match. One per worker."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE, TAG: ""}:
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


def ends_of_words(text: str, numbers: list[int]) -> Iterator[int]:
    """Places in the text where the words of these ascending numbers end."""
    if numbers:
        wanted = iter(numbers)
        number = next(wanted)
        for i, m in enumerate(_WORD.finditer(text)):
            if i == number:
                yield m.end()
                if (number := next(wanted, None)) is None:
                    return


def scan(text: str | None) -> dict:
    """What ``license_scan`` returns for one text, and ``spans``: (first word, words, label) of each base place."""
    words = plain_words(text)
    line = f" {b' '.join(words).decode('latin-1')} "
    spans, base, notices, tags, values, tagged = [], set(), set(), set(), [], []
    for end, phrase in automaton().iter(line) if words else ():
        if phrase == TAG:
            tagged.append(line.count(" ", 0, end) - 1)  # number of the tag's last word
        elif phrase in BASE:
            start = line.count(" ", 0, end - len(phrase)) - 1
            spans.append((start, phrase.count(" ") + 1, BASE[phrase]))
            base.add(BASE[phrase])
        if phrase in NOTICES:
            notices.add(NOTICES[phrase])
    for at in ends_of_words(text, tagged):
        if after := _AFTER.match(text, at):
            rest = text[after.end():].split("\n", 1)[0]
            if found := expression(rest, whole=after["next"] is not None):
                values.append(found[0])
                tags |= found[1]
    values += [freedom(x) for x in base | notices]
    return {"n_words": len(words), "n_base": len(spans), "first_word": min((s[0] for s in spans), default=None),
            "last_word": max((s[0] for s in spans), default=None), "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | notices | tags)), "score": float(min(values, default=0.0)),
            "spans": [dict(zip(("word", "words", "label"), s)) for s in spans]}


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per row of ``docs``.

    ``spans``: every base place as (word, words, label). All parts of a text bind together, so the
    score is the least value of its notices and expressions (``UNKNOWN`` for unlisted identifiers); 0 without any. A tag is its
    three words with any signs between them, then a colon or equals sign; its expression begins on that line and may end
    before it, or is the whole next line. NULL and empty texts have
    no words and no labels. Repeated rows keep a row each; extra columns are ignored.
    """
    return with_results(docs, ["doc_id"], lambda texts: [scan(t) for t in texts],
                        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
                        "score double, spans array<struct<word: long, words: long, label: string>>")
