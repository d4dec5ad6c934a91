"""Operators 6 and 10: archives round trip, main text of pages."""

import hashlib
import itertools
import random

import frames
import pytest

from headrace.llm import mincut, warc


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    big, other = "<p>" + frames.prose(1, 60), "<p>é\r\n\r\nWARC/1.1\r\n" + frames.prose(2, 60)
    rows = [(5, "http://a b/\n", big), (3, None, big), (9, "u", big), (4, "u", other), (4, "u", other), (6, "u", "tiny"), (7, "u", "tiny"),
            (8, "u", None), (1, "", ""), (None, "u", big), (2, "u", frames.LONG)]
    df = frames.pages(spark, rows)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(df).collect())
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and h == html and len(body) >= 100]
        first = min(same, default=page)
        revisit = page != first
        want.append((str(page), len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want)
    assert warc.warc_round_trip(df.filter("false")).count() == 0


@pytest.mark.parametrize("version", [b"1", b"2"])
def test_legacy_versions(version):
    blocks = [b"HTTP/1.1 200 OK\r\n\r\nbody\n\nwith lines", b"", b"x" * 1000]
    arc = warc.arc_header(version, "f.arc", "20010203") + b"\n".join(warc.arc_record(version, "http://x/a b", "20010203", "text/html", b, "f.arc", 0) for b in blocks)
    read = list(warc.read_arc(arc))
    assert [b for _, b in read] == blocks and {h[b"URL"] for h, _ in read} == {b"http://x/a%20b"}
    assert warc.iso_date("20010203") == "2001-02-03T00:00:00Z" and warc.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    for broken in (arc[:-5], b"http://x 0.0.0.0 2001 text/html 3\nabc\n", arc.replace(b"1 0 headrace", b"7 0 headrace").replace(b"2 0 headrace", b"7 0 headrace")):
        with pytest.raises(ValueError):
            list(warc.read_arc(broken))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News, all of the news.</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><header><h1>Head &amp; line</h1></header><p>First <b>bo</b>ld&nbsp;text,
 two   lines.<br>After a break.<p>Second &lt;tag&gt; A &copy; B.<div class="ad">Buy this now, it is cheap.</div><form><label>Mail</label><input></form>
<ul><li>Item one<li>Item two</ul><!-- <p>hidden</p> --><aside>Side note text.</aside><p hidden>Unseen</p>
<section class="comments"><p>I liked this article very much, thank you for it.</p></section></article>
<footer>&copy; all rights, some more words here.</footer></body></html>"""


def test_main_text(spark):
    want = "Head & line First bold text, two lines. After a break. Second <tag> A © B. Item one Item two"
    plain = "<body><nav><a>x</a></nav><div><p>" + "</p><p>".join(frames.prose(i, 20) + "." for i in range(4)) + "</p></div><footer>f</footer>"
    rows = [(1, "u", PAGE), (2, None, plain), (3, "u", None), (4, "u", ""), (None, "u", "just text"), (1, "u", PAGE), (5, "u", "<article><p>cut off <b>here"),
            (6, "u", "<article>" + "<p>Some text of a long page.</p>" * 20_000)]
    got = mincut.main_text(frames.pages(spark, rows)).collect()
    by_id = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by_id[1] == want and by_id[3] == by_id[4] == "" and by_id[None] == "just text" and by_id[5] == "cut off here"
    assert by_id[2] == " ".join(frames.prose(i, 20) + "." for i in range(4))
    assert by_id[6] == " ".join(["Some text of a long page."] * 20_000)
    assert all(r.n_chars == len(r.text) for r in got)
    assert mincut.main_text(frames.pages(spark, rows).filter("false")).count() == 0


def test_cut_is_least():
    rng = random.Random(0)
    for _ in range(200):
        n = rng.randint(1, 8)
        odds = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 6)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda side: sum(abs(o) for o, s in zip(odds, side) if (o > 0) != s and o) + sum(w for u, v, w in edges if side[u] != side[v])
        assert cost(mincut.min_cut(odds, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


@pytest.mark.parametrize("page", ["<", "</p>", "<p", "<a <b>", "<!-- x", "<script>abc", "<div>" * 3000 + "x", "</div>" * 500, "&#xFFFFFFF; &bad; &amp", "<p title='a>b'>x", "<x y=\"z>q"])
def test_broken_markup(page):
    assert all(b == " ".join(b.split()) for b in mincut.main_blocks(page))
