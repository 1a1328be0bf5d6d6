"""Broken and hostile markup: linear time, and the same result as a plain scan."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from larder.functions import html as H

# A machine that is busy with other work may take longer.
SLACK = float(os.environ.get("TIME_SLACK", "2"))


def scan(html):
    """Straight left-to-right reading of the rule, for comparison."""
    opener = re.compile(r"<(%s)\b[^>]*>" % "|".join(H.DROPPED_TAGS), re.I | re.A)
    out, at = [], 0
    while (m := opener.search(html, at)):
        out += [html[at:m.start()], " "]
        close = html.lower().find("</" + m.group(1).lower(), m.end())
        end = html.find(">", close) if close >= 0 else -1
        if end < 0:
            return "".join(out)
        at = end + 1
    return "".join(out) + html[at:]


def test_drop_non_text_matches_a_scan(apply):
    rnd = random.Random(11)
    parts = ["<script>", "</script>", "<SCRIPT a='>'>", "</scripty x>", "<nav>", "</nav", "<navy>", "</nav >", "<form", "<p>", "text ", "<", ">",
             "<!--", "-->", "<svg/>", "</svg>", "é", "\n"]
    pages = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    assert apply(H.drop_non_text, pages) == [scan(p) for p in pages]


PIECES = ["<script>", "<aside>", "<script", "<!--", "<", "<a ", "<li ", "&#x", "&", "&a;", "&#", "&#65;", "&#x41;", "&amp;", "&Lt;", "&#x1F600;&#233;&eacute;", "</script", "<title>", "<title", "</title>", "<meta ", "<meta name=",
          "<meta content='", '<script type="application/ld+json">', "<script type=", '<a class="CaptionUsername">', '<a class="CaptionUsername"',
          '<div class="Caption">', '<img class="EmbeddedMediaImage" ', '<img src="', "<img ", '<span class="UsernameText">', "name = "]
READERS = {
    "text": H.html_to_text, "title": H.page_title, "meta": lambda c: H.meta_content(c, "og:title"),
    "json_ld": lambda c: F.array_join(H.json_ld_blocks(c), ""), "caption": H.embed_caption, "author": H.embed_author,
    "thumbnail": H.embed_thumbnail}


@pytest.mark.parametrize("reader", READERS)
def test_hostile_pages_stay_linear(spark, reader):
    """3 MB of any hostile piece, alone and inside a tag that never closes."""
    df = spark.createDataFrame([("x",)], "html string")
    expr = F.coalesce(F.char_length(READERS[reader](F.col("html"))), F.lit(0))
    df.select(expr).collect()
    for piece in PIECES:
        pages = [piece * (3_000_000 // len(piece))]
        if reader != "text":
            pages.append("<meta <img <script " + pages[0])
        for page in pages:
            df = spark.createDataFrame([(page,)], "html string")
            start = time.time()
            df.select(expr).collect()
            assert time.time() - start < 2 * SLACK, piece


def plain(pattern, html, group=1):
    m = re.search(pattern, html, re.I | re.S)
    return (m[group] or "").strip() if m else ""


OLD = {
    "title": r"<title[^>]*>(.*?)</title>",
    "author": r'<a class="CaptionUsername"[^>]*>([^<]+)</a>',
    "thumbnail": r'<img[^>]+class="EmbeddedMediaImage"[^>]+src="([^"]+)"',
}


def test_patterns_find_what_a_plain_search_finds(apply):
    rnd = random.Random(5)
    parts = [*PIECES, ">", "</a>", "</span>", '"', "x", "' ", ' src="u"', ' class="EmbeddedMediaImage"', "og", ' name="og:title"', ' content="v"', "{}"]
    pages = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    squeeze = lambda s: re.sub(r"\s+", " ", s).strip()
    keep = [p for p in pages if "&" not in p]
    for name in OLD:
        got = apply(READERS[name], keep)
        want = [plain(OLD[name], p) for p in keep]
        if name == "author":
            want = [plain(r'<span class="UsernameText">([^<]+)</span>', p) or w for p, w in zip(keep, want)]
        assert [squeeze(g or "") for g in got] == [squeeze(w) for w in want], name
    got = apply(lambda c: F.array_join(F.transform(H.json_ld_blocks(c), lambda b: F.concat(b, F.lit("|"))), ""), keep)
    pattern = r"""<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""
    want = ["".join(b.strip() + "|" for b in re.findall(pattern, p, re.I | re.S) if b.strip()) for p in keep]
    assert got == want
    meta = r"""<meta[^>]+(?:property|name)\s*=\s*["']og:title["'][^>]*>"""
    want = [plain(r"""content\s*=\s*["']([^"']*)["']""", plain(meta, p, 0)) for p in keep]
    assert [g or "" for g in apply(READERS["meta"], keep)] == want
