"""Main text of pages against another parser, and repeated windows against a plain count."""

from __future__ import annotations

import collections
import random
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.llm import op13_html as op13
from tests.conftest import DATA
from tests.llm.helpers import prose


class Article(HTMLParser):
    """Blocks of the article element, for the test pages: headings and paragraphs."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        self.blocks += [""] if tag in ("h1", "p", "article") else []
        self.blocks[-1] += " " * (tag == "br")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        self.blocks += [""] if tag in ("h1", "p") else []

    def handle_data(self, data):
        self.blocks[-1] += data if self.inside else ""

    def text(self):
        return "\n\n".join(t for t in (" ".join(b.split()) for b in self.blocks) if t)


@pytest.mark.parametrize("folder", [DATA, DATA.replace("0.001", "0.01")])
def test_registered_query_whole_table(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    wanted = {p["page_id"]: (p["url"], Article(p["html"]).text()) for p in pages}
    got = op13.op13_html_main_text(spark, folder).collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in got} == wanted and len(got) == len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


CASES = {
    "plain": ("<p>One &amp; two</p>three", "One & two\n\nthree"),
    "white space": ("<article><p>a\n\t b&nbsp;&#32;c<br>d <b>e</b>f</p></article>", "a b c d ef"),
    "chrome": (
        "<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><main><header><h1>Title</h1></header><p>Text.</p><aside>More</aside><form><label>Mail</label></form>"
        "<div class='share-buttons'>Share</div><section id=comments><p>Nice!</p></section><footer>by me</footer></main><footer>&copy; us</footer>",
        "Title\n\nText.",
    ),
    "names": ("<div class='cookie-notice'>We use cookies</div><div id='main-nav'>Menu</div><div class='page has-sidebar'><div class='post'><h2>T</h2><p>Body</p></div><div class='sidebar'>S</div></div>", "T\n\nBody"),
    "scripts": ("<article><script>var t='</p><p>x';if(a<b){}</script><style>p{}</style><p>y<!-- <p>no</p> --></p><noscript>on</noscript></article>", "y"),
    "unclosed": ("<article><h1>T<p>one<p><b>two<li>three<li>four", "T\n\none\n\ntwo\n\nthree\n\nfour"),
    "stray ends": ("</div></p><article></b><p>a</i> b</p></span></article></article>c", "a b"),
    "quotes": ('<article><p title="a > b" data-x=\'<p>\'>text</p><p title="open>more</p></article>', "text\n\nmore"),
    "cut": ("<article><p>whole</p><p class='x", "whole"),
    "less than": ("<article><p>1 < 2 &lt;b&gt; 3<4</p></article>", "1 < 2 <b> 3<4"),
    "inline chrome": ("<article><p>before<button>Like</button> after <span class=ad>Buy</span>now</p></article>", "before after now"),
    "hidden": ("<article><p hidden>a</p><p style='display: none'>b</p><p aria-hidden=true>c</p><p>d</p></article>", "d"),
    "link lists": ("<ul><li><a href=1>One</a></li><li><a href=2>Two words</a></li></ul><p>See <a href=3>this</a>.</p>", "See this."),
    "tables": ("<article><table><tr><td>a<td>b<tr><td>c</table><dl><dt>t<dd>d</dl></article>", "a b\n\nc\n\nt\n\nd"),
    "roles": ("<div role=navigation>n</div><div role=main><p>m</p><div role='complementary'>k</div></div>x", "m"),
    "comment articles": ("<article><p>story</p></article><article class='comment'><p>I say</p></article>", "story"),
    "nothing": ("<nav>only a menu</nav>", ""),
    "no markup": ("just words\n\nhere", "just words here"),
    "upper case": ("<ARTICLE><P>A</P><SCRIPT>x</SCRIPT></ARTICLE>", "A"),
}


@pytest.mark.parametrize("case", CASES)
def test_markup(case):
    page, wanted = CASES[case]
    assert op13.main_text(op13.blocks_of(page)) == wanted


def plain_repeats(streams, run=op13.RUN):
    """(host, number, start) of every window that is on two distinct streams of its host."""
    on = collections.defaultdict(set)
    for host, number, s in streams:
        for i in range(len(s) - run + 1):
            on[host, tuple(s[i : i + run])].add(number)
    return {(number, i) for host, number, s in streams for i in range(len(s) - run + 1) if len(on[host, tuple(s[i : i + run])]) > 1}


@pytest.mark.parametrize("shard", [40, 1 << 19])
def test_repeated_windows_over_shards(spark, shard):
    r = random.Random(3)
    shared = [[r.randrange(50) for _ in range(r.randrange(8, 20))] for _ in range(4)]
    made = []
    for number in range(60):
        s = [r.randrange(30) for _ in range(r.randrange(0, 40))]
        for _ in range(r.randrange(3)):
            s += r.choice(shared) + [r.randrange(10**6)]
        made.append((r.choice("aaab"), number, s))
    made.append(("a", 60, [7] * 60))  # repeats within a page are no repeats across pages
    made = [m for m in made if m[2]]
    rows = [(h, n, bytearray(np.array(s, np.uint32).tobytes()), len(s), n % 5 > 0) for h, n, s in made]
    distinct = spark.createDataFrame(rows, "host string, sid long, stream binary, n_tokens long, asked boolean")
    got = [tuple(x) for x in op13.repeats(distinct, shard).collect()]
    assert len(got) == len(set(got)) and set(got) == {(n, i) for n, i in plain_repeats(made) if n % 5}


def page(body, top="Welcome to our site where you read all about the many things we like"):
    return f"<html><body><div><div>{top}</div><div>Home of good stories and of much more than that every single day</div>{body}<div>All rights reserved by the owners of this site and their friends</div></div></body></html>"


def test_boilerplate_of_a_host_goes_without_help_of_markup(spark):
    bodies = {i: (f"<h2>{prose(i, 6)}</h2>", f"<p>{prose(100 + i, 40)}</p>") for i in range(30)}
    rows = [(i, f"https://One.example.com/{i}", page("".join(b))) for i, b in bodies.items()]
    rows += [(100, "https://two.example.com/1", page("".join(bodies[0]))), (101, "https://one.example.com/copy", rows[3][2])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    wanted = {i: f"{h[4:-5]}\n\n{p[3:-4]}" for i, (h, p) in bodies.items()}
    for shard in (300, 1 << 19):
        got = {r["page_id"]: r["text"] for r in op13.extract(pages, shard=shard).collect()}
        assert {i: got[i] for i in bodies} == wanted and got[101] == wanted[3]
        assert got[100].startswith("Welcome to our site") and wanted[0] in got[100]  # the host's only page: nothing is repeated


def test_extraction_takes_anything(spark):
    long_page = "<article>" + "".join(f"<p>{prose(i, 50)}</p>" for i in range(3000)) + "</article>"
    rows = [(1, "https://a.example.com", None), (2, None, ""), (None, "no host", "<p>x"), (3, "http://b.example.com/", long_page), (3, "http://b.example.com/", long_page), (4, None, "<p>y z"), (5, None, None), (6, "http://c.example.com", "<" * 500 + "&" * 500)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("own") for c in ("text", "host", "key", "sid", "stream", "blocks", "address")})
    got = op13.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    wanted = [(i, u, op13.main_text(op13.blocks_of(h or ""))) for i, u, h in rows]
    assert sorted(map(repr, ((r["page_id"], r["url"], r["text"]) for r in got.collect()))) == sorted(map(repr, wanted))
    assert sum(len(w[2]) > 500_000 for w in wanted) == 2
    assert op13.extract(pages.limit(0)).count() == 0


def article(*paragraphs, side="Menu"):
    return f"<body><nav>{side}</nav><article>{''.join(f'<p>{p}</p>' for p in paragraphs)}</article></body>"


def test_a_notice_of_most_articles_of_a_host_goes_and_quotations_stay(spark):
    notice, quote = prose(900, 15), prose(901, 15)
    own = {i: [prose(i, 25), prose(500 + i, 25)] for i in range(60)}
    own[7].append("w1 w2")  # a marked block of its own words only
    rows, wanted = [], {}

    def add(host, number, paragraphs, kept):
        rows.append((number, f"https://{host}/{number}", article(*paragraphs, side=f"Menu {number}")))
        wanted[number] = "\n\n".join(kept)

    for i, two in own.items():
        quoted = [quote] if i % 3 else []  # on two thirds: no boilerplate
        with_notice = [notice] if i % 8 else []  # on seven eighths
        add("One.example.com", i, [two[0], *with_notice, *quoted, *two[1:]], [two[0], *quoted, *two[1:]])
    for i in range(9):  # too few to tell
        add("few.example.com", 100 + i, [notice, *own[i]], [notice, *own[i]])
    for i in range(40):  # near copies are whole, and one article in rows of other menus is one
        add("near.example.com", 200 + i, [own[0][0], own[1][0], f"number {i}"], [own[0][0], own[1][0], f"number {i}"])
        add("copies.example.com", 300 + i, [notice, *own[2]], [notice, *own[2]])
    for i in range(8):
        add("copies.example.com", 400 + i, own[10 + i], own[10 + i])
    add("copies.example.com", 410, own[20], own[20])
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for shard in (300, 1 << 19):
        got = {r["page_id"]: r["text"] for r in op13.extract(pages, shard=shard).collect()}
        assert got == wanted


@pytest.mark.parametrize("shard, book", [(1 << 19, 1 << 19), (300, 1 << 19), (300, 0)])
def test_windows_of_most_articles_over_shards(spark, monkeypatch, shard, book):
    monkeypatch.setattr(op13, "BOOK", book)
    r = random.Random(5)
    passages = [(prose(700 + k, 12), share) for k, share in enumerate((0.6, 0.7, 0.73, 0.76, 0.8, 0.95))]
    made = [(h, article(*[p for p, share in passages if r.random() < share], prose(i, 20))) for h, n in (("a.com", 150), ("b.com", 12), ("c.com", 9)) for i in range(n)]
    made += made[:40]
    texts = spark.createDataFrame([(h, page) for h, page in made], "host string, html string")
    sizes = op13.streams(texts.withColumn("url", F.concat(F.lit("http://"), "host")), "html", "url").select("host", "article", "n_article")
    got = {(x["host"], w["w1"], w["w2"]) for x in op13.shared_by_most(texts, sizes, shard).collect() for w in x["windows"]}
    on, articles = collections.defaultdict(set), collections.defaultdict(set)
    for h, page in set(made):
        s = op13.stream_of(op13.blocks_of(page), True)
        articles[h].add(page)
        for w1, w2 in zip(*op13.window_ids(s, np.arange(len(s) - op13.RUN + 1), h)):
            on[h, int(w1), int(w2)].add(page)
    wanted = {w for w, p in on.items() if len(articles[w[0]]) >= op13.LEAST and len(p) > op13.MOST * len(articles[w[0]])}
    assert got == wanted and {w[0] for w in wanted} == {"a.com", "b.com"}
