"""Main text of web pages: the markup's own words, and suffix arrays of each host for what markup does not tell.

A page is cut into blocks (paragraphs, headings, list items), each with what its enclosing elements say of it: chrome (menus, footers, forms,
adverts, comments ...), the article, or neither. A stream is the tokens of blocks (a mark for the block's element, then its words): every page has one
of its marked article and one of what is outside. The streams of a host's distinct pages are concatenated and their suffixes sorted by their first
``RUN`` tokens; an interval of equal suffixes is a substring repeated across pages, and longer repeats are unions of such windows.

Of pages without a marked article, what windows on two pages or more cover is boilerplate: blocks go that markup calls chrome, that are links only,
or half of whose words are covered; the others, the unique runs, stay. A marked article may quote and be copied, so two pages tell nothing of it: there
only windows on over ``MOST`` of the host's distinct articles, of which it must have ``LEAST``, are boilerplate (a notice that each article repeats). Blocks
half covered by them go, unless that were half of the article's words: then the articles are near copies, and this one stays whole.

A host's streams are dealt to shards of about ``SHARD`` tokens, small hosts share a group, and each group is one array, so that a host with a third of all
pages is spread over tasks. Results do not depend on the dealing. Outside articles each array of a host of several shards also gives every window once, as
128 bits with its number of pages, and the sums over shards count. Of articles it gives the windows on over ``MOST`` of its own; a window on over ``MOST``
of all is among those of one shard at least, and the few that any gives are counted in all. Pages with equal streams are one.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import byte_slices, hot_join, map_arrow, materialize, ship, table

RUN = 8  # tokens of a repeated substring
PAGES = 2  # distinct pages that it must be on
SHARD = 1 << 19  # tokens sorted together
COVERED = 0.5  # share of a block's words that makes it boilerplate
MOST = 0.75  # share of a host's articles that a window must be on more of, to be boilerplate within articles
LEAST = 10  # articles of a host that can tell so
SPREAD = 32  # articles that a shard has at least, on average
BOOK = 1 << 19  # windows that are broadcast
CHROME, OPEN, CONTENT, ARTICLE = range(4)

# fixed values: elements and names by what they hold
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th"))
CHROME_TAGS = frozenset("aside audio button canvas datalist dialog embed fieldset footer form head menu nav noscript object search select svg template video".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CHROME_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs byline-share comment commentlist comments consent cookie cookies disqus discussion footer gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related replies reply respond responses share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
WRAPPERS = frozenset("has with without no not is layout".split())  # a name with one of these is of a frame around all
CONTENT_NAMES = frozenset("article article-body article-content content entry entry-content main main-content page-content post post-body post-content story story-body".split())
ENDS = {  # an element that such a start tag ends, and what it does not reach across
    "li": (frozenset(["li"]), frozenset("ul ol dir menu".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (CELLS, frozenset(["tr", "table"])),
    "th": (CELLS, frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}

MARK = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z""", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)"


class Block(NamedTuple):
    kind: int
    tag: str
    linked: bool  # links hold all of it
    text: str


def chrome_name(name: str) -> bool:
    """Whether a class or id speaks of chrome: one of its words does, unless it is of a frame (``has-sidebar``)."""
    words = re.split(r"[^a-z0-9]+", name)
    return name in CHROME_NAMES or (not WRAPPERS & set(words) and not {"article", "entry", "post", "content"} & set(words) and bool(CHROME_NAMES & set(words)))


def kind_of(tag: str, attributes: str, outer: int) -> int:
    """What an element holds, by its tag and attributes and by what the element around it holds."""
    if outer == CHROME:
        return ARTICLE if tag == "main" else CHROME
    if tag in CHROME_TAGS or (tag == "header" and outer == OPEN):
        return CHROME
    names: list[str] = []
    whole = tag in ("article", "main")
    inner = ARTICLE if whole else outer
    if attributes and tag not in ("html", "body"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in CHROME_ROLES):
                return CHROME
            if name == "style" and "display:none" in value.replace(" ", ""):
                return CHROME
            if (name == "role" and value == "main") or (name == "itemprop" and value == "articlebody"):
                inner = ARTICLE
            if name in ("class", "id"):
                names += value.split()
    if any(n in CHROME_NAMES if whole else chrome_name(n) for n in names) and not (outer in (CONTENT, ARTICLE) and set(names) <= {"header", "banner"}):
        return CHROME
    if inner == OPEN and CONTENT_NAMES & set(names):
        return CONTENT
    return inner


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order, character references decoded and white space folded."""
    found: list[Block] = []
    stack: list[tuple[str, int]] = []
    own: list[str] = []  # the open block's text
    aside: list[str] = []  # what is chrome within it
    kind, block, links, outside, own_kind = OPEN, "", 0, False, OPEN

    def flush() -> None:
        nonlocal outside
        for parts, of in ((own, own_kind), (aside, CHROME)):
            text = "".join(parts)
            parts.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                found.append(Block(of, block, not outside, text))
        outside = False

    def say(raw: str) -> None:
        nonlocal own_kind
        if kind == CHROME:
            aside.append(raw)
            return
        own_kind = own_kind if own else kind
        own.append(raw)

    def pop_to(at: int) -> None:
        nonlocal kind
        del stack[at:]
        kind = stack[-1][1] if stack else OPEN

    at, end = 0, len(page)
    while at < end:
        mark = MARK.search(page, at)
        stop = mark.start() if mark else end
        if stop > at:
            raw = page[at:stop]
            say(raw)
            outside = outside or (not links and not raw.isspace())
        if not mark:
            break
        at = mark.end()
        tag = mark[2] or mark[5]
        if not tag:
            continue
        tag = tag.lower()
        if (mark[1] or mark[4]) and tag != "br":  # an end tag
            if tag in BLOCKS:
                flush()
            links -= tag == "a" and links > 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag not in BLOCKS and tag not in CELLS and stack[i][0] in BLOCKS:
                    break  # a stray end tag of an inline element
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in BLOCKS:
            flush()
            block, links = tag, 0
            for i in range(len(stack) - 1, -1, -1):  # a paragraph holds no blocks
                if stack[i][0] in BLOCKS:
                    if stack[i][0] == "p":
                        pop_to(i)
                    break
        elif tag == "br" or tag in CELLS:
            say(" ")
        if tag in ENDS:
            ended, barrier = ENDS[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ended:
                    pop_to(i)
                    break
                if stack[i][0] in barrier:
                    break
        if tag not in VOID:
            links += tag == "a"
            attributes = mark[3] or mark[6] or ""
            if not attributes.endswith("/") or tag in BLOCKS:
                kind = kind_of(tag, attributes, kind)
                stack.append((tag, kind))
    flush()
    return found


def marked(blocks: list[Block]) -> bool:
    return any(b.kind == ARTICLE for b in blocks)


def repeated(blocks: list[Block], covered: np.ndarray | None) -> list[bool]:
    """Of each block whether half of its words are covered; ``covered`` is for the tokens of the blocks' stream."""
    found, at = [], 0
    for b in blocks:
        words = b.text.count(" ") + 1
        found.append(covered is not None and bool(covered[at + 1 : at + 1 + words].sum() >= COVERED * words))
        at += 1 + words
    return found


def main_text(blocks: list[Block], covered: np.ndarray | None = None) -> str:
    """The blocks of the main text, joined by empty lines.

    ``covered`` says of each token whether it is boilerplate, for the stream of the marked article, or for the page's stream if there is none.
    """
    if marked(blocks):
        article = [b for b in blocks if b.kind == ARTICLE]
        gone = repeated(article, covered)
        words = [b.text.count(" ") + 1 for b in article]
        near_copy = 2 * sum(n for n, g in zip(words, gone) if g) >= sum(words)
        return "\n\n".join(b.text for b, g in zip(article, gone) if near_copy or not g)
    within = CONTENT if any(b.kind == CONTENT for b in blocks) else OPEN
    return "\n\n".join(b.text for b, g in zip(blocks, repeated(blocks, covered)) if b.kind >= within and not b.linked and not g)


def stream_of(blocks: list[Block], article: bool = False) -> np.ndarray:
    """Tokens of 32 bits of the marked article, or of what is outside it."""
    digest = xxhash.xxh32_intdigest
    return np.array([digest(t) for b in blocks if (b.kind == ARTICLE) == article for t in (f"<{b.tag}>", *b.text.split(" "))], np.uint32)


def article_id(blocks: list[Block]) -> bytes | None:
    """16 bytes that say what the marked article's stream is; none without one."""
    digest = hashlib.blake2b(digest_size=16)
    for b in blocks:
        if b.kind == ARTICLE:
            digest.update(f"<{b.tag}> {b.text}\n".encode("utf-8", "surrogatepass"))
    return digest.digest() if marked(blocks) else None


def window_ids(tokens: np.ndarray, starts: np.ndarray, host: str, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of 64 bits for the window at each start: what it is, on this host."""
    found = []
    for seed in (1, 2):
        times = np.uint64(xxhash.xxh64_intdigest(b"times", seed) | 1)
        value = np.full(len(starts), xxhash.xxh64_intdigest(host, seed), np.uint64)
        for i in range(run):
            value = (value ^ tokens[starts + i].astype(np.uint64)) * times
            value ^= value >> np.uint64(29)
        found.append(value.view(np.int64))
    return found[0], found[1]


def hits_of(stream: np.ndarray, host: str, windows: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Where in a stream the listed windows start, and the place of each in the list."""
    ids = windows.values
    listed = {pair: i for i, pair in enumerate(zip(ids.field(0).to_pylist(), ids.field(1).to_pylist()))}
    w1, w2 = window_ids(stream, np.arange(max(len(stream) - RUN + 1, 0)), host)
    found = [(at, listed.get((int(w1[at]), int(w2[at])), -1)) for at in np.flatnonzero(np.isin(w1, ids.field(0).to_numpy()))]
    both = np.array(found, np.int64).reshape(-1, 2)
    both = both[both[:, 1] >= 0]
    return both[:, 0], both[:, 1]


def cover(n: int, starts: np.ndarray) -> np.ndarray:
    """Of ``n`` tokens whether a window that begins at one of ``starts`` holds it."""
    covered = np.zeros(n, bool)
    for i in range(RUN):
        covered[starts + i] = True
    return covered


def host_of(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), HOST, 1), F.lit("")))


def _texts(column: pa.Array) -> list[str]:
    return [(x.as_py() or b"").decode("utf-8", "replace") for x in pc.cast(column, pa.binary())]


def streams(pages: DataFrame, html: str, url: str, **kept: str) -> DataFrame:
    """host, digest (of the stream outside articles), stream, n_tokens, the same of the marked article without its stream, marked and, of pages without one, blocks; before them the columns ``kept`` (new name = old name)."""
    kind = "array<struct<kind int, tag string, linked boolean, text string>>"
    inner = pa.list_(pa.struct([("kind", pa.int32()), ("tag", pa.string()), ("linked", pa.bool_()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 0):
                rows = [blocks_of(x) for x in _texts(part.column(0))]
                raw = [stream_of(b).tobytes() for b in rows]
                columns = [
                    *part.columns[2:],
                    pa.array(_texts(part.column(1))),
                    pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in raw], pa.binary()),
                    pa.array(raw, pa.binary()),
                    pa.array([len(s) // 4 for s in raw], pa.int64()),
                    pa.array([article_id(b) for b in rows], pa.binary()),
                    pa.array([sum(2 + x.text.count(" ") for x in b if x.kind == ARTICLE) for b in rows], pa.int64()),
                    pa.array([marked(b) for b in rows], pa.bool_()),
                    pa.array([None if marked(b) else [x._asdict() for x in b] for b in rows], inner),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "host", "digest", "stream", "n_tokens", "article", "n_article", "marked", "blocks"])

    picked = pages.select(pages[html].cast("string").alias("html"), host_of(url).alias("host"), *[pages[old].alias(new) for new, old in kept.items()])
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[2:])
    return map_arrow(picked, run, f"{own}host string, digest binary, stream binary, n_tokens long, article binary, n_article long, marked boolean, blocks {kind}")


class HostArray:
    """The suffixes of a host's streams, sorted by their first ``run`` tokens.

    ``place`` are the positions of whole windows in that order, ``page`` and ``offset`` where each lies, ``first`` where intervals of equal windows
    begin and ``pages`` on how many streams each interval lies.
    """

    def __init__(self, parts: list[np.ndarray], run: int = RUN) -> None:
        sizes = np.array([len(p) for p in parts], np.int64)
        self.run, self.tokens = run, np.concatenate(parts) if len(parts) else np.empty(0, np.uint32)
        page = np.repeat(np.arange(len(parts)), sizes)
        offset = np.arange(len(page)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rank = np.unique(self.tokens, return_inverse=True)[1].astype(np.int64)
        known = 1
        while known < run:  # ranks by ``known`` tokens at a place and at a later one are ranks by more
            step = min(known, run - known)
            later = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.int64)])
            rank = np.unique(rank * (len(rank) + 1) + later, return_inverse=True)[1].astype(np.int64)
            known += step
        whole = np.flatnonzero(offset + run <= np.repeat(sizes, sizes))
        self.place = whole[np.lexsort((whole, rank[whole]))]
        self.page, self.offset, rank = page[self.place], offset[self.place], rank[self.place]
        new = np.ones(len(rank), bool)
        new[1:] = rank[1:] != rank[:-1]
        other = new.copy()
        other[1:] |= self.page[1:] != self.page[:-1]
        self.first = np.flatnonzero(new)
        self.interval = np.cumsum(new) - 1
        self.pages = np.add.reduceat(other, self.first) if len(self.first) else np.empty(0, np.int64)

    def windows(self, host: str) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers of 64 bits for each interval: what its windows are, on this host."""
        return window_ids(self.tokens, self.place[self.first], host, self.run)


FOUND = pa.schema([("sid", pa.int64()), ("starts", pa.list_(pa.int32())), ("at", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("pages", pa.int64()), ("asked", pa.bool_())])
FOUND_SQL = "sid long, starts array<int>, at int, w1 long, w2 long, pages long, asked boolean"


def _sorted_group(group: pa.Table) -> pa.Table:
    """Of each asked stream the starts of repeated windows; of hosts in several shards also every window once, with one place and its pages."""
    host, sid, asked, shards = (group.column(c).to_numpy(zero_copy_only=False) for c in ("host", "sid", "asked", "shards"))
    raw = [np.frombuffer(s.as_py(), np.uint32) for s in group.column("stream")]
    by_host = np.argsort(host, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], host[by_host][1:] != host[by_host][:-1]])).tolist() + [len(host)] if len(host) else [0]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        rows = by_host[lo:hi]
        array = HostArray([raw[r] for r in rows])
        repeated = (array.pages >= PAGES)[array.interval] & asked[rows][array.page].astype(bool)
        page, start = array.page[repeated], array.offset[repeated]
        order = np.lexsort((start, page))
        page, start = page[order], start[order]
        at = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]])) if len(page) else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array([*at.tolist(), len(page)], pa.int32()), pa.array(start, pa.int32()))
        none = lambda kind, n: pa.nulls(n, kind)
        n = len(at)
        out.append(pa.table([pa.array(sid[rows][page[at]], pa.int64()), lists, none(pa.int32(), n), none(pa.int64(), n), none(pa.int64(), n), none(pa.int64(), n), none(pa.bool_(), n)], schema=FOUND))
        if shards[rows[0]] > 1 and len(array.first):
            w1, w2 = array.windows(host[rows[0]])
            begins = np.zeros(len(array.place), bool)
            begins[array.first] = True
            # every place of a window that is on one page; of others one place, which stands for all pages
            where = np.flatnonzero(begins | (array.pages < PAGES)[array.interval])
            which, n = array.interval[where], len(where)
            mine = asked[rows][array.page[where]].astype(bool) & (array.pages[which] < PAGES)
            counted = np.where(begins[where], array.pages[which], 0)
            out.append(pa.table([pa.array(sid[rows][array.page[where]], pa.int64()), none(pa.list_(pa.int32()), n), pa.array(array.offset[where], pa.int32()), pa.array(w1[which]), pa.array(w2[which]), pa.array(counted, pa.int64()), pa.array(mine)], schema=FOUND))
    return pa.concat_tables(out) if out else FOUND.empty_table()


def repeats(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """(sid, start) of the windows of asked streams that are on several of a host's streams; ``distinct`` has host, sid, stream, n_tokens and asked, a row for each stream."""
    ship(distinct.sparkSession)
    hosts = materialize(distinct.groupBy("host").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).withColumn("shards", F.floor(F.col("n") / shard) + 1))
    tokens, total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    dealt = hot_join(distinct, hosts.select("host", "shards", "rows"), "host", "rows", total)
    alone = F.xxhash64(F.lit("shard"), "host", F.pmod(F.xxhash64("sid"), F.col("shards")))
    group = F.when(F.col("shards") > 1, alone).otherwise(F.pmod(F.xxhash64("host"), F.lit(tokens // shard + 1)))
    found = materialize(dealt.withColumn("group", group).groupBy("group").applyInArrow(lambda t: _sorted_group(t), FOUND_SQL))
    inside = found.where("starts IS NOT NULL").select("sid", F.explode("starts").alias("start"))
    windows = found.where("starts IS NULL")
    # a window that is on one page of its shard may be on pages of others: at most a row from each shard
    several = windows.groupBy("w1", "w2").agg(F.sum("pages").alias("all_pages")).where(F.col("all_pages") >= PAGES).select("w1", "w2")
    across = windows.where("asked").join(several.hint("merge"), ["w1", "w2"], "left_semi").select("sid", F.col("at").alias("start"))
    return inside.unionByName(across)


SHARED = pa.schema([("host", pa.string()), ("w1", pa.int64()), ("w2", pa.int64()), ("whole", pa.bool_())])
SHARED_SQL = "host string, w1 long, w2 long, whole boolean"


def _shared_in_group(group: pa.Table) -> pa.Table:
    """The windows on over ``MOST`` of the articles that the group has of a host, and whether these are the host's whole articles."""
    host, many = group.column("host").to_pylist(), group.column("shards").is_valid().to_pylist()
    of: dict[str, list[int]] = {}
    for i, h in enumerate(host):
        of.setdefault(h, []).append(i)
    out = []
    for h, rows in of.items():
        several = many[rows[0]]
        if not several and len(rows) < LEAST:
            continue
        array = HostArray([np.frombuffer(group.column("stream")[r].as_py(), np.uint32) for r in rows])
        most = array.pages > MOST * len(rows)
        if most.any():
            w1, w2 = (w[most] for w in array.windows(h))
            out.append(pa.table([pa.array([h] * len(w1)), pa.array(w1), pa.array(w2), pa.array([not several] * len(w1))], schema=SHARED))
    return pa.concat_tables(out) if out else SHARED.empty_table()


def beside(texts: DataFrame, book: DataFrame, how: str) -> DataFrame:
    """``texts`` with the windows of their host; a book of up to ``BOOK`` windows is broadcast, so that the pages stay where they are."""
    size = book.agg(F.coalesce(F.sum(F.size("windows")), F.lit(0))).first()[0]
    return texts.join(F.broadcast(book) if size <= BOOK else book.hint("merge"), "host", how)


def shared_by_most(texts: DataFrame, sizes: DataFrame, shard: int = SHARD) -> DataFrame:
    """(host, windows): what over ``MOST`` of a host's distinct marked articles hold, for hosts with ``LEAST`` of them.

    ``texts`` has html and host; ``sizes`` has host, article and n_article of the same pages. A host lists under 2 windows for each token of
    its mean article. Streams are shuffled once, to their arrays.
    """
    each = sizes.where("article IS NOT NULL").groupBy("host", "article").agg(F.first("n_article").alias("n"))
    hosts = each.groupBy("host").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("articles"))
    hosts = materialize(hosts.withColumn("shards", F.least(F.floor(F.col("n") / shard), F.floor(F.col("articles") / SPREAD)) + 1))
    tokens = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bytes]] = set()  # of a task
        for batch in batches:
            for part in byte_slices(batch, 0):
                out = []
                for page, host in zip(_texts(part.column(0)), part.column(1).to_pylist()):
                    blocks = blocks_of(page)
                    article = article_id(blocks)
                    if article is not None and (host, article) not in seen:
                        seen.add((host, article))
                        out.append((host, article, stream_of(blocks, True).tobytes()))
                columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["host", "article", "stream"])

    words = map_arrow(texts.select("html", "host"), run, "host string, article binary, stream binary")
    # hosts of several shards have over ``shard`` tokens each, so there are few
    dealt = words.join(F.broadcast(hosts.where("shards > 1").select("host", "shards")), "host", "left")
    alone = F.xxhash64(F.lit("shard"), "host", F.pmod(F.xxhash64("article"), F.col("shards")))
    group = F.when(F.col("shards").isNotNull(), alone).otherwise(F.pmod(F.xxhash64("host"), F.lit(tokens // shard + 1)))
    distinct = dealt.withColumn("group", group).repartition("group").groupBy("group", "host", "article").agg(F.first("stream").alias("stream"), F.first("shards").alias("shards"))
    found = materialize(distinct.groupBy("group").applyInArrow(lambda t: _shared_in_group(t), SHARED_SQL))
    window = F.struct("w1", "w2").alias("window")
    certain, likely = found.where("whole").select("host", window), found.where("NOT whole").select("host", window)
    if not likely.isEmpty():
        likely = materialize(likely.groupBy("host").agg(F.collect_set("window").alias("windows")))
        certain = certain.unionByName(_counted(texts, likely, hosts))
    return materialize(certain.groupBy("host").agg(F.collect_list("window").alias("windows")))


def _counted(texts: DataFrame, likely: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, window) of the likely windows that are on over ``MOST`` of all the host's articles: each is counted in every one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 0):
                out = []
                for page, host, windows in zip(_texts(part.column(0)), part.column(1).to_pylist(), part.column(2)):
                    blocks = blocks_of(page)
                    if marked(blocks):
                        out.append((host, article_id(blocks), np.unique(hits_of(stream_of(blocks, True), host, windows)[1]).tolist()))
                columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.string(), pa.binary(), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, names=["host", "article", "hits"])

    asked = beside(texts.select("html", "host"), likely, "inner").select("html", "host", "windows")
    hits = map_arrow(asked, run, "host string, article binary, hits array<int>").groupBy("host", "article").agg(F.first("hits").alias("hits"))
    counts = hits.select("host", F.explode("hits").alias("hit")).groupBy("host", "hit").agg(F.count(F.lit(1)).alias("pages"))
    listed = likely.select("host", F.posexplode("windows").alias("hit", "window"))
    most = counts.join(hosts.select("host", "articles"), "host").where(F.col("pages") > F.lit(MOST) * F.col("articles"))
    return listed.join(most, ["host", "hit"], "left_semi").select("host", "window")


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", shard: int = SHARD) -> DataFrame:
    """(key, url, text, n_chars) of every row: its main text, empty if there is none.

    Null and empty pages give an empty text; pages whose url is null or has no host count as one host. Whole pages are read, however long and however
    broken: what is not closed ends with what is around it. Rows that repeat are answered each, and are one page to the suffix
    arrays, so that a copy makes nothing boilerplate. Other columns play no part; an empty table gives none.
    """
    names = {"key": key, "address": url}
    parsed = materialize(streams(pages, html, url, **names))
    distinct = parsed.where("n_tokens > 0").groupBy("host", "digest").agg(F.first("stream").alias("stream"), F.first("n_tokens").alias("n_tokens"), F.bool_or(~F.col("marked")).alias("asked"))
    distinct = materialize(distinct.withColumn("sid", F.monotonically_increasing_id()))
    starts = repeats(distinct, shard).groupBy("sid").agg(F.collect_set("start").alias("starts"))  # no more than the stream's tokens
    where = distinct.where("asked").join(starts.hint("merge"), "sid").select(F.col("host").alias("h"), F.col("digest").alias("d"), "starts")
    bare = parsed.where("NOT marked").select("key", "address", "host", "digest", "n_tokens", "blocks")
    bare = bare.join(where.hint("merge"), (F.col("host") == F.col("h")) & (F.col("digest") == F.col("d")), "left").select("key", "address", "n_tokens", "blocks", "starts")
    texts = pages.select(pages[html].cast("string").alias("html"), host_of(url).alias("host"), pages[key].alias("key"), pages[url].alias("address"))
    shared = shared_by_most(texts, parsed.select("host", "article", "n_article"), shard)

    def uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, blocks, found in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), strict=True):
                out.append(main_text([Block(**b) for b in blocks.as_py() or []], cover(n, np.array(found or [], np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["key", "address", "text"])

    def articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 0):
                out = []
                for page, host, windows in zip(_texts(part.column(0)), part.column(1).to_pylist(), part.column(4)):
                    blocks, covered = blocks_of(page), None
                    if windows.is_valid and marked(blocks):
                        stream = stream_of(blocks, True)
                        covered = cover(len(stream), hits_of(stream, host, windows)[0])
                    out.append(main_text(blocks, covered) if marked(blocks) else None)
                text = pa.array(out, pa.string())
                whole = pa.RecordBatch.from_arrays([part.column(2), part.column(3), text], names=["key", "address", "text"])
                yield whole.filter(text.is_valid())

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.schema.fields[2:]) + "text string"
    marked_pages = beside(texts, shared, "left").select("html", "host", "key", "address", "windows")
    out = map_arrow(marked_pages, articles, schema).unionByName(map_arrow(bare, uncovered, schema))
    return out.select(F.col("key").alias(key), F.col("address").alias(url), "text", F.length("text").cast("long").alias("n_chars"))


def op13_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op13_html_main_text": op13_html_main_text}
