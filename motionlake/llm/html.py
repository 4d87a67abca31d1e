"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a row of text blocks with features of their text and of the elements around them. A logistic
classifier prices each block as content or boilerplate: the two prices are its terminal capacities. It is trained on
blocks whose elements say what they are (an article against navigation, footers, adverts and the like) and, where
elements say nothing, on places of a host's template: texts that change from page to page in the element that holds
most of them are content, texts that repeat there or change elsewhere are not.
Where elements speak they decide alone, so that no cell, caption or label of an article is lost for being short.
Neighbouring blocks and blocks of one parent are tied by smoothness edges, and the minimum cut between the two
terminals labels all blocks of the page at once.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from motionlake.llm.chunks import blocks as text_blocks
from motionlake.llm.common import bounded_sample, in_arrow

#: What follows the name of a tag, quotes closed, and the same where a quote of the page never closes.
_REST = re.compile(r"([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>")
_NAME = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*)")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Fixed values of HTML: elements without content, with raw content, and such as begin a new block of text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe object canvas select option".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Opening block tags and the open elements that they end.
_CLOSES = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")} | dict.fromkeys(
    "p div article section ul ol table h1 h2 h3 h4 h5 h6 nav footer aside header form blockquote pre".split(), ("p",)
)
_BAD_ELEMENTS = frozenset("nav footer aside form menu dialog".split())
#: Boilerplate outside articles only.
_BAD_OUTSIDE = frozenset("header button label fieldset legend".split())
#: Words in class, id and role that mark boilerplate, and such as mark content.
_BAD_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side widget related "
    "recommended share sharing social comment comments reply replies respond disqus discussion breadcrumb breadcrumbs menu nav navbar navigation footer foot header masthead topbar toolbar "
    "newsletter subscribe subscription signup login search pagination pager skip tags legal copyright disclaimer paywall contentinfo complementary toc".split()
)
_GOOD_WORDS = frozenset("article content post entry story main body text prose markdown".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v   -     　]+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    parent: int  # number of the element around it
    tag: str
    bad: bool  # inside an element that says it is boilerplate
    good: bool  # inside an article or main element, and not bad
    worded: bool  # inside an element whose class or id speaks of content
    hidden: bool
    above: tuple[int, ...]  # places of the element around it and the two around that: hashes of tags and classes from the root


class _Element:
    __slots__ = ("above", "bad", "good", "hidden", "link", "number", "tag", "worded")

    def __init__(self, tag: str, number: int, up: _Element | None, attributes: str):
        words: set[str] = set()
        self.hidden = up.hidden if up else False
        if attributes.strip():
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id", "role"):
                    words.update(x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if x)
                elif (name == "style" and _HIDDEN.search(value)) or name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                    self.hidden = True
        self.tag, self.number = tag, number
        around = up.above if up else ()
        self.above = (zlib.crc32(f"{tag} {' '.join(sorted(words))}".encode(), around[0] if around else 0), *around[:2])
        up_good = up.good if up else False
        self.good = up_good or tag in ("article", "main")
        bad = tag in _BAD_ELEMENTS or (tag in _BAD_OUTSIDE and not up_good) or (tag not in ("html", "body", "article", "main") and bool(words & _BAD_WORDS) and not (tag in ("h1", "header") and up_good))
        self.bad = bad or (up.bad if up else False)
        self.worded = bool(words & _GOOD_WORDS) or (up.worded if up else False)
        self.link = tag == "a" or (up.link if up else False)


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name, rest, end) of each piece of a page in order: text, open, close; end is where it ends.

    Each character is looked at a bounded number of times: where a search for a closing mark has failed once, it
    would fail again for every later one, and is not repeated. The caller may send a place to go on from.
    """
    at, quotes, data = 0, True, True
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            yield "text", "", page[at:], len(page)
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
            kind, name, rest = "skip", "", ""
        elif data and page.startswith("<![CDATA[", start) and (end := page.find("]]>", start + 9)) >= 0:
            kind, name, rest, end = "data", "", page[start + 9 : end], end + 3
        elif page.startswith(("<!", "<?"), start):
            data = data and not page.startswith("<![CDATA[", start)
            end = page.find(">", start)
            end = len(page) if end < 0 else end + 1
            kind, name, rest = "skip", "", ""
        elif m := _NAME.match(page, start + 1):
            whole = _REST.match(page, m.end()) if quotes else None
            if whole:
                rest, end = whole[1], whole.end()
            else:
                quotes, end = False, page.find(">", m.end())
                if end < 0:  # no tag ends any more
                    yield "text", "", page[at:], len(page)
                    return
                rest, end = page[m.end() : end], end + 1
            kind, name = ("close" if m[1] else "open"), m[2].lower()
        else:  # a lone mark
            yield "text", "", page[at : start + 1], start + 1
            at = start + 1
            continue
        if start > at:
            yield "text", "", page[at:start], start
        at = (yield kind, name, rest, end) or end


class _Stack:
    """Open elements. Blocks are found without passing the inline elements above them, and inline elements are only
    looked for where one is open, so that each is passed once, when it is closed."""

    def __init__(self) -> None:
        self.all = [_Element("html", 0, None, "")]
        self.at = [0]  # where the blocks stand
        self.counts: dict[str, int] = {}  # open blocks by tag
        self.inline: list[dict[str, int]] = [{}]  # open inline elements above each block, by tag

    def top(self) -> _Element:
        return self.all[-1]

    def block(self) -> _Element:
        return self.all[self.at[-1]]

    def push(self, e: _Element) -> None:
        self.all.append(e)
        if e.tag in _BLOCK:
            self.at.append(len(self.all) - 1)
            self.counts[e.tag] = self.counts.get(e.tag, 0) + 1
            self.inline.append({})
        else:
            self.inline[-1][e.tag] = self.inline[-1].get(e.tag, 0) + 1

    def pop_block(self) -> str:
        """Close the innermost block and all that is in it."""
        tag = self.block().tag
        del self.all[self.at.pop() :]
        self.inline.pop()
        self.counts[tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """A closing inline tag never closes a block around it; a stray one closes nothing."""
        if tag in _BLOCK:
            if self.counts.get(tag):
                while self.pop_block() != tag:
                    pass
        elif self.inline[-1].get(tag):
            while (gone := self.all.pop().tag) != tag:
                self.inline[-1][gone] -= 1
            self.inline[-1][tag] -= 1

    def make_room(self, tag: str) -> None:
        """Close what an opening block tag ends: a paragraph, list item, cell or row before it."""
        closes = _CLOSES.get(tag, ())
        while closes and len(self.at) > 1:
            own = self.block().tag
            if own in closes:
                self.pop_block()
                if not (tag == "tr" and own in ("td", "th")):
                    break
            else:
                break


def parse(page: str | None) -> list[Block]:
    """The text blocks of a page in order. Unclosed and stray tags are taken as browsers mostly take them. Time grows
    with the length of the page."""
    if not page:
        return []
    stack, count, out = _Stack(), 0, []
    parts: list[str] = []
    linked = 0
    owner = stack.top()  # the element in which the running block began

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip(" ")
            if text:
                e = owner if owner.tag in _BLOCK else stack.block()
                bad = e.bad or owner.bad
                out.append(Block(text, linked, e.number, e.tag, bad, e.good and not bad, e.worded, e.hidden or owner.hidden, e.above))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, owner
        if text:
            if not parts:
                owner = stack.top()
            parts.append(text)
            if stack.top().link:
                linked += len(text.strip())

    found, go_on = tokens(page), None
    while True:
        try:
            kind, tag, rest, at = found.send(go_on)
        except StopIteration:
            break
        go_on = None
        if kind == "text":
            add(rest)
        elif kind == "data":
            add(entities.escape(rest))
        elif kind == "close":
            if tag in _BLOCK:
                flush()
            stack.close(tag)
        elif kind == "open" and tag in _RAW and not rest.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
            go_on = end.end() if end else len(page)
        elif kind == "open":
            if tag in ("br", "text"):  # a line, and a label in a drawing
                add(" ")
            if tag in _BLOCK:
                flush()
                stack.make_room(tag)
            if tag not in _VOID and not rest.endswith("/"):
                count += 1
                stack.push(_Element(tag, count, stack.top(), rest))
    flush()
    return out


N_FEATURES = 16
N_TEXT = 12  # the bias and features of text and tag; what elements say follows


def features(found: list[Block]) -> np.ndarray:
    """A row for each block. Where elements say what a block is, features of its text are zero."""
    rows = text_features(found)
    for i, b in enumerate(found):
        if b.bad or b.good:
            rows[i, 1:N_TEXT] = 0
        rows[i, N_TEXT:] = (b.bad * 4.0, b.good * 4.0, b.worded * 2.0, b.hidden * 4.0)
    return rows


def text_features(found: list[Block]) -> np.ndarray:
    """The same without what elements say."""
    rows = np.zeros((len(found), N_FEATURES))
    for i, b in enumerate(found):
        size = len(b.text)
        words = b.text.count(" ") + 1
        rows[i, :N_TEXT] = (
            1.0,
            min(np.log1p(size), 8.0) / 4,
            min(words, 100) / 50,
            min(b.linked / size, 1.0),
            float(b.text[-1] in ".!?:\"'”»…)"),
            min(b.text.count(",") / words, 0.3) * 3,
            float(b.tag in ("p", "blockquote", "pre")),
            float(b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
            float(b.tag in ("li", "td", "th", "dd", "dt")),
            float("©" in b.text or "·" in b.text),
            float(i == 0),
            float(i == len(found) - 1),
        )
    return rows


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def minimum_cut(content: np.ndarray, boilerplate: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels (True: content) of least total price: a block pays `boilerplate` if it is content and `content` if not,
    and an edge pays its weight if its ends differ. Maximum flow by layers of shortest paths; the source side is content."""
    n = len(content)
    common = np.minimum(content, boilerplate)
    supply, drain = (content - common).tolist(), (boilerplate - common).tolist()
    ties: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        ties[a][b] = ties[a].get(b, 0.0) + w
        ties[b][a] = ties[b].get(a, 0.0) + w
    tiny = 1e-9
    while True:  # layers of shortest paths, then as much flow as they take
        depth = [0 if x > tiny else -1 for x in supply]
        queue = deque(i for i in range(n) if depth[i] == 0)
        ends = False
        while queue:
            v = queue.popleft()
            ends = ends or drain[v] > tiny
            for u, room in ties[v].items():
                if room > tiny and depth[u] < 0:
                    depth[u] = depth[v] + 1
                    queue.append(u)
        if not ends:
            break
        ways = [list(t) for t in ties]  # what is left to try; a way that failed is not tried again
        for start in range(n):
            path = [start]
            while supply[start] > tiny and path:
                v = path[-1]
                if drain[v] > tiny:
                    flow = min([supply[start], drain[v], *(ties[a][b] for a, b in zip(path, path[1:], strict=False))])
                    supply[start] -= flow
                    drain[v] -= flow
                    for a, b in zip(path, path[1:], strict=False):
                        ties[a][b] -= flow
                        ties[b][a] += flow
                    path = [start]
                    continue
                while ways[v]:
                    u = ways[v][-1]
                    if ties[v][u] > tiny and depth[u] == depth[v] + 1:
                        path.append(u)
                        break
                    ways[v].pop()
                else:
                    path.pop()
                    if path:
                        ways[path[-1]].pop()
    label = np.zeros(n, bool)
    queue = deque(i for i in range(n) if supply[i] > tiny)
    label[list(queue)] = True
    while queue:
        v = queue.popleft()
        for u, room in ties[v].items():
            if room > tiny and not label[u]:
                label[u] = True
                queue.append(u)
    return label


def main_blocks(found: list[Block], weights: np.ndarray, smooth: float = 0.4) -> list[Block]:
    if not found:
        return []
    margin = np.clip(features(found) @ weights, -20, 20)
    if (margin > 0).all() or (margin <= 0).all():  # no edge can be cut
        return found if margin[0] > 0 else []
    edges = [(i, i + 1, smooth if found[i].parent != found[i + 1].parent else 1.5 * smooth) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if b.parent in last and last[b.parent] < i - 1:
            edges.append((last[b.parent], i, 0.5 * smooth))
        last[b.parent] = i
    label = minimum_cut(np.maximum(margin, 0), np.maximum(-margin, 0), edges)
    return [b for b, keep in zip(found, label, strict=True) if keep]


def extract_text(page: str | None, weights: np.ndarray) -> str:
    return "\n\n".join(b.text for b in main_blocks(parse(page), weights))


def host_sample(pages: DataFrame, hosts: int, per_host: int) -> DataFrame:
    """About `per_host` pages each of at most `hosts` hosts that have three or more, both chosen by hashes. Pages are
    counted by host over the whole table; only the counts of the chosen hosts reach the driver."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    named = pages.select("page_id", "html", host.alias("host"))
    counts = named.where("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").orderBy(F.xxhash64("host"), "host").limit(hosts).collect()
    if not counts:
        return named.limit(0)
    step = F.create_map(*[F.lit(x) for r in counts for x in (r.host, -(-r.n // per_host))])[F.col("host")]
    return named.where(F.col("host").isin([r.host for r in counts]) & (F.pmod(F.xxhash64(F.col("page_id").cast("string"), F.lit("host")), step) == 0)).limit(hosts * per_host)


def _blocks_of(sample: DataFrame, most: int) -> list[Row]:
    """At most `most` blocks of a sample of pages (page_id, html, host) with what `train` needs of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in kinds]
            for page, html_, host in zip(*(batch.column(c).to_pylist() for c in ("page_id", "html", "host")), strict=True):
                found = parse(html_)
                rows[0] += features(found).tolist()
                rows[1] += text_features(found).tolist()
                rows[2] += [False if b.bad else True if b.good else None for b in found]
                rows[3] += [xxhash.xxh3_64_intdigest(b.text.encode("utf-8", "surrogatepass")) >> 1 for b in found]
                rows[4] += [max(len(b.text) - b.linked, 0) for b in found]
                rows[5] += [list(b.above) for b in found]
                rows[6] += [str(page)] * len(found)
                rows[7] += [host] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=names)

    names = ["x", "plain", "y", "text", "size", "above", "page", "host"]
    kinds = [pa.list_(pa.float64()), pa.list_(pa.float64()), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string()]
    return in_arrow(sample.select("page_id", "html", "host"), run, "x array<double>, plain array<double>, y boolean, text long, size long, above array<long>, page string, host string").limit(most).collect()


def template_labels(found: list[Row]) -> list[bool | None]:
    """What places of templates say of blocks whose elements say nothing (y is null); None for all others.

    A place, an element with its tags and classes from the root, changes if three pages or more of the host hold it and
    more than half of its texts differ; else it repeats. The body of a host is the element around the places that change
    and hold most text outside links. What changes there is content; what repeats, or changes elsewhere, is boilerplate.
    """
    places: dict[tuple, tuple[set, list, set]] = {}
    for r in found:
        pages, n, texts = places.setdefault((r.host, r.above[0]), (set(), [], set()))
        pages.add(r.page)
        n.append(1)
        texts.add(r.text)
    changes = {k: 2 * len(texts) > len(n) for k, (pages, n, texts) in places.items() if len(pages) >= 3}
    sizes: dict[str, dict[int, int]] = {}
    for r in found:
        if r.y is not False and changes.get((r.host, r.above[0])):
            around = sizes.setdefault(r.host, {})
            around[r.above[-1 if len(r.above) < 2 else 1]] = around.get(r.above[-1 if len(r.above) < 2 else 1], 0) + r.size
    body = {host: max(around, key=lambda k: (around[k], k)) for host, around in sizes.items()}
    return [None if r.y is not None or (r.host, r.above[0]) not in changes else changes[r.host, r.above[0]] and body.get(r.host) in r.above for r in found]


def train(pages: DataFrame, sample_rows: int = 400, most: int = 20_000, hosts: int = 40, per_host: int = 10) -> np.ndarray:
    """Weights from blocks of two bounded samples, `most` blocks of each at most: `sample_rows` pages chosen by a hash of
    the id, and about `per_host` pages of `hosts` hosts.

    In the first, boilerplate is what stands in an element that says so, and content what stands in articles and main
    elements. (Articles have copies, too: what repeats in them is content all the same.) In the second, blocks whose
    elements say nothing are labelled by the host's template (`template_labels`). Each block counts as it is and without
    what its elements say, so that text features learn too. Without blocks of both kinds fixed weights decide.
    """
    said = [(r.x, r.plain, r.y) for r in _blocks_of(bounded_sample(pages.select("page_id", "html", F.lit(None).cast("string").alias("host")), "page_id", sample_rows), most) if r.y is not None]
    placed = _blocks_of(host_sample(pages, hosts, per_host), most)
    found = said + [(r.x, r.plain, y) for r, y in zip(placed, template_labels(placed), strict=True) if y is not None]
    y = np.array([r[2] for r in found], float)
    if not 0 < y.sum() < len(y):
        weights = np.zeros(N_FEATURES)
        weights[[0, 2, 3, 12, 13, 15]] = (-0.5, 1.0, -3.0, -3.0, 1.5, -3.0)
        return weights
    x, plain = np.array([r[0] for r in found]), np.array([r[1] for r in found])
    return fit(np.vstack([x, x, plain]), np.concatenate([y, y, y]))


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """page_id, url, text, n_chars of each row; a page that is null, empty or without content has an empty text. Rows
    that repeat come out as often as they stand; other columns are left out; an empty table gives an empty result. Pages are
    parsed whole, one at a time, in time that grows with their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_blocks(batch, "html"):
                texts = [extract_text(x, weights) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return in_arrow(pages.select("page_id", "url", "html"), run, f"{kinds}, text string, n_chars long")
