"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text that stands in them outside links, and the page votes for the
generalised path (tags and classes without numbers, from the root) of its best ones. Votes are added up for
each host in Spark, and each page is extracted again by the best-voted of its host's paths that it has.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow, stage, text_pieces

_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
#: What stands between a tag's name and its end. Possessive: nothing is given back, so a failure costs one pass.
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)")
#: Tags whose quotes never close, after which quotes no longer matter in a page.
BROKEN = 16
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_WORD = re.compile(r"[a-z]+")
_NUMBERS = re.compile(r"[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "svg", "math", "noframes", "select", "button", "canvas", "object", "audio", "video")}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr del".split())
#: Elements that are never part of an article.
BOILER = frozenset("nav footer aside form header menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of classes and ids that mark what surrounds an article.
MARKS = frozenset("ad ads adv advert advertisement adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice overlay pagination pager popup promo promotion recommended related reply respond share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget widgets".split())
KEEP = frozenset("html body main article".split())
_P_ENDS = frozenset("address article aside blockquote center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr tbody thead ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BARRIER = frozenset("ul ol dl table div section article main body td th blockquote".split())


class Node:
    """An element. part: its tag and classes without numbers; key: a hash of the parts from the root to it, the identity of its path."""

    __slots__ = ("tag", "part", "key", "parent", "sure", "marked", "order", "text", "links", "paragraphs")

    def __init__(self, tag, part, parent, sure, marked, order):
        self.tag, self.part, self.parent, self.sure, self.marked, self.order = tag, part, parent, sure, marked, order
        self.key = hashlib.blake2b(parent.key + part.encode("utf-8", "surrogatepass"), digest_size=16).digest() if parent is not None else b""
        self.text = self.links = 0
        self.paragraphs = 0.0

    @property
    def path(self) -> str:
        own, node = [], self
        while node.parent is not None:
            own.append(node.part)
            node = node.parent
        return "".join("/" + x for x in reversed(own))


class _Open:
    """The open elements, with the places of each tag, of blocks and of barriers, so that none is searched for."""

    def __init__(self, root: Node):
        self.tags, self.nodes = [""], [root]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]  # places of elements that are neither inline nor paragraphs
        self.barriers: list[int] = [0]  # those of _BARRIER but cells

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else 0

    def push(self, tag: str, node: Node) -> None:
        k = len(self.tags)
        self.tags.append(tag)
        self.nodes.append(node)
        self.at.setdefault(tag, []).append(k)
        if tag not in INLINE and tag != "p":
            self.blocks.append(k)
        if tag in _BARRIER and tag not in ("td", "th"):
            self.barriers.append(k)

    def cut(self, k: int) -> None:
        """Closes the elements from place k on."""
        while len(self.tags) > k:
            tag, place = self.tags.pop(), len(self.tags)
            self.nodes.pop()
            if tag:
                self.at[tag].pop()
            for places in (self.blocks, self.barriers):
                if places[-1] == place:
                    places.pop()

    def drop(self, tag: str) -> None:
        """Ends the last inline element of a tag, but not what has been opened in it since."""
        if k := self.last(tag):
            self.at[tag].pop()
            self.tags[k] = ""


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _tokens(html: str):
    """(text, tag, closing, attributes) in order: the text before each tag, and the tag; the rest of the text comes with no tag.

    Time is in proportion to the page, whatever it holds: what follows the last ">" is text, a tag ends at its first
    ">" outside quotes, or, where its quotes never close, at its first ">".
    """
    at, scan, last, broken = 0, 0, html.rfind(">"), 0
    unclosed: set[str] = set()
    while last >= 0 and (lt := html.find("<", scan, last)) >= 0:
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            yield html[at:lt], "", False, ""
            at = scan = len(html) if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            yield html[at:lt], "", False, ""
            at = scan = html.index(">", lt) + 1
            continue
        name = _NAME.match(html, lt + 1, last + 1)
        if not name:
            scan = lt + 1
            continue
        raw = _QUOTED.match(html, name.end(), last + 1) if broken < BROKEN else None
        broken += raw is None
        end = raw.end() if raw else html.index(">", name.end())
        tag, closing = name[0].lower(), name[0][0] == "/"
        yield html[at:lt], tag[1:] if closing else tag, closing, html[name.end() : end]
        at = scan = end + 1
        if tag in RAW and html[end - 1] != "/":
            close = None if tag in unclosed else RAW[tag].search(html, at, last + 1)
            if close:
                at = scan = close.end()
            else:
                unclosed.add(tag)
                if tag in ("script", "style", "textarea", "title"):
                    return
    rest = html.find("<!--", at)  # a comment that nothing ends
    yield html[at:rest] if rest >= 0 else html[at:], "", False, ""


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str, bool]]]:
    """The block elements of a page, and its text runs in order: (element, text, in a link). A break between blocks is a run with a changed element or an empty text."""
    nodes = [Node("", "", None, False, False, 0)]
    runs: list[tuple[Node, str, bool]] = []
    live = _Open(nodes[0])
    for piece, tag, closing, raw in _tokens(html):
        if piece:
            runs.append((live.top, unescape(piece) if "&" in piece else piece, bool(live.at.get("a"))))
        if not tag:
            continue
        if closing:
            k = live.last(tag)
            if not k:
                if tag in ("p", "br"):
                    runs.append((live.top, "", False))
            elif tag not in INLINE:
                live.cut(k)
                runs.append((live.top, "", False))
            elif k > live.blocks[-1]:
                live.cut(k)
            continue
        if tag in RAW and not raw.endswith("/"):
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                runs.append((live.top, "", False))
            continue
        if tag in INLINE:
            if not raw.endswith("/"):
                if tag == "a":
                    live.drop("a")  # a link ends where the next begins
                live.push(tag, live.top)
            continue
        if tag in _P_ENDS and (k := live.last("p")) > live.blocks[-1]:
            live.cut(k)
        if tag in _CLOSES:
            cells = 0 if tag in ("td", "th", "tr") else max(live.last("td"), live.last("th"))
            while (k := max(map(live.last, _CLOSES[tag]))) > max(live.barriers[-1], cells):
                live.cut(k)
                if tag != "tr":
                    break
        own = _attributes(raw) if raw.strip() else {}
        classes = own.get("class", "").lower().split()
        parent = live.top
        words = {w for x in [*classes, own.get("id", "").lower()] for w in _WORD.findall(x)}
        hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").lower().replace(" ", "")
        sure = parent.sure or (tag not in KEEP and (tag in BOILER or hidden or own.get("role", "").lower() in ROLES))
        marked = tag not in KEEP and bool(words & MARKS)
        general = ".".join([tag, *sorted(_NUMBERS.sub("#", c) for c in classes)])
        node = Node(tag, general, parent, sure, marked, len(nodes))
        nodes.append(node)
        live.push(tag, node)
        runs.append((node, "", False))
    return nodes, runs


def _measure(nodes: list[Node], runs) -> int:
    """Fills in each element's characters (all below it), those in links, and its paragraphs' score; gives all characters that may count.

    An element that only its class or id marks counts as surroundings unless most of the page's text stands in it.
    """
    for node, text, linked in runs:
        n = len(text) - text.count(" ") if text and not text.isspace() else 0
        if n:
            node.text += n
            node.links += n * linked
    for node in nodes:
        if not node.sure and node.text:
            own = node.text - node.links
            node.paragraphs += 0 if own <= 0 else own
    for node in reversed(nodes[1:]):
        if node.sure:
            node.text = node.links = 0
        node.parent.text += node.text
        node.parent.links += node.links
    total = nodes[0].text
    for node in nodes[1:]:
        if node.marked and 2 * node.text < total:
            node.sure = True
        elif node.parent.sure:
            node.sure = True
    return total


_PARAGRAPHS = frozenset("p li blockquote pre h1 h2 h3 h4 h5 h6 td dd dt tr".split())
_LISTS = frozenset("ul ol tr tbody table figure".split())


def containers(nodes: list[Node], runs) -> list[tuple[float, Node]]:
    """Scored candidates, best first: text in an element's own blocks counts fully for it, its parent and, by half each step, those above.

    What an element hands on to its parent is added up from the leaves to the root, so the nesting's depth costs nothing.
    """
    _measure(nodes, runs)
    score, handed = [0.0] * len(nodes), [0.0] * len(nodes)
    for node in reversed(nodes[1:]):
        own, below = 0.0 if node.sure else node.paragraphs, handed[node.order]
        score[node.order] = own * (0.5 if node.tag in _PARAGRAPHS else 1.0) + below
        step = 1.0 if node.tag in _LISTS else 0.5
        handed[node.parent.order] += own * (1.0 if node.tag in _PARAGRAPHS or node.tag in ("ul", "ol", "figcaption") else step) + below * step
    out = []
    for node in nodes[1:]:
        value = score[node.order]
        if value > 0:
            if node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "html"):
                value *= 0.2
            out.append((value * (1.5 if node.tag in ("article", "main") else 1.0) * (1 - node.links / max(1, node.text)), node))
    return sorted(out, key=lambda x: (-x[0], x[1].order))


def widened(node: Node) -> Node:
    """The article that an element stands in, or the main part of its page, else the element: title, lead and later blocks beside it belong to it."""
    up, out = node, node
    while up is not None:
        if up.tag == "article":
            return up
        if up.tag == "main" and out is node:
            out = up
        up = up.parent
    return out


def text_of(nodes: list[Node], runs, inside) -> str:
    """The text in elements that `inside` accepts: white space within a block is one space, and so is what stands between blocks."""
    accepted = [False] * len(nodes)
    for node in nodes:
        accepted[node.order] = not node.sure and (inside(node) or (node.parent is not None and accepted[node.parent.order]))
    blocks, own, last = [], [], None
    for node, text, _ in runs:
        if not accepted[node.order]:
            continue
        if node is not last or not text:
            if own:
                blocks.append("".join(own))
            own, last = [], node
        own.append(text)
    if own:
        blocks.append("".join(own))
    return " ".join(" ".join(b.split()) for b in blocks if b and not b.isspace())


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def votes_of(html: str | None, most: int = 3) -> list[tuple[str, str, float]]:
    """A page's votes: its best containers' paths (key in hexadecimal, text), with their share of the best one's score."""
    scored = containers(*parse(html or ""))[:most]
    out: dict[str, tuple[str, float]] = {}
    for value, node in scored:
        if value > 0:
            key = node.key.hex()
            out[key] = node.path, max(out[key][1] if key in out else 0.0, value / scored[0][0])
    return [(k, path, share) for k, (path, share) in out.items()]


def extract(html: str | None, keys: list[str]) -> str:
    """A page's main text by the first of its host's paths (their keys) that holds at least a third of what the page's own best container holds."""
    nodes, runs = parse(html or "")
    scored = containers(nodes, runs)
    if not scored:
        return ""
    best = scored[0][1]
    for key in map(bytes.fromhex, keys):
        found = {n for n in nodes if n.key == key and not n.sure}
        if found and 3 * sum(n.text for n in found) >= best.text:
            return text_of(nodes, runs, set(map(widened, found)).__contains__)
    own = widened(best)
    return text_of(nodes, runs, lambda n: n is own)


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", most: int = 3) -> DataFrame:
    """(host, paths, keys): each host's best-voted paths, best first, and their keys. Votes are summed before they are shuffled."""
    import pyarrow as pa

    def vote(batches):
        sums: dict[tuple[str, str], list] = {}
        held = 0
        for b in text_pieces(batches):
            for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                host = host_of(url)
                for key, path, share in votes_of(html):
                    own = sums.get((host, key))
                    if own is None:
                        own = sums[host, key] = [path, 0.0]
                        held += 300 + len(path) + len(host)
                    own[1] += share
            if held > 16_000_000:
                yield _votes(pa, sums)
                sums, held = {}, 0
        if sums:
            yield _votes(pa, sums)

    votes = pages.select(url_col, html_col).transform(arrow, vote, "host string, key string, path string, votes double")
    total = votes.groupBy("host", "key").agg(F.min("path").alias("path"), F.round(F.sum("votes"), 6).alias("votes"))
    best = total.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).where(F.col("place") <= most)
    ranked = best.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "path", "key"))).alias("ranked"))
    return ranked.select("host", F.col("ranked.path").alias("paths"), F.col("ranked.key").alias("keys"))


def _votes(pa, sums):
    columns = [[h for h, _ in sums], [k for _, k in sums], [p for p, _ in sums.values()], [v for _, v in sums.values()]]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.float64())], names=["host", "key", "path", "votes"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    Null and empty html give an empty text; a null or broken url belongs to the host "", whose pages vote
    together; repeated rows give repeated results and vote as often; an empty table gives an empty result;
    other columns, whatever their names, are not read. Pages are read twice and not shuffled: the keys of the
    hosts' paths (three of 32 characters for each host) are broadcast if the hosts are few, else pages are joined
    by host, where AQE splits a host that holds a large part of them. A page takes time and memory in proportion
    to its length, however it nests or breaks.
    """
    import pyarrow as pa

    paths = stage(host_paths(pages, url_col, html_col), "paths")
    few = paths.count() <= BROADCAST_ROWS // 4
    schema = {c: k for c, k in pages.dtypes}

    def result(ids, urls, texts):
        return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = f"`{id_col}` {schema[id_col]}, `{url_col}` {schema[url_col]}, text string, n_chars long"
    if few:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["keys"] for r in paths.select("host", "keys").toLocalIterator()})

        def run(batches):
            for b in text_pieces(batches):
                texts = [extract(h, shared.value.get(host_of(u), [])) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield result(b.column(0), b.column(1), texts)

        return pages.select(id_col, url_col, html_col).transform(arrow, run, kind)

    def hosts(batches):
        for b in text_pieces(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([host_of(u) for u in b.column(1).to_pylist()], pa.string())], names=["id", "url", "html", "host"])

    def run(batches):
        for b in text_pieces(batches):
            texts = [extract(h, p or []) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield result(b.column(0), b.column(1), texts)

    named = pages.select(id_col, url_col, html_col).transform(arrow, hosts, f"id {schema[id_col]}, url {schema[url_col]}, html string, host string")
    return named.join(paths.select("host", "keys"), "host", "left").select("id", "url", "html", "keys").transform(arrow, run, kind)
