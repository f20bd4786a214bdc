"""Main text of web pages by consensus paths of their hosts."""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mktlens.llm._arrow import slices
from mktlens.session import cut_lineage

TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|(?P<close2>/?)(?P<name2>[a-zA-Z][\w:-]*)(?P<rest2>[^>]*+)>)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Element names of HTML by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template textarea title noscript svg iframe object math canvas audio video select xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = set("article blockquote body center dd details div dl li main ol section table tbody td tr ul".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
SKIPPED = set("nav footer aside form button dialog menu fieldset search label".split())
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
COMMENTS = set("comment comments commentlist respond disqus".split())
# A class or id is noise if each of its parts is such a word or a QUALIFIER ...
NOISE = COMMENTS | set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer header"
    " masthead sidebar cookie cookies consent gdpr notice notices banner newsletter subscribe share sharing social related recommended popup modal"
    " overlay login signup widget pagination pager toolbar skiplink".split()
)
# ... so "site-footer" is, "has-sidebar", "page-with-banner" and "social-policy" are not
QUALIFIER = set(
    "site page main top bottom left right primary secondary global area list section sections container wrapper wrap inner outer box bar block item items"
    " link links button buttons icons form slot unit post posts entry article articles stories news google wp mobile desktop sticky fixed side skip".split()
)
IDENTIFIED = set("center details div dl header ol table td ul".split())
MAIN_HINT = {"article", "main"}
CLOSES_P = BLOCK - {"body", "html"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "body", "html"}
CONTENT_SHARE = 0.8
#: Kinds of noise, the stronger the higher: by class or id (also forms, which may wrap a page), comments, by element, role or hidden.
PLAIN, NAMED, COMMENT, FIRM = range(4)
#: An element with more than this share of the page's text outside links is not noise by its name.
MOST = {NAMED: 0.5, COMMENT: 0.9}


class Element:
    """Its path is the keys of the containers above it and its own; kept as a digest
    that the parent's is continued to, as whole paths of deep pages are long."""

    __slots__ = ("name", "key", "step", "chain", "kind", "noise", "parent", "size", "linked", "hint", "first", "last", "head")

    def __init__(self, name: str, key: str, step: bool, kind: int, parent: Element | None, hint: int) -> None:
        self.name, self.key, self.step, self.kind, self.parent, self.hint = name, key, step, kind, parent, hint
        self.chain = parent.chain if parent else hashlib.blake2b(digest_size=16)
        if step:
            self.chain = self.chain.copy()
            self.chain.update(f">{key}".encode())
        # inside a header only headings are text
        self.head = name == "header" or (parent is not None and parent.head and name not in HEADING)
        self.noise = False  # its own or inherited, known once measured
        self.size = 0  # characters of text outside links and noise
        self.linked = 0  # the same in links
        self.first = self.last = 0  # range of its text pieces

    def path(self) -> str:
        keys, e = [], self
        while e is not None:
            if e.step:
                keys.append(f">{e.key}")
            e = e.parent
        return "".join(reversed(keys))


def digest_of(path: str) -> bytes:
    return hashlib.blake2b(path.encode(), digest_size=16).digest()


def describe(name: str, rest: str) -> tuple[str, int, int]:
    return short_tag(name, rest) if len(rest) < 200 else start_tag(name, rest)


@lru_cache(maxsize=8192)
def noise_of(token: str) -> int:
    """Kind of noise that a whole class or id names.  Of block__element--modifier,
    block and element count; the header of something is no noise, as it has a title."""
    token = token.lower().replace("side-bar", "sidebar").replace("skip-link", "skiplink")
    block, _, element = token.split("--")[0].partition("__")
    for whole in (block, element):
        parts = [x for x in re.split(r"[-_]", re.sub(r"\d+", "", whole)) if x]
        named = NOISE.intersection(parts)
        if not named or any(x not in NOISE and x not in QUALIFIER and not (x == "content" and x is parts[-1]) for x in parts):
            continue
        if named == {"header"} and (whole is element or {"page", "post", "entry", "article", "section", "block"}.intersection(parts)):
            continue
        return COMMENT if named & COMMENTS else NAMED
    return PLAIN


def start_tag(name: str, rest: str) -> tuple[str, int, int]:
    """(generalised tag-class key, kind of noise, main-text hint: 1 an article, 2
    the main element or an article's body) of a start tag."""
    firm = (NAMED if name in ("form", "fieldset") else FIRM) if name in SKIPPED else PLAIN
    if not rest.strip(" \t\r\n/"):
        return name, firm, (name in MAIN_HINT) + (name == "main")
    attrs: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(rest):
        attrs.setdefault(m[1].lower(), unescape((m[2] or "").strip("\"'")))
    classes = attrs.get("class", "").split()
    key = ".".join([name, *sorted({re.sub(r"\d+", "#", c.lower()) for c in classes})])
    role = attrs.get("role", "").lower()
    hint = 2 if "main" in (name, role) or attrs.get("itemprop", "").lower() == "articlebody" else int("article" in (name, role))
    hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I))
    if hidden or (role in ROLES and role != "form"):
        return key, FIRM, hint
    kind = max(firm, NAMED if role == "form" else PLAIN)
    # a main element may be styled "sidebar" and stay the main text
    if not hint and name not in ("html", "body"):
        kind = max([kind, *map(noise_of, classes)])
        # headings and sections of an article have slugs as ids
        slug = name == "section" or "section" in classes
        named = noise_of(attrs.get("id", "")) if name in IDENTIFIED or slug else PLAIN
        if not slug or named == COMMENT:
            kind = max(kind, named)
    return key, kind, hint


short_tag = lru_cache(maxsize=8192)(start_tag)


@lru_cache(maxsize=64)
def closer(name: str) -> re.Pattern:
    return re.compile(f"</{name}", re.I | re.A)


def parse(html: str) -> tuple[list[Element], list[tuple[str, Element, bool]]]:
    """(elements in page order, pieces (text or None for a block's edge, element,
    in a link?)).  Unclosed and misnested tags are taken as browsers roughly do."""
    root = Element("html", "", False, PLAIN, None, 0)
    stack, elements, pieces = [root], [root], []
    opened: dict[str, int] = {"html": 1}  # open elements by name
    unclosed: set[str] = set()  # raw elements that are not closed from here on
    link = 0
    pos, n = 0, len(html)
    tags = html.rfind(">")  # behind the last one there is no whole tag

    def leave(to: int) -> None:
        nonlocal link
        for e in reversed(stack[to:]):
            e.last = len(pieces)
            opened[e.name] -= 1
            if e.name in BLOCK:
                pieces.append((None, e, False))
            if e.name == "a":
                link -= 1
        del stack[to:]

    while pos < n:
        m = TAG.search(html, pos) if pos <= tags else None
        end = m.start() if m else html.find("<!--", pos)
        end = n if end < 0 else end
        if end > pos:
            pieces.append((html[pos:end], stack[-1], link > 0))
        if not m:
            break
        pos = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing = bool(m["close"] or m["close2"])
        if closing:
            for i in range(len(stack) - 1, 0, -1) if opened.get(name) else ():
                if stack[i].name == name:
                    leave(i)
                    break
                if stack[i].name in ("td", "th", "table", "body") and name not in SCOPE and name not in CONTAINER:
                    break
            else:
                if name in BLOCK:
                    pieces.append((None, stack[-1], False))
            continue
        if name in ("html", "body") and opened.get(name, 0) > (name == "html"):
            continue
        rest = m["rest"] if m["rest"] is not None else m["rest2"] or ""
        if name in RAW:
            if not rest.rstrip().endswith("/") or name not in ("svg", "math"):
                close = None if name in unclosed else closer(name).search(html, pos)
                if close is None:
                    unclosed.add(name)
                    pos = n if name in ("script", "style", "textarea", "title") else pos
                else:
                    pos = html.find(">", close.start()) + 1 or n
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1) if opened.get("p") else ():
                if stack[i].name == "p":
                    leave(i)
                    break
                if stack[i].name in BLOCK:
                    break
        ends = SIBLINGS.get(name)
        if ends and any(opened.get(x) for x in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ends:
                    leave(i)
                    break
                if stack[i].name in SCOPE and not (name in ("td", "th", "tr") and stack[i].name != "table"):
                    break
        if name in VOID:
            pieces.append((None if name == "hr" else " ", stack[-1], True))
            continue
        up = stack[-1]
        key, kind, hint = describe(name, rest)
        e = Element(name, key, name in CONTAINER and name != "body", kind, up, hint)
        opened[name] = opened.get(name, 0) + 1
        e.first = len(pieces)
        if name in BLOCK:
            pieces.append((None, e, False))
        if name == "a":
            link += 1
        elements.append(e)
        stack.append(e)
    leave(0)
    root.last = len(pieces)
    return elements, pieces


def measure(elements: list[Element], pieces: list) -> None:
    """Noise of every element, then characters of text outside links and noise,
    summed up the tree.

    Noise is inherited, but an element that holds most of the page's text is not
    noise by its name, and the main element or the largest article of the page is
    not by the name of a wrapper."""
    for text, e, link in pieces:
        if text and not text.isspace():
            n = len(text) - text.count(" ") // 2
            if link:
                e.linked += n
            else:
                e.size += n
    own = [(e.size, e.linked) for e in elements]
    for e in elements[1:]:
        e.noise = e.kind == FIRM or e.parent.noise
    summed(elements)
    total = elements[0].size
    article = max((e for e in elements if e.hint == 1 and not e.noise), key=lambda e: e.size, default=None)
    kinds = {id(elements[0]): PLAIN}
    for e in elements[1:]:
        kind, above = e.kind, kinds[id(e.parent)]
        if kind in MOST and e.size > MOST[kind] * total:
            kind = PLAIN
        if above == NAMED and (e is article or e.hint == 2):
            above = PLAIN
        kinds[id(e)] = max(kind, above)
    for e, sizes in zip(elements, own):
        e.noise = kinds[id(e)] != PLAIN
        e.size, e.linked = sizes
    summed(elements)


def summed(elements: list[Element]) -> None:
    """Own sizes without noise, summed up the tree."""
    for e in elements:
        if e.noise:
            e.size = e.linked = 0
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.size += e.size
            e.parent.linked += e.linked


def best(elements: list[Element]) -> Element:
    """The container that holds the page's main text: the innermost that keeps
    CONTENT_SHARE of its text, where an article or main element with half of the
    page's text goes first."""
    root = elements[0]
    hinted = [e for e in elements if e.hint and not e.noise and 2 * e.size >= root.size and e.size]
    at = hinted[0] if hinted else root
    inside = at
    for e in elements:
        if e.name in CONTAINER and not e.noise and e.size and e.size >= CONTENT_SHARE * at.size:
            up = e
            while up is not None and up is not inside:
                up = up.parent
            if up is inside:
                inside = e
    return at if hinted else inside


def text_of(chosen: list[Element], pieces: list) -> str:
    """Blocks of the chosen elements in page order, one a line."""
    blocks: list[str] = []
    for c in chosen:
        run: list[str] = []
        for text, e, _ in pieces[c.first : c.last]:
            if text is None:
                blocks.append("".join(run))
                run = []
            elif not e.noise and not e.head:
                run.append(unescape(text) if "&" in text else text)
        blocks.append("".join(run))
    lines = (" ".join(b.split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def outside(elements: list[Element], chosen: list[Element], top: Element) -> list[Element]:
    """Outermost containers with text inside ``top`` that neither hold nor lie in one
    of the chosen elements, which are in page order and apart."""
    ends = [c.last for c in chosen]
    out: list[Element] = []
    end = -1
    for e in elements:
        if e is top or e.name not in CONTAINER or e.noise or not e.size or e.first < max(end, top.first) or e.last > top.last:
            continue
        at = bisect_right(ends, e.first)
        if at < len(chosen) and chosen[at].first < e.last:
            continue
        out.append(e)
        end = e.last
    return out


def extract(html: str, path: str | None, others: frozenset[bytes] = frozenset()) -> str:
    """Main text under a host's path: of all outermost elements there that are more
    than links.  A page goes by its own best container where these lack the path or
    hold less than CONTENT_SHARE of it, not counting ``others``: digests of paths that
    lie beside the main text on most pages of the host."""
    elements, pieces = parse(html)
    measure(elements, pieces)
    found: list[Element] = []
    under = digest_of(path or "")
    for e in elements[1:] if path else ():
        if e.chain.digest() == under and e.name in CONTAINER and not e.noise and e.size and e.size >= e.linked and not (found and e.last <= found[-1].last):
            found.append(e)
    if path == "":
        found = [elements[0]]
    own = best(elements)
    if found:
        beside = sum(e.size for e in outside(elements, found, own) if e.chain.digest() != under and e.chain.digest() in others)
        if sum(e.size for e in found) < CONTENT_SHARE * (own.size - beside):
            found = []  # the consensus does not fit this page
    return text_of(found or [own], pieces)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page.

    1. Each page scores its containers and votes for the generalised tag-class
       path (digits as #) of the best.  2. Spark counts the votes of each host,
       combined before the shuffle, whatever one host weighs; the path with most
       votes wins (then by text held, then by name).  3. Every page is extracted
       again under its host's path; a page that lacks it, or where it holds less
       than CONTENT_SHARE of the page's own best container, goes by the latter
       (text known to lie beside the main text on most of the host's pages set aside).

    Null or empty html: an empty text.  Pages without a host vote together.
    Repeated pages each give a row; other columns are ignored; an empty table gives
    an empty result.  Columns: the id, url, text, n_chars, host, host_path.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("host", host_of(F.col("url")))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in slices(batches, "text"):
            hosts, paths, sizes, chosen = [], [], [], []
            for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                elements, pieces = parse(html)
                measure(elements, pieces)
                e = best(elements)
                if e.size:
                    beside = {o.path() for o in outside(elements, [e], elements[0])}
                    hosts += [host] * (1 + len(beside))
                    paths += [e.path(), *beside]
                    sizes += [e.size] + [0] * len(beside)
                    chosen += [True] + [False] * len(beside)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(chosen, pa.bool_())],
                names=["host", "path", "size", "chosen"],
            )

    # stored, as it is counted twice: a row a host and path
    votes = cut_lineage(
        rows.select("host", "text").mapInArrow(vote, "host string, path string, size long, chosen boolean")
        .groupBy("host", "path", "chosen").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    )
    # stored (a row a host), so that both sides of the join are dealt anew and a hot
    # host's pages can be split
    winners = votes.where("chosen").groupBy("host").agg(F.max_by("path", F.struct("n", "size", "path")).alias("path"), F.sum("n").alias("pages"))
    beside = (
        votes.where("not chosen").join(winners.select("host", "pages"), "host").where("2 * n > pages")
        .groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("others"))
    )
    winners = cut_lineage(winners.join(beside, "host", "left").select("host", "path", "others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in slices(batches, "text"):
            texts = [extract(h, p, frozenset(map(digest_of, o or ()))) for h, p, o in zip(*(part.column(k).to_pylist() for k in (2, 4, 5)))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), part.column(3), part.column(4)],
                names=["id", "url", "text", "n_chars", "host", "host_path"],
            )

    out = rows.join(winners, "host", "left").select("id", "url", "text", "host", "path", "others").mapInArrow(
        run, f"id {kind}, url string, text string, n_chars long, host string, host_path string"
    )
    return out.withColumnRenamed("id", id_col)
