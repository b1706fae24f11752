"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text nodes, each with the path of open elements from the root to its leaf; elements are
named by tag and classes, and a block whose text is mostly links has a path of its own. Per path the text's length and
its punctuation are added up. The ratio of a path is its text by its blocks, weighted by the punctuation by its blocks. It
is smoothed over the paths beside it in page order that stand in the same container, and fused with the ratio of the
whole container (its paths' ratios, weighted by their text), with the share of text that is not in links, and with what the
page says of itself: an ``article`` weighs more, elements that are named as adverts, notices, comments and the like, and
forms, weigh less. Paths that reach a share of the best one are content, and their nodes are the text. A name alone decides
nothing: the text of a page whose every part is marked still comes out.

Beside that stand only rules of HTML: scripts, styles, controls of forms, navigation, headers (but an article's own),
footers, asides, dialogs and hidden elements have no main text, and what stands in an article counts as a container half
as good as the article at least.

Cases: a null page counts as empty; empty pages, and pages without text, give an empty text; tags that are not closed end
with their parents; paths that tie at the threshold are all content; very long pages are read whole; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
#: Elements that make no block of their own: their text runs on in the block around them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag here ends an open <p>.
ENDS_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: A start tag of the key ends open elements of the values up to the named scopes.
ENDS_OWN = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that hold a piece of a text rather than a whole one.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 hgroup header li ul ol dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr th details summary address".split())
#: Elements that are never main text.
BOILERPLATE = frozenset("nav header footer aside button select option optgroup label legend input datalist output dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Class names and ids (whole ones) that pages give to what is mostly no main text, and what such a name weighs.
MARKED = re.compile(r"(?:ad|adbox|adslot|ads|adv|advert\w*|banner|breadcrumbs?|comments?|comment-?(?:list|section|thread|body)|cookies?|cookie-?(?:bar|banner|notice|consent)|consent|copyright|disclaimer|disqus\w*|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|popup|promo|promoted|related|related-?(?:posts|articles|links|stories)|recommended|replies|responses|share|sharing|share-?(?:bar|buttons)|sidebar|skip|social|social-?(?:links|share)|sponsor\w*|subscribe|subscription|toolbar|widget)", re.I)
MARK, ARTICLE, MAIN = 0.1, 4.0, 2.0
#: Share of the best path's ratio from which on a path is content; weight of a path's own ratio beside its container's;
#: and what a container in an article has of the article's ratio, and a path in it of its container's, at least.
SHARE, OWN, FLOOR = 0.3, 0.25, 0.5
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/>\"']+)")
#: White space of HTML and Unicode alike.
SPACES = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


class Node:
    """A piece of text: its path, the path of its container, its block and that block's tag, whether it stands in a link,
    the weight of what the page says of it, and the path of the article around it."""

    __slots__ = ("path", "box", "block", "tag", "text", "linked", "weight", "article")

    def __init__(self, path: str, box: str, block: int, tag: str, text: str, linked: bool, weight: float, article: str):
        self.path, self.box, self.block, self.tag, self.text, self.linked, self.weight, self.article = path, box, block, tag, text, linked, weight, article


def _attributes(rest: str) -> dict[str, str]:
    if not rest or rest.isspace():
        return {}
    return {(name or bare).lower(): a or b or c for name, a, b, c, bare in reversed(ATTRIBUTE.findall(rest))}


def _dropped(tag: str, of: dict[str, str], inside_article: bool) -> bool:
    """Whether HTML itself says that an element is no main text. A header within the article holds its title."""
    if tag in BOILERPLATE and not (tag == "header" and inside_article):
        return True
    return "hidden" in of or of.get("aria-hidden", "").lower() == "true" or of.get("role", "").lower() in ROLES or HIDDEN.search(of.get("style", "")) is not None


def _marked(tag: str, of: dict[str, str]) -> bool:
    if tag == "form" or of.get("role", "").lower() == "form":
        return True
    names = f"{of.get('class', '')} {of.get('id', '')}".split()
    return tag not in ("html", "body", "main", "article") and any(MARKED.fullmatch(n) for n in names)


class Open:
    """An open element, and what holds within it."""

    __slots__ = ("tag", "gone", "linked", "marked", "article", "path", "box", "leaf")

    def __init__(self, tag: str, of: dict[str, str], up: Open | None):
        self.tag = tag
        self.article = up.article if up else ""
        self.gone = bool(up and up.gone) or _dropped(tag, of, self.article != "")
        self.linked = bool(up and up.linked) or tag == "a"
        self.marked = bool(up and up.marked) or _marked(tag, of)
        self.path, self.box, self.leaf = (up.path, up.box, up.leaf) if up else ("", "", "")
        if tag not in INLINE:
            classes = sorted(n for n in of.get("class", "").split() if not any(c.isdigit() for c in n))
            self.path += "/" + ".".join([tag, *classes])
            self.leaf = tag
            if tag not in TEXTUAL:
                self.box = self.path
        if tag == "article" or of.get("itemprop", "") == "articleBody":
            self.article = self.article or self.path

    def weight(self) -> float:
        return (MARK if self.marked else 1.0) * (ARTICLE if self.article else MAIN if "/main" in self.path else 1.0)


def text_nodes(page: str) -> list[Node]:
    """Text nodes outside of what HTML declares as no main text, in page order."""
    out: list[Node] = []
    stack: list[Open] = []
    block, at, n = 0, 0, len(page)
    root = Open("", {}, None)

    def pop_to(k: int) -> None:
        nonlocal block
        if any(e.tag not in INLINE for e in stack[k:]):
            block += 1
        del stack[k:]

    def put(text: str) -> None:
        e = stack[-1] if stack else root
        if text and not e.gone:
            text = entities.unescape(text) if "&" in text else text
            if text and not (text.isspace() and (not out or out[-1].block != block)):
                # Text of a container itself does not share what its paragraphs have.
                out.append(Node(e.path, e.box if e.box != e.path else e.box + "#", block, e.leaf, text, e.linked, e.weight(), e.article))

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        put(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not any(e.tag == "p" for e in stack):
                block += 1
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                block += 1 if tag == "hr" else 0
                if tag == "br":
                    put(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "body" and any(e.tag == "head" for e in stack):
            pop_to(next(k for k, e in enumerate(stack) if e.tag == "head"))
        if tag in ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in ENDS_OWN:
            own, scope = ENDS_OWN[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in scope:
                    break
                if stack[k].tag in own:
                    pop_to(k)
        rest = m[3]
        if rest.endswith("/") and tag not in INLINE and tag not in ENDS_P and tag not in ("article", "body", "html"):
            continue
        if tag not in INLINE:
            block += 1
        stack.append(Open(tag, _attributes(rest), stack[-1] if stack else None))
    put(page[at:])
    return out


def leaf_paths(nodes: list[Node]) -> list[str]:
    """The path of each node; that of a block which is mostly links, but a heading, ends in its link."""
    size: dict[int, list[int]] = {}
    for x in nodes:
        size.setdefault(x.block, [0, 0])[x.linked] += len(x.text.strip())
    return [x.path + "/a" if size[x.block][1] > size[x.block][0] and x.tag not in HEADINGS else x.path for x in nodes]


def path_ratios(nodes: list[Node], paths: list[str]) -> dict[str, float]:
    """The smoothed and fused ratio of every path, in page order."""
    text, marks, linked, blocks, first = {}, {}, {}, {}, {}
    for x, p in zip(nodes, paths):
        size = len(x.text.strip())
        text[p] = text.get(p, 0) + size
        marks[p] = marks.get(p, 0) + len(PUNCTUATION.findall(x.text))
        linked[p] = linked.get(p, 0) + (size if x.linked and x.tag not in HEADINGS else 0)
        blocks.setdefault(p, set()).add(x.block)
        first.setdefault(p, x)
    ratio = {p: text[p] / len(blocks[p]) * math.log2(2 + marks[p] / len(blocks[p])) for p in text}

    def mean(of: list[str]) -> float:
        """The ratio that a character of these paths has on average."""
        return sum(text[p] * ratio[p] for p in of) / max(1, sum(text[p] for p in of))

    own: dict[str, list[str]] = {}
    article: dict[str, list[str]] = {}
    for p, x in first.items():
        own.setdefault(x.box, []).append(p)
        if x.article and linked[p] < text[p] and not x.weight < 1:
            article.setdefault(x.article, []).append(p)
    fused = {}
    for box, of in own.items():
        whole = mean(of)
        for k, p in enumerate(of):
            beside = [of[max(k - 1, 0)], of[min(k + 1, len(of) - 1)]]
            smooth = 0.5 * ratio[p] + 0.25 * sum(ratio[q] for q in beside)
            within = article.get(first[p].article, [])
            held = max(whole, FLOOR * mean(within))
            smooth = max(smooth, FLOOR * held if within else 0)
            fused[p] = smooth**OWN * held ** (1 - OWN) * (1 - linked[p] / max(1, text[p])) * first[p].weight
    return {p: fused[p] for p in text}


def content_paths(nodes: list[Node], paths: list[str], share: float = SHARE) -> set[str]:
    """Paths whose ratio reaches ``share`` of the best one's."""
    fused = path_ratios(nodes, paths)
    best = max(fused.values(), default=0.0)
    return {p for p, f in fused.items() if f > 0 and f >= share * best}


def main_text(page: str | None) -> str:
    """Blocks of main text in page order, joined by empty lines."""
    nodes = text_nodes(page or "")
    paths = leaf_paths(nodes)
    chosen = content_paths(nodes, paths)
    blocks: list[list[str]] = []
    last = None
    for x, p in zip(nodes, paths):
        if p not in chosen:
            continue
        if x.block != last:
            blocks.append([])
            last = x.block
        blocks[-1].append(x.text)
    lines = (SPACES.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n\n".join(line for line in lines if line)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
