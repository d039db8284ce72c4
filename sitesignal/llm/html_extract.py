"""Main text of web pages by tag-path ratios.

Every text block of a page has a path of tags from the root. Blocks of one path are alike (all paragraphs of an
article, all items of a menu), so text length and punctuation are averaged over each path. Both ratios, as a sequence in
page order, are smoothed with a Gaussian and fused by their product; paths whose fused ratio reaches a share of the
standard deviation select the content nodes. These point to their container, the lowest element that holds nearly all of
their text; what lies outside of it goes, whatever it is called. Unless an article or main element bounds it, the
container is widened to the highest element that adds what may belong to it, so that title, byline and short sections
beside it stay. Names are a correction only: within the container, elements that say that they are something else (nav,
footer, aside, form, or a class such as sidebar, cookie, comments) are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.common import pieces

# Tags by their role in HTML.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre "
    "section select summary table tbody td template tfoot th thead tr ul object audio video canvas svg math button".split()
)
CONTAINER = frozenset("html body main article section div center table tbody tr td blockquote details".split())
ASIDE = frozenset(
    "head nav footer aside form menu dialog noscript template select button option fieldset object audio video canvas svg math "
    "frameset script style textarea title iframe".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role that name what is not the article.
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner banners "
    "sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup "
    "social share sharing related recommended recommendations comment comments commentlist disqus reply replies respond "
    "widget widgets pagination pager login search searchbox copyright legal disclaimer skip hidden complementary contentinfo "
    "adsbygoogle outbrain taboola paywall".split()
)
#: Words beside which a header is the article's own, and those that only tell what is beside the element.
OWN = frozenset("article content entry post story".split())
BESIDE = frozenset("with has no without".split())
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARKS = re.compile("[.,;:!?…。、，；：！？¿¡»«”“]")
SPACE = re.compile(r"\s+")

#: Share of the standard deviation that a content path's fused ratio reaches.
LAMBDA = 0.5
#: Share of the content's text that its container holds.
HELD = 0.9
#: Short blocks without heading or content node that make a row of something else, beside the content.
BESIDE_ROW = 3


class Block:
    """A run of text between two block boundaries."""

    __slots__ = ("path", "chain", "aside", "parts", "linked", "text")

    def __init__(self, path: str, chain: tuple[int, ...], aside: bool):
        self.path, self.chain, self.aside = path, chain, aside
        self.parts: list[str] = []
        self.linked = 0
        self.text = ""


def _set_aside(tag: str, attributes: str, within_article: bool) -> bool:
    """Whether an element says that it is not the article."""
    if tag in ASIDE:
        return True
    if tag == "header" and not within_article:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    names: list[set[str]] = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name in ("class", "id", "role"):
            names += [{w.lower() for w in WORDS.findall(one)} for one in value.split()]
    return any(_unwanted(words, tag) for words in names)


def _unwanted(words: set[str], tag: str) -> bool:
    """Whether one class, id or role, taken apart into words, names what is not the article."""
    if words & READERS:
        return True
    found = words & UNWANTED
    if not found or words & BESIDE or tag in ("main", "article"):
        return False
    return not (found == {"header"} and words & OWN)


#: What an opening tag closes when it is still open (up to the nearest of the second group).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


def blocks_of(page: str) -> tuple[list[Block], dict[int, str]]:
    """The text blocks of a page in order, and the tag of each element."""
    stack: list[tuple[str, int, bool]] = []  # tag, element, set aside
    tags: dict[int, str] = {}
    out: list[Block] = []
    current: Block | None = None
    linked = False
    at, end = 0, len(page)

    def say(text: str) -> None:
        nonlocal current
        if not text:
            return
        if current is None:
            if text.isspace():
                return
            current = Block("/".join(s[0] for s in stack), tuple(s[1] for s in stack), any(s[2] for s in stack[-1:]))
            out.append(current)
        text = entities.unescape(text) if "&" in text else text
        current.parts.append(text)
        if linked:
            current.linked += len(text.strip())

    def close(depth: int) -> None:
        nonlocal current
        del stack[depth:]
        current = None

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if tag == "a":
                linked = False
            elif tag in BLOCK:
                current = None
                linked = False
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
            continue
        if tag in RAW:
            stop = re.compile(f"</{tag}", re.I).search(page, at)
            at = stop.start() if stop else end
            continue
        if tag in VOID:
            if tag == "hr":
                current = None
            elif tag == "br" and current is not None:
                current.parts.append(" ")
            continue
        if tag == "a":
            linked = True
            continue
        if tag not in BLOCK:
            if attributes and _set_aside(tag, attributes, True):
                # an inline element that says it is not the article: its text is passed over
                stop = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
                if stop and "<" not in page[at : stop.start()]:
                    at = stop.end()
            continue
        linked = False
        current = None
        if stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if stack and tag in HEADINGS and stack[-1][0] in HEADINGS:
            close(len(stack) - 1)
        if tag in CLOSES:
            same, upto = CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in upto:
                    break
                if stack[k][0] in same:
                    close(k)
                    break
        if tag == "body":  # a head that was left open ends here
            stack = [s for s in stack if s[0] == "html"]
        element = len(tags)
        tags[element] = tag
        if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
            inside = any(s[0] in ("article", "main") for s in stack)
            aside = bool(stack and stack[-1][2]) or _set_aside(tag, attributes, inside)
            stack.append((tag, element, aside))
    for b in out:
        b.text = SPACE.sub(" ", "".join(b.parts)).strip()
    return [b for b in out if b.text], tags


def _smooth(x: np.ndarray) -> np.ndarray:
    """A Gaussian over two neighbours on either side; the ends are repeated."""
    if len(x) < 3:
        return x
    weight = np.exp(-np.square(np.arange(-2, 3)) / 2.0)
    return np.convolve(np.pad(x, 2, mode="edge"), weight / weight.sum(), mode="valid")


def content_paths(blocks: list[Block]) -> tuple[dict[str, float], float]:
    """The fused ratio of each path, averaged over its smoothed blocks, and the threshold."""
    totals: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for b in blocks:
        t = totals[b.path]
        t[0] += max(0, len(b.text) - b.linked)
        t[1] += len(MARKS.findall(b.text)) if b.linked < len(b.text) else 0
        t[2] += 1
    length = _smooth(np.array([totals[b.path][0] / totals[b.path][2] for b in blocks]))
    marks = _smooth(np.array([totals[b.path][1] / totals[b.path][2] for b in blocks]))
    fused = length * (1.0 + marks)
    mean: dict[str, float] = defaultdict(float)
    for b, f in zip(blocks, fused.tolist(), strict=True):
        mean[b.path] += f / totals[b.path][2] if totals[b.path][0] else 0.0
    return dict(mean), LAMBDA * float(fused.std())


def main_text(page: str | None) -> str:
    """The article's text of one page; empty if there is none."""
    every, tags = blocks_of(page or "")
    blocks = [b for b in every if not b.aside]
    if not blocks:
        return ""
    content, best, threshold = _selected(every)
    size = lambda some: sum(len(b.text) - b.linked for b in some)
    if 2 * size(b for b in content if not b.aside) < size(content):
        # most of what the ratios select says that it is something else (a long thread of comments): they are taken anew
        content, best, threshold = _selected(blocks)
    held: dict[int, int] = defaultdict(int)
    chosen = {id(b) for b in content if not b.aside}
    total = 0
    for b in content:
        if id(b) in chosen:
            total += len(b.text) - b.linked
            for element in b.chain:
                held[element] += len(b.text) - b.linked
    container: int | None = None
    for element in sorted(held):  # page order: an element comes before what it holds
        if tags[element] in CONTAINER and held[element] >= HELD * total:
            container = element
            if tags[element] in ("article", "main") and not _nested(element, held, tags, total, blocks):
                break
    if container is not None and not any(tags[e] in ("article", "main") for b in blocks if container in b.chain for e in b.chain[: b.chain.index(container) + 1]):
        container = _whole(container, blocks, tags, chosen)
    inside = [b for b in blocks if container is None or container in b.chain]
    keep = lambda b: b.linked < 0.8 * len(b.text) or best.get(b.path, 0.0) >= max(threshold, 1e-9)
    return "\n".join(b.text for b in inside if keep(b))


def _selected(blocks: list[Block]) -> tuple[list[Block], dict[str, float], float]:
    """The content nodes: blocks whose path's fused ratio reaches the threshold; and the ratios and the threshold."""
    best, threshold = content_paths(blocks)
    return [b for b in blocks if best[b.path] >= threshold and b.linked < len(b.text)], best, threshold


def _whole(container: int, blocks: list[Block], tags: dict[int, str], chosen: set[int]) -> int:
    """The highest element around the container to which each step adds what may belong to the content: title, byline,
    sections, but no lists of links, nor rows of short blocks without a heading or a content node."""
    chain = next(b.chain for b in blocks if container in b.chain)
    linked = lambda b: b.linked >= 0.8 * len(b.text)
    for element in reversed(chain[: chain.index(container)]):
        within = [k for k, b in enumerate(blocks) if element in b.chain]
        held = [k for k in within if container in blocks[k].chain]
        added = [blocks[k] for k in within if container not in blocks[k].chain]
        lists = [b for b in added if linked(b)]
        if lists and 2 * sum(len(b.text) for b in lists) >= sum(len(b.text) for b in added):
            break
        if tags[element] in ("body", "html") and len(lists) >= BESIDE_ROW:
            break
        sides = [blocks[k] for k in within if k < held[0]], [blocks[k] for k in within if k > held[-1]]
        if any(len(side) >= BESIDE_ROW and not any(id(b) in chosen or b.path.rsplit("/", 1)[-1] in HEADINGS for b in side) for side in sides):
            break
        container = element
    return container


def _nested(element: int, held: dict[int, int], tags: dict[int, str], total: int, blocks: list[Block]) -> bool:
    """Whether an article inside this element holds the content as well (main around article)."""
    if tags[element] == "article":
        return False
    inner = {e for b in blocks if element in b.chain for e in b.chain if tags[e] == "article"}
    return any(held[e] >= HELD * total for e in inner if e in held)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id_col, url_col, text (empty if none), n_chars (code points).

    A null or empty page has empty text. Character references are decoded, white space inside a block becomes one
    space, blocks are trimmed and joined in page order by one line feed. Broken markup is read as browsers read it where
    that matters: paragraphs, list items and cells end where the next begins, script and style end only at their own end
    tag. Rows that repeat give rows that repeat; an empty table gives an empty result; other columns are not read.
    """
    types = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    schema = f"`{id_col}` {types[id_col]}, `{url_col}` {types[url_col]}, text string, n_chars long"
    return pages.select(id_col, url_col, F.col(html_col).cast("string").alias("__html")).mapInArrow(run, schema)
