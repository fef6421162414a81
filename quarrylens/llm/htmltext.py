"""Main text of web pages by composite text density over the DOM.

Every node gets its characters per tag, lowered by how much of both is links (against the page's own share); a
node's density sum is the sum of its children's densities. The subtree with the largest sum is content; the least
density on its way up to the body is the threshold, and every other subtree whose way down from the body stays at or
over that threshold gives up its own largest-sum subtree too. A chosen node inside an `article` or `main` element
grows to that element. Elements that are never article text (scripts, forms, navigation, asides and the like; by tag,
role or being hidden) carry no characters and give no text. Words of class and id that tell of notices, adverts or
reader comments do the same where an `article` or `main` element holds text without them. Elsewhere they only weigh:
a marked element counts MARKED of its density, so that density decides whether it is the page's text after all.

Defined cases: a null or blank page, or one without text, gives an empty string; a page cut off anywhere is read as
far as it goes, unclosed elements end with their parent; repeated rows give equal text; other columns are not read."""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, pieces, prepare

SLICE_BYTES = 2 << 20

# Fixed values of the HTML standard: elements without an end, with raw text, and that start a block of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption optgroup option".split()
)
# What an opening tag ends: itself and its kind, up to the nearest of the fences.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
FENCE = frozenset("html body table td th caption button object article section main".split())
NEVER = frozenset("head script style noscript template iframe object embed svg math canvas audio video nav footer aside form button select option textarea input label dialog menu search title map datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright "
    "disclaimer disqus footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager paginate pagination popup promo promoted promotion "
    "recommended related replies reply respond rss share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe subscription tagcloud tags toolbar trending widget".split()
)
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


MARKED = 1 / 16


class Dom:
    """A page's elements in document order, by column, and its pieces of text (element, text); element -1: a block begins or ends.

    skip: never content; mark: the nearest element at or above whose class or id tells of something beside the text (-1: none);
    article: the nearest article element at or above (-1: none)."""

    def __init__(self):
        self.tag, self.parent, self.skip, self.mark, self.article, self.text = ["html"], [-1], [False], [-1], [-1], []


def _judged(tag: str, raw: str, within_article: bool) -> tuple[bool, bool]:
    """(never content, marked by a word of class or id)."""
    if tag in NEVER or tag == "header" and not within_article:
        return True, False
    if not raw or "=" not in raw and "hidden" not in raw:
        return False, False
    marked = False
    for name, a, b, c in ATTR.findall(raw):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            words = {w.lower() for w in PART.findall(value)} & WORDS
            marked |= bool(words) and not (words <= {"header"} and within_article) and tag not in ("html", "body", "article", "main")
        elif name == "role" and value.strip().lower() in ROLES:
            return True, marked
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True, marked
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, marked
    return False, marked


RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}


def parse(page: str) -> Dom:
    """The page's elements. Open elements are also kept by name, so that each tag costs steps by the number of names it may end, at any depth."""
    dom = Dom()
    tags, parents, skips, marks, articles, texts = dom.tag, dom.parent, dom.skip, dom.mark, dom.article, dom.text
    stack = [0]
    open_at: dict[str, list[int]] = {"html": [0]}  # places in the stack of the open elements of a name
    at, size = 0, len(page)

    def nearest(names) -> int:
        return max((own[-1] for x in names if (own := open_at.get(x))), default=-1)

    def close(n: int) -> None:
        while len(stack) > n:
            open_at[tags[stack.pop()]].pop()

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            texts.append((stack[-1], page[at:]))
            break
        if m.start() > at:
            texts.append((stack[-1], page[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ends, rest = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if ends:
            if tag == "br":
                texts.append((stack[-1], " "))
            if tag in BLOCK:
                texts.append((-1, ""))
            if (i := nearest((tag,))) > 0:
                close(i)
            continue
        if tag == "html" or tag == "body" and open_at.get("body"):
            continue
        if tag in BLOCK:
            texts.append((-1, ""))
            if (i := nearest(("p",))) > nearest(FENCE):
                close(i)
        if tag in CLOSES:
            kind, fence = CLOSES[tag]
            if (i := nearest(kind)) > nearest(fence):
                close(i)
        if tag == "body" and open_at.get("head"):
            close(open_at["head"][0])
        node, up = len(tags), stack[-1]
        never, marked = _judged(tag, rest, articles[up] >= 0)
        tags.append(tag)
        parents.append(up)
        skips.append(skips[up] or never)
        marks.append(node if marked else marks[up])
        articles.append(node if tag in ARTICLE else articles[up])
        if tag in VOID:
            texts.append((node, " " if tag in ("br", "hr") else ""))
        elif tag in RAW:
            end = RAW_END[tag].search(page, at)
            stop = page.find(">", end.end()) if end else -1
            at = size if stop < 0 else stop + 1
        elif not rest.endswith("/") or tag in BLOCK or tag == "a":
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return dom


def densities(dom: Dom, text: list[tuple[int, str]]) -> tuple[list[float], list[float]]:
    """Composite density and density sum of every element; what is marked counts MARKED of it outside itself.

    The density of an element of C characters and T tags, LC and LT of them links, is C / T times the logarithm of
    C / LC * T / LT to the base ln(LC * C / (C - LC) + C * share of links in the page + e); counts of none are one."""
    n = len(dom.tag)
    chars, links, tags, link_tags = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    in_link = [False] * n
    factor = [1.0] * n
    for i in range(n):
        up = dom.parent[i]
        in_link[i] = dom.tag[i] == "a" or up >= 0 and in_link[up]
        factor[i] = (factor[up] if up >= 0 else 1.0) * (MARKED if dom.mark[i] == i else 1.0)
    for i, t in text:
        c = len(t) - t.count(" ")
        chars[i] += c
        links[i] += c if in_link[i] else 0
    for i in range(n - 1, 0, -1):
        if dom.skip[i]:
            continue
        up, w = dom.parent[i], MARKED if dom.mark[i] == i else 1.0
        chars[up] += w * chars[i]
        links[up] += w * links[i]
        tags[up] += w * (tags[i] + 1)
        link_tags[up] += w * (link_tags[i] + (dom.tag[i] == "a"))
    share = links[0] / chars[0] if chars[0] else 0.0
    density = [0.0] * n
    for i in range(n):
        c, lc = chars[i], links[i] or 1
        if not c or dom.skip[i] or lc >= c:
            continue
        t, lt = tags[i] or 1, link_tags[i] or 1
        base = math.log(lc * c / max(1, c - links[i]) + share * c + math.e)
        density[i] = factor[i] * c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(base)
    sums = [0.0] * n
    for i in range(1, n):
        sums[dom.parent[i]] += density[i]
    return density, sums


def content_roots(dom: Dom, text: list[tuple[int, str]]) -> tuple[set[int], set[int]]:
    """The elements whose text is content, and the marked elements that are content too."""
    density, sums = densities(dom, text)
    n = len(dom.tag)
    root = next((i for i in range(n) if dom.tag[i] == "body"), 0)
    own = [0] * n
    for i, t in text:
        own[i] += len(t)
    # text that stands in an element itself counts as one more child
    total = [s + (density[i] if own[i] else 0.0) for i, s in enumerate(sums)]

    best = list(range(n))  # the node with the largest sum in each subtree
    for i in range(n - 1, 0, -1):
        up = dom.parent[i]
        if not dom.skip[i] and (total[best[i]] > total[best[up]] or total[best[i]] == total[best[up]] and best[i] < best[up]):
            best[up] = best[i]
    top = best[root]
    if total[top] <= 0:
        return ({root} if any(own) else set()), set()
    inside = {-1}  # no mark, or one that the largest sum stands in
    i = dom.mark[top]
    while i >= 0:
        inside.add(i)
        i = dom.mark[dom.parent[i]]
    threshold, i = density[top], top
    while i > root:
        i = dom.parent[i]
        if density[i] > 0:
            threshold = min(threshold, density[i])
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[dom.parent[i]].append(i)
    chosen: set[int] = set()
    stack = [root]
    while stack:
        i = stack.pop()
        if dom.skip[i] or dom.mark[i] not in inside or density[i] < threshold:
            continue
        if dom.mark[best[i]] in inside:
            chosen.add(best[i])
        stack += children[i] if best[i] != i else []
    return {dom.article[i] if dom.article[i] >= 0 else i for i in chosen}, inside


def main_text(page: str | None) -> str:
    if not page:
        return ""
    dom = parse(page)
    n = len(dom.tag)
    headed = [False] * n  # a header element inside an article stays for its headings only
    for i in range(n - 1, 0, -1):
        headed[i] |= dom.tag[i] in HEADINGS
        headed[dom.parent[i]] |= headed[i]
    for i in range(1, n):
        dom.skip[i] |= dom.skip[dom.parent[i]] or dom.tag[i] == "header" and not headed[i]
    if any(i >= 0 and not dom.skip[i] and dom.mark[i] < 0 and dom.article[i] >= 0 and t.strip() for i, t in dom.text):
        for i in range(1, n):
            dom.skip[i] |= dom.mark[i] >= 0
    text = [(i, html.unescape(t)) for i, t in dom.text if i < 0 or t and not dom.skip[i]]
    roots, marks = content_roots(dom, [(i, " ".join(t.split())) for i, t in text if i >= 0])
    if not roots:
        return ""
    inside = [False] * n
    for i in range(n):
        inside[i] = i in roots or dom.parent[i] >= 0 and inside[dom.parent[i]]
    blocks: list[list[str]] = [[]]
    for i, t in text:
        if i < 0:
            blocks.append([])
        elif inside[i] and (not marks or dom.mark[i] in marks):
            blocks[-1].append(t)
    return " ".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns named in keep, with text and n_chars (code points), per row."""
    prepare(pages.sparkSession)
    whole = free_name(pages, "html")
    slim = pages.select(*keep, F.col(html_col).cast("string").alias(whole))

    def run(batches):
        for part in pieces(batches, whole, SLICE_BYTES):
            text = [main_text(x) for x in part.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(run, f"{kinds}, text string, n_chars long")


def op4(pages: DataFrame) -> DataFrame:
    return extract(pages, ["page_id", "url"])
