"""Main text of web pages by composite text density.

A page is cut into tags and text by one pattern and built into a tree with the
implied end tags of HTML.  Parts that never are article text (scripts, menus,
headers, footers, sidebars, forms, adverts, notices, reader comments) are left
out by element, role and class name.  Over what is left every node gets a
density: characters per tag, weighed down by the share of its characters and
tags that are links.  The node whose children's densities (its direct text
counts as a child) have the largest sum is the core of the article; the lowest
density on the path from it to the body is the threshold that further subtrees
of the page must reach to be taken too.  A core inside an ``article`` or
``main`` element stands for that whole element.

A class name or id alone cuts nothing out of an article: inside an ``article``,
``main`` or the core, and for headings, paragraphs and sections whose words also
name topics, a part goes only if its links or its density speak against it too.
Parts of a line and of code, and paragraphs called comments, never go by name.
A core without a heading of the first level takes the nearest heading before it.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import appended, query, read

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


#: Fixed values of HTML.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title xmp iframe noembed noframes")
BLOCKS = _set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
              "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section select "
              "summary table tbody td tfoot th thead title tr ul")
CLOSES_P = _set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul dd dt li")
#: An open element that a start tag ends, and the elements beyond which it doesn't look.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select"),
        "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
        "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
ENDS = {tag: (_set(own), _set(stop)) for tag, (own, stop) in ENDS.items()}
SCOPE = _set("button td th caption table html object template")

#: Elements, roles and class words that are no article text.
SKIP = _set("head script style noscript template title textarea iframe object embed svg canvas audio video map nav footer aside "
            "button select datalist dialog menu input label legend fieldset xmp noembed noframes annotation annotation-xml")
ROLES = _set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar")
CLASSES = _set("ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promos "
               "promoted promotion sidebar sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar "
               "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay comment comments commentlist "
               "disqus respond reply replies share sharing social related recommended recommendations newsletter subscribe widget widgets "
               "toolbar pagination pager login signup search copyright")
COMMENT = _set("comment comments commentlist reply replies respond disqus")
#: Words of CLASSES that also name what an article is about or how it is set, and those that page builders give to any part.
TOPICS = _set("header notice notices notification notifications alert related recommended recommendations widget widgets search "
              "menu menus promotion copyright overlay share sharing social")
#: Roles that parts of an article may have, too.
SOFT_ROLES = _set("alert alertdialog dialog complementary search form")
FRAMES = _set("widget widgets")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
TEXTUAL = HEADINGS | _set("p section")
MODIFIERS = _set("has with no without is not")


def _class_words(tag: str, attributes: str) -> tuple[set[str], str]:
    """Words that begin or end a class name or the id (but a heading's id names its topic), and the role."""
    words, role = set(), ""
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in ("class", "id", "role"):
            continue
        value = next(filter(None, values), "")
        if name == "role":
            role = value.strip().lower()
            continue
        if name == "id" and tag in HEADINGS:
            continue
        for part in value.split():
            own = [w.lower() for w in WORD.findall(part)]
            if own and own[0] not in MODIFIERS:
                words |= {own[0], own[-1]}
    return words, role


class Page:
    """The tree of a page in document order; node 0 is the root, and a subtree is a run of nodes."""

    def __init__(self, source: str):
        self.tag, self.parent, self.end = ["#root"], [-1], [0]
        self.words: dict[int, set[str]] = {}
        self.role: dict[int, str] = {}
        self.pieces: list[tuple[int, int, str]] = []  # node, block, text
        self.block = 0
        self.stack = [0]
        self._build(source)
        self._close(1)
        self.end[0] = len(self.tag)

    def _close(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.end[node] = len(self.tag)
            if self.tag[node] in BLOCKS:
                self.block += 1
        del self.stack[depth:]

    def _end(self, own: frozenset[str], stop: frozenset[str]) -> None:
        """Close the outermost open element of ``own`` above the innermost of ``stop``."""
        found = None
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in own:
                found = depth
            if tag in stop:
                break
        if found is not None:
            self._close(found)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self._end(_set("p"), SCOPE)
        if tag in ENDS:
            self._end(*ENDS[tag])
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.end.append(node + 1)
        if "=" in attributes:
            words, role = _class_words(tag, attributes)
            if words:
                self.words[node] = words
            if role:
                self.role[node] = role
        if tag in BLOCKS:
            self.block += 1
        if tag == "br":
            self.pieces.append((node, self.block, " "))
        if tag not in VOID:
            self.stack.append(node)

    def _end_tag(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            open_tag = self.tag[self.stack[depth]]
            if open_tag == tag:
                self._close(depth)
                return
            if open_tag in (SCOPE if tag in BLOCKS else BLOCKS) and not (tag in ("table", "html", "body") or tag in ENDS and open_tag in ENDS):
                return

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self.stack[-1], self.block, html.unescape(text) if "&" in text else text))

    def _build(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                return
            self._text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:-3])
                continue
            tag, attributes = name.lower(), m[3] or m[6] or ""
            if m[1] or m[4]:
                self._end_tag(tag)
                continue
            self._start(tag, attributes)
            if tag in RAW:
                stop = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                if stop is None and tag != "title":
                    at = size
                elif stop is not None:
                    at = stop.start()


def _marks(page: Page) -> tuple[list[bool], dict[int, bool]]:
    """For each node whether it is no article text for sure; and the other lexicon matches, whether each is to be judged by its text."""
    n = len(page.tag)
    words = page.words
    core = [t in ("article", "main") and not words.get(i, frozenset()) & COMMENT for i, t in enumerate(page.tag)]
    holds = [c or t == "h1" for c, t in zip(core, page.tag, strict=True)]
    for i in range(n - 1, 0, -1):
        holds[page.parent[i]] = holds[page.parent[i]] or holds[i]
    within, code, block = [False] * n, [False] * n, [""] * n
    sure, matched = [False] * n, {}
    for i in range(1, n):
        p, tag = page.parent[i], page.tag[i]
        within[i] = within[p] or core[i]
        code[i] = code[p] or tag in ("pre", "code")
        block[i] = tag if tag in BLOCKS else block[p]
        if tag in ("html", "body", "main"):
            continue
        elif tag in SKIP:
            # words of a sentence, and what an article shows without scripts
            sure[i] = not (within[p] and (tag == "noscript" or tag in ("button", "label") and block[p] == "p"))
        elif tag == "form":
            sure[i] = not holds[i]
        elif tag == "header":
            sure[i] = not within[i]
        elif page.role.get(i) in ROLES and not holds[i]:
            if within[p] and page.role[i] in SOFT_ROLES:
                words.setdefault(i, set())
                matched[i] = True
            else:
                sure[i] = True
        elif i in words and tag in BLOCKS and not code[i]:  # a name cuts no part of a line or of code
            found = words[i] & (COMMENT if tag == "article" else CLASSES)
            if found and (tag == "article" or not holds[i]):
                if found & COMMENT:
                    sure[i] = tag != "p" and tag not in HEADINGS
                else:
                    matched[i] = within[p] or found <= FRAMES or tag in TEXTUAL and found <= TOPICS
    return sure, matched


def _below(page: Page, cut: list[bool]) -> list[bool]:
    """For each node whether it or an ancestor is cut."""
    out = cut[:]
    for i in range(1, len(out)):
        out[i] = out[i] or out[page.parent[i]]
    return out


def _density(chars: float, tags: float, link_chars: float, link_tags: float, body_ratio: float) -> float:
    """Characters per tag, adjusted by links; counts of zero divide as one."""
    if chars <= 0:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_ratio * chars + math.e)
    scale = max(math.log(base), 0.1)  # pages without links have base 1
    return chars / max(tags, 1) * math.log(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)) / scale


class Measures:
    """Characters, tags and densities of every node over what is not left out."""

    def __init__(self, page: Page, out: list[bool], sizes: list[int], linked: list[bool]):
        n, parent = len(page.tag), page.parent
        self.chars, self.tags, self.link_chars, self.link_tags = ([0] * n for _ in range(4))
        chars, tags, link_chars, link_tags = self.chars, self.tags, self.link_chars, self.link_tags
        for i in range(n - 1, -1, -1):
            if out[i]:
                continue
            chars[i] += sizes[i]
            link_chars[i] += sizes[i] if linked[i] else 0
            if i:
                p = parent[i]
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (page.tag[i] == "a")
        self.density, self.total = [0.0] * n, [0.0] * n
        if not chars[0]:
            return
        ratio = link_chars[0] / chars[0]
        for i in range(n - 1, -1, -1):
            if not out[i]:
                self.density[i] = _density(chars[i], tags[i], link_chars[i], link_tags[i], ratio)
                self.total[i] += _density(sizes[i], 1, sizes[i] if linked[i] else 0, linked[i], ratio)
                if i:
                    self.total[parent[i]] += self.density[i]


def main_text(source: str) -> str:
    """The article's blocks in page order, one per line; empty if there are none."""
    page = Page(source)
    n = len(page.tag)
    sizes, linked = [0] * n, [False] * n
    for i in range(1, n):
        linked[i] = linked[page.parent[i]] or page.tag[i] == "a"
    for node, _, text in page.pieces:
        sizes[node] += len(text) if " " not in text and "\n" not in text else len(" ".join(text.split()))
    sure, matched = _marks(page)
    if not matched:
        out = _below(page, sure)
        chosen, core, _ = _chosen(page, out, Measures(page, out, sizes, linked))
        return _lines(page, out, chosen | _title(page, out, core, linked))
    whole = Measures(page, _below(page, sure), sizes, linked)
    cut = sure[:]
    for i, judged in matched.items():
        # words that name topics too: only links tell
        cut[i] = not (judged and page.words[i] & CLASSES <= TOPICS) or 2 * whole.link_chars[i] >= whole.chars[i]
    out = _below(page, cut)
    chosen, core, limit = _chosen(page, out, Measures(page, out, sizes, linked))
    inside = range(core, page.end[core]) if core >= 0 and page.tag[core] not in ("#root", "html", "body") else ()
    back = False
    for i, judged in matched.items():
        if cut[i] and (judged or i in inside):
            topic = page.words[i] & CLASSES <= TOPICS
            if 2 * whole.link_chars[i] < whole.chars[i] if topic else whole.density[i] >= limit > 0:
                cut[i], back = False, True
    if back:
        out = _below(page, cut)
        chosen, core, _ = _chosen(page, out, Measures(page, out, sizes, linked))
    return _lines(page, out, chosen | _title(page, out, core, linked))


def _title(page: Page, out: list[bool], core: int, linked: list[bool]) -> set[int]:
    """The nearest heading of the first two levels before a core that has none of the first."""
    if core < 0 or page.tag[core] in ("article", "main", "body", "html", "#root") or "h1" in page.tag[core : page.end[core]]:
        return set()
    before = (i for i in range(core - 1, 0, -1) if page.tag[i] in ("h1", "h2") and not out[i] and not linked[i])
    return set(list(before)[:1])


def _chosen(page: Page, out: list[bool], measures: Measures) -> tuple[set[int], int, float]:
    """The nodes to take, the core among them (-1 if there is no text), and the density that further ones must reach."""
    n, parent = len(page.tag), page.parent
    chars, density, total = measures.chars, measures.density, measures.total
    if not chars[0]:
        return set(), -1, 0.0

    def best(top: int) -> int:
        """The node of the largest sum below ``top``, the innermost of equals, or the article around it."""
        node = max(range(top, page.end[top]), key=lambda i: (total[i], i) if not out[i] else (-math.inf, i))
        around = node
        while around >= 0 and page.tag[around] not in ("article", "main"):
            around = parent[around]
        return around if around >= 0 else node

    core = max((i for i in range(n) if not out[i]), key=lambda i: (total[i], i))
    limit, i = density[core], core
    while i >= 0 and page.tag[i] not in ("body", "html"):
        limit = min(limit, density[i])
        i = parent[i]
    body = max(i, 0)
    main = best(body)
    chosen = {main}
    i = body + 1
    while i < page.end[body]:
        if out[i] or not chars[i]:
            i = page.end[i]
        elif any(i <= c < page.end[i] for c in chosen):
            i += 1 if i not in chosen else page.end[i] - i
        elif density[i] >= limit and page.tag[i] in BLOCKS:
            chosen.add(best(i))
            i = page.end[i]
        else:
            i += 1
    return chosen, main, limit


def _lines(page: Page, out: list[bool], chosen: set[int]) -> str:
    taken = [False] * len(page.tag)
    for c in chosen:
        taken[c : page.end[c]] = [True] * (page.end[c] - c)
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.pieces:
        if taken[node] and not out[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(filter(None, lines))


def extract_main_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``: the main text of the whole page, empty if it has none.

    Character references are decoded, white space inside a block becomes one
    space, blocks are trimmed and joined by line feeds; a line break element is
    white space.  Null and empty pages give the empty text.  Every column passes
    through; ``out`` must not be one of them (``ValueError``).  Equal densities go
    to the innermost, last node.  Repeated pages are each extracted, and an empty
    table gives no rows.
    """
    def make():
        return lambda batch: [pa.array([main_text(h) if h else "" for h in batch.column("__html").to_pylist()], pa.string())]

    return appended(pages, {"__html": F.col(html_col)}, make, f"{out} string")


@query("op9_html_text")
def op9_html_text(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("__source"))
    return extract_main_text(pages, "__source").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
