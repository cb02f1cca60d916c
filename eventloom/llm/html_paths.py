"""Main text of web pages by tag-path ratios.

Every text block of a page lies on a root-to-leaf path of tags (with their class or id words). Per path
the operator sums text length, punctuation, number of tags and number of blocks, and takes two ratios:
text per block and punctuation per block. Ratios are smoothed over the blocks in page order (a window
of blocks, so that a short paragraph between long ones keeps their weight), the two are fused by their
product, and paths whose fused score reaches a share of the page's standard deviation are content.
The window stays on one side of the border of <article> and <main>. A container that owes most of its text
to content paths takes its short blocks along, content paths what lies below them, and headings stay when
they stand above content; if the page names its article, short blocks and headings only do so inside it.

Blocks below tags that mark menus, headers, footers and sidebars never count; controls, scripts, drawings and
players are left out without ending the block they stand in. A form, and an element whose class, id or role
has a name that starts or ends with a word for notices, adverts, comments and the like (comment-list, userComments; not
has-sidebar), doesn't count either, unless it is the page's html, body, main or article, or holds most of
the text on content paths: then the scores decide. Of a page whose <article> or <main> has content outside
that element and doesn't hold it, the mark decides (long comments below a short article).

The page is read in one pass, and paths, marks and articles are numbers and ranges of blocks, so time and
memory grow with the page's length, however deep or broken its markup.

Rules of the text: character references are decoded, white space inside a block is one space, blocks are
trimmed and joined by one newline in page order.

Defined cases: null or empty html and pages without text give an empty text; unclosed comments end at
the next ">" (or with the page), unclosed scripts and styles with the page; tags left open are closed by
their parents; a quote that no quote before a space, "/" or ">" closes is a character like any other; a "<" with a
name that meets another "<" first is text, one that meets the page's end is dropped; other columns are kept apart.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import bound_batches

#: Tags whose content is never text of the article. Fixed values.
SKIPPED = frozenset("head nav header footer aside fieldset dialog menu".split())
#: Tags whose content is no text and that don't break a block. Fixed values.
QUIET = frozenset("svg button select optgroup option label canvas object audio video map datalist legend annotation annotation-xml".split())
#: Of these, what a paragraph, heading, list or section inside them closes.
CONTROLS = frozenset("button select optgroup option label".split())
#: Tags that don't break a block, formulas included. Fixed values.
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark meter nobr output progress q rp rt
ruby s samp small span strike strong sub sup time tt u var wbr img input embed
math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom menclose semantics""".split())
#: Tags without content. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words in class, id or role that mark what is not the article. Fixed values.
MARKED = frozenset("""ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation
menu breadcrumb breadcrumbs sidebar aside footer masthead topbar header toolbar cookie cookies consent gdpr notice notices
notification alert popup modal overlay newsletter subscribe subscription signup login search social share sharing related recommended
recommendations comment comments reply replies respond disqus widget pagination pager copyright legal disclaimer tags tagcloud
complementary contentinfo skip hidden""".split())
#: Words that take the mark from the next one, and marking words that mark a longer name only behind one of these. Fixed values.
NEGATIONS = frozenset("has no not non with without".split())
VAGUE = {"header": frozenset(("site", "main", "top", "global")), "tags": frozenset(("post", "entry", "article")), "hidden": frozenset(("visually",)),
         "search": frozenset(("site", "main", "top", "header")), "legal": frozenset(("site", "footer")), "reply": frozenset(("comment",))}
#: Tags of the page itself and of its article: no name marks them.
UNMARKED = frozenset(("html", "body", "main", "article"))
NAMED = ("article", "main")
#: Blocks whose ratios are averaged with a block's own, on either side.
WINDOW = 2
#: Share of the standard deviation of the fused scores that a content path needs.
THRESHOLD = 0.5

# possessive throughout: no part is tried twice, and a failed match is skipped as a whole
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^\"'<>=]++|=\s*+(?:\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>])|[^\s\"'<>=][^\s<>]*+)?+|[\"'])*+)")
OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))?+)?+")
RAW = frozenset(("script", "style", "textarea", "title", "template", "noscript", "iframe"))
RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
PUNCTUATION = re.compile(r"[.,;:!?…。，！？；：]")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
CLOSES_P = frozenset("""address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr
main menu nav ol p pre section table ul""".split())
#: What an open tag of a list or table closes. Fixed values.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
OUT_OF_CONTROLS = frozenset("p article main section h1 h2 h3 h4 h5 h6 ul ol table blockquote".split())


class Block:
    """path, parent: numbers of tag paths; named: lies in an article or main; parts: (text, number of the marked inline element it is in or -1)."""
    __slots__ = ("path", "parent", "tag", "parts", "tags", "text", "named")

    def __init__(self, element):
        self.path, self.parent, self.tag, self.named = (element.path, element.parent, element.tag, element.named) if element else (0, 0, "", False)
        self.parts, self.tags, self.text = [], 0, ""

    def join(self, ruled_out=()) -> str:
        from html import unescape
        s = "".join(x for x, mark in self.parts if mark not in ruled_out)
        return " ".join((unescape(s) if "&" in s else s).split())


class Element:
    """An open element; first: number of blocks before it."""
    __slots__ = ("tag", "path", "parent", "skipped", "quiet", "marked", "named", "first")

    def __init__(self, tag, path, outer, marked, first):
        self.tag, self.path, self.parent = tag, path, outer.path if outer else 0
        self.quiet = tag in QUIET or bool(outer and outer.quiet)
        self.skipped = self.quiet or tag in SKIPPED or bool(outer and outer.skipped)
        self.marked = marked and tag not in UNMARKED
        self.named = tag in NAMED or bool(outer and outer.named)
        self.first = first


def _marks(name: str) -> bool:
    """Does a class, id or role name mark what is not the article?"""
    words = [w for w in re.split(r"[^a-z0-9]+", CAMEL.sub("-", name).lower()) if w]
    if not words or MARKED.issuperset(words):
        return bool(words)
    if words[0] in MARKED and words[0] not in VAGUE:
        return True
    last = words[-1]
    return last in MARKED and words[-2] not in NEGATIONS and (last not in VAGUE or words[-2] in VAGUE[last])


def _read_step(tag: str, attributes: str) -> tuple[str, bool]:
    values = [m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role")]
    names = [name for v in values for name in v.split()]
    words = [w for name in names for w in re.split(r"[^a-z0-9]+", name.lower()) if w]
    return tag + "".join("." + w for w in words[:4]), any(map(_marks, names))


@lru_cache(10_000)
def _short_step(tag: str, attributes: str) -> tuple[str, bool]:
    return _read_step(tag, attributes)


def _step(tag: str, attributes: str) -> tuple[str, bool]:
    """(path step, does a name mark it as not content)."""
    if "=" not in attributes:
        return tag, False
    return (_short_step if len(attributes) < 500 else _read_step)(tag, attributes)


class Page:
    """The text blocks of a page in its order (nothing below skipped tags), the parents of its tag paths (path 0
    is the page; a parent has the smaller number) and block ranges of its marked and its article and main elements."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.above: list[int] = [0]
        self.marks: list[tuple[int, int]] = []
        self.named: list[tuple[int, int]] = []
        self.inline_marks = 0
        self._paths: dict[tuple[int, str], int] = {}
        self._stack: list[Element] = []
        self._open: dict[str, int] = {}
        self._inline: list[tuple[str, int]] = []
        self._block = None
        self._read(html)
        self._end()
        self._close(0)

    def _text(self, piece: str) -> None:
        top = self._stack[-1] if self._stack else None
        if piece and not (top and top.skipped):
            if self._block is None:
                self._block = Block(top)
            self._block.parts.append((piece, self._inline[0][1] if self._inline else -1))

    def _end(self) -> None:
        if self._block is not None:
            self._block.text = self._block.join()
            if self._block.text:
                self.blocks.append(self._block)
            self._block = None
        self._inline.clear()

    def _close(self, at: int) -> None:
        """Close all open elements from stack[at] on."""
        for e in self._stack[at:]:
            self._open[e.tag] -= 1
            if e.first < len(self.blocks):
                if e.marked:
                    self.marks.append((e.first, len(self.blocks)))
                if e.tag in NAMED:
                    self.named.append((e.first, len(self.blocks)))
        del self._stack[at:]

    def _read(self, html: str) -> None:
        pos, n, ended = 0, len(html), False
        while pos < n:
            m = OPEN.search(html, pos)
            if m is None:
                return self._text(html[pos:])
            at = m.start()
            self._text(html[pos:at])
            if html.startswith("<!--", at):
                stop = -1 if ended else html.find("-->", at + 2)
                ended = stop < 0  # no comment after this one is closed either
                pos = (html.find(">", at + 4) + 1 or n) if ended else stop + 3
                continue
            m = TAG.match(html, at)
            if m is None:
                # a declaration, or a stray "</"
                pos = html.find(">", at) + 1 or n
            elif m.end() == n:
                return
            elif html[m.end()] == "<":
                self._text(html[at:m.end()])
                pos = m.end()
            elif m[1]:
                self._shut(m[2].lower())
                pos = m.end() + 1
            else:
                pos = self._start(m[2].lower(), m[3], html, m.end() + 1)

    def _shut(self, tag: str) -> None:
        if tag in INLINE:
            if self._inline and self._inline[-1][0] == tag:
                self._inline.pop()
        elif self._open.get(tag):
            at = len(self._stack) - 1
            while self._stack[at].tag != tag:
                at -= 1
            if not self._stack[at].quiet:
                self._end()
            self._close(at)

    def _start(self, tag: str, attributes: str, html: str, pos: int) -> int:
        """Take an open tag that ends at pos; the position to read on from."""
        stack = self._stack
        if tag in RAW:
            m = RAW_END[tag].search(html, pos)
            return (html.find(">", m.end()) + 1 if m else 0) or len(html)
        if tag in INLINE:
            if not (stack and stack[-1].skipped):
                if self._block is None:
                    self._block = Block(stack[-1] if stack else None)
                self._block.tags += 1
                if tag == "br":
                    self._text(" ")
                elif tag not in VOID and _step(tag, attributes)[1]:
                    self._inline.append((tag, self.inline_marks))
                    self.inline_marks += 1
            return pos
        if tag in OUT_OF_CONTROLS:
            while stack and stack[-1].quiet and stack[-1].tag in CONTROLS:
                self._close(len(stack) - 1)
        if tag not in QUIET and not (stack and stack[-1].quiet):
            self._end()
            if stack and (tag in CLOSES_P and stack[-1].tag == "p" or stack[-1].tag in CLOSES.get(tag, ())):
                self._close(len(stack) - 1)
        if tag in VOID or attributes.endswith("/"):
            return pos
        outer = stack[-1] if stack else None
        step, marked = _step(tag, attributes)
        key = (outer.path if outer else 0, step)
        path = self._paths.get(key)
        if path is None:
            path = self._paths[key] = len(self.above)
            self.above.append(key[0])
        stack.append(Element(tag, path, outer, marked or tag == "form", len(self.blocks)))
        self._open[tag] = self._open.get(tag, 0) + 1
        return pos


def covered(ranges, n: int) -> list[bool]:
    """For each of n positions, does one of the ranges hold it?"""
    steps = [0] * (n + 1)
    for first, end in ranges:
        steps[first] += 1
        steps[end] -= 1
    return [total > 0 for total in accumulate(steps[:n])]


def content_paths(found: list[Block]) -> set[str]:
    """Paths whose fused score reaches the threshold."""
    length, punctuation, tags, number = {}, {}, {}, {}
    for b in found:
        length[b.path] = length.get(b.path, 0) + len(b.text)
        punctuation[b.path] = punctuation.get(b.path, 0) + len(PUNCTUATION.findall(b.text))
        tags[b.path] = tags.get(b.path, 0) + 1 + b.tags
        number[b.path] = number.get(b.path, 0) + 1
    score: dict[str, float] = {}
    for side in ([b for b in found if b.named], [b for b in found if not b.named]):
        ratio = [(length[b.path] / tags[b.path], (1 + punctuation[b.path]) / number[b.path]) for b in side]
        sums = [(0.0, 0.0)]
        for x, y in ratio:
            sums.append((sums[-1][0] + x, sums[-1][1] + y))
        for i, b in enumerate(side):
            lo, hi = max(0, i - WINDOW), min(len(side), i + WINDOW + 1)
            x, y = ((sums[hi][k] - sums[lo][k]) / (hi - lo) for k in (0, 1))
            score[b.path] = max(score.get(b.path, 0.0), max(x, ratio[i][0]) * max(y, ratio[i][1]))
    mean = sum(score.values()) / len(score)
    spread = (sum((s - mean) ** 2 for s in score.values()) / len(score)) ** 0.5
    return {p for p, s in score.items() if s >= THRESHOLD * spread}


def unmarked(page: Page) -> list[bool]:
    """Which blocks stay after marks: a mark on most of the text of content paths doesn't count. Texts lose their
    marked inline parts."""
    blocks, n = page.blocks, len(page.blocks)
    if not page.marks and not page.inline_marks:
        return [True] * n
    paths = content_paths(blocks)
    length = [len(b.text) if b.path in paths else 0 for b in blocks]
    before = [0, *accumulate(length)]
    total = before[-1]
    # an article or main with content that lies wholly before or behind a mark rules it out
    held = [(first, end) for first, end in page.named if before[end] > before[first]]
    first_end, last_start = min((end for _, end in held), default=n + 1), max((first for first, _ in held), default=-1)

    def ruled_out(first: int, end: int, text: int) -> bool:
        return 2 * text <= total or first_end <= first or last_start >= end

    gone = covered([(first, end) for first, end in page.marks if ruled_out(first, end, before[end] - before[first])], n)
    for i, b in enumerate(blocks):
        if any(mark >= 0 for _, mark in b.parts):
            sizes: dict[int, int] = {}
            for text, mark in b.parts:
                sizes[mark] = sizes.get(mark, 0) + (len(text) if length[i] else 0)
            b.text = b.join({mark for mark, size in sizes.items() if mark >= 0 and ruled_out(i, i + 1, size)})
    return [not out and bool(b.text) for out, b in zip(gone, blocks)]


def main_text(html: str | None) -> tuple[str, int]:
    """(main text, number of content paths)."""
    if not html:
        return "", 0
    page = Page(html)
    stay = unmarked(page) if page.blocks else []
    found = [b for b, s in zip(page.blocks, stay) if s]
    if not found:
        return "", 0
    content = content_paths(found)
    direct, owed = {}, {}
    over = [False] * len(page.above)  # paths that content lies on or below
    for b in found:
        direct[b.parent] = direct.get(b.parent, 0) + len(b.text)
        if b.path in content:
            owed[b.parent] = owed.get(b.parent, 0) + len(b.text)
            over[b.parent] = True
    for path in range(len(over) - 1, 0, -1):
        over[page.above[path]] |= over[path]
    below = [path in content for path in range(len(page.above))]  # content paths and what lies below them
    for path in range(1, len(below)):
        below[path] |= below[page.above[path]]
    holders = {p for p, n in owed.items() if 2 * n > direct[p]}
    # a page that names its article has its headings and short blocks there
    before = [0, *accumulate(s and b.path in content for b, s in zip(page.blocks, stay))]
    names = [(first, end) for first, end in page.named if before[end] > before[first]]
    inside = covered(names, len(stay)) if names else [True] * len(stay)
    kept = [b.text for b, s, within in zip(page.blocks, stay, inside)
            if s and (below[b.path] or within and (b.parent in holders or b.tag in HEADINGS and over[b.parent]))]
    return "\n".join(kept), len(content)


def _extract(batches):
    import pyarrow as pa
    for batch in batches:
        texts, paths = zip(*[main_text(h) for h in batch.column(2).to_pylist()]) if batch.num_rows else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                                          pa.array(paths, pa.int32())], ["id", "url", "text", "n_chars", "content_paths"])


def extract_main(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points), content_paths. Pages stay in their
    partitions; nothing is shuffled."""
    bound_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    out = rows.mapInArrow(_extract, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long, content_paths int")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
