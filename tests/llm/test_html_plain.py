"""Main text against a slow, plain version (html.parser, a tree, sets of ancestors), and on broken and hostile pages."""

import time
from html.parser import HTMLParser

import pytest

from eventloom.llm import html_paths as H
from eventloom.llm import queries

SF = "/root/testdata/sf0.01"


class Node:
    def __init__(self, tag="", attributes=(), parent=None):
        self.tag, self.parent, self.kids = tag, parent, []
        text = "".join(f' {k}="{v}"' for k, v in attributes if v is not None)
        self.step, self.marked = H._read_step(tag, text)
        self.marked = (self.marked or tag == "form") and tag not in H.UNMARKED

    def line(self):
        """From the page down to this node."""
        return (self.parent.line() if self.parent else []) + [self]


class Tree(HTMLParser):
    """Well-formed pages only: a tree with the rules of left-out end tags."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node()
        self.raw = None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attributes):
        if self.raw:
            return
        if tag in H.RAW:
            self.raw = tag
            return
        block = next(n for n in reversed(self.at.line()) if n.tag not in H.INLINE)
        if tag not in H.INLINE and (tag in H.CLOSES_P and block.tag == "p" or block.tag in H.CLOSES.get(tag, ())):
            self.at = block.parent
        elif tag not in H.INLINE and tag not in H.QUIET:
            self.at = block
        node = Node(tag, attributes, self.at)
        self.at.kids.append(node)
        if tag not in H.VOID:
            self.at = node

    def handle_endtag(self, tag):
        if self.raw:
            self.raw = None if tag == self.raw else self.raw
        elif tag in H.INLINE:
            if self.at.tag == tag:
                self.at = self.at.parent
        elif any(n.tag == tag for n in self.at.line()):
            while self.at.tag != tag:
                self.at = self.at.parent
            self.at = self.at.parent

    def handle_data(self, data):
        if not self.raw:
            self.at.kids.append(data)


def plain_blocks(root):
    """[block elements around, parts (text, marked inline element), number of inline tags]"""
    out, now = [], None

    def walk(node, around, mark):
        nonlocal now
        for kid in node.kids:
            if isinstance(kid, str):
                now = now or (around, [], [0])
                now[1].append((kid, mark))
            elif kid.tag in H.INLINE:
                now = now or (around, [], [0])
                now[2][0] += 1
                if kid.tag == "br":
                    now[1].append((" ", mark))
                walk(kid, around, mark or (kid if kid.marked else None))
            elif kid.tag not in H.QUIET:
                for _ in range(2):
                    if now:
                        out.append(now)
                    now = None
                    if kid.tag not in H.SKIPPED and _ == 0:
                        walk(kid, [*around, kid], None)
    walk(root, [], None)
    return out + ([now] if now else [])


def plain_content(found):
    paths = {p: [b for b in found if b["path"] == p] for p in {b["path"] for b in found}}
    score = {p: 0.0 for p in paths}
    for side in ([b for b in found if b["named"]], [b for b in found if not b["named"]]):
        ratios = []
        for b in side:
            same = paths[b["path"]]
            ratios.append((sum(len(x["text"]) for x in same) / sum(1 + x["tags"] for x in same),
                           (1 + sum(len(H.PUNCTUATION.findall(x["text"])) for x in same)) / len(same)))
        for i, b in enumerate(side):
            near = ratios[max(0, i - H.WINDOW):i + H.WINDOW + 1]
            x, y = (max(sum(r[k] for r in near) / len(near), ratios[i][k]) for k in (0, 1))
            score[b["path"]] = max(score[b["path"]], x * y)
    mean = sum(score.values()) / len(score)
    return {p for p, s in score.items() if s >= H.THRESHOLD * (sum((x - mean) ** 2 for x in score.values()) / len(score)) ** 0.5}


def plain_text(html):
    found = []
    for around, parts, tags in plain_blocks(Tree(html).root):
        text = " ".join("".join(x for x, _ in parts).split())
        if text:
            steps = tuple(n.step for n in around)
            found.append({"path": steps, "parent": steps[:-1], "tag": around[-1].tag if around else "", "parts": parts, "tags": tags[0], "text": text,
                          "around": around, "named": {n for n in around if n.tag in H.NAMED}, "marks": {n for n in around if n.marked}})
    if not found:
        return ""
    content = plain_content(found)
    rich = [b for b in found if b["path"] in content]
    total = sum(len(b["text"]) for b in rich)
    articles = {n for b in rich for n in b["named"]}

    def ruled_out(mark, blocks, text):
        """blocks: those of the mark. An article with content that has no block with it in common decides."""
        return 2 * text <= total or any(not any(a in b["named"] for b in blocks) for a in articles)

    for b in found:
        own = {m for _, m in b["parts"] if m}
        out = {m for m in own if ruled_out(m, [b], sum(len(x) for x, y in b["parts"] if y is m) if b in rich else 0)}
        b["kept"] = " ".join("".join(x for x, m in b["parts"] if m not in out).split())
    gone = {m for m in {m for b in found for m in b["marks"]}
            if ruled_out(m, [b for b in found if m in b["marks"]], sum(len(b["text"]) for b in rich if m in b["marks"]))}
    found = [dict(b, text=b["kept"]) for b in found if b["kept"] and not b["marks"] & gone]
    if not found:
        return ""
    content = plain_content(found)
    rich = [b for b in found if b["path"] in content]
    articles = {n for b in rich for n in b["named"]}

    def stays(b):
        if any(b["path"][:k] in content for k in range(len(b["path"]) + 1)):
            return True
        if articles and not b["named"] & articles:
            return False
        same = [x for x in found if x["parent"] == b["parent"]]
        holder = 2 * sum(len(x["text"]) for x in same if x in rich) > sum(len(x["text"]) for x in same)
        return holder or b["tag"] in H.HEADINGS and any(x["parent"][:len(b["parent"])] == b["parent"] for x in rich)
    return "\n".join(b["text"] for b in found if stays(b))


def test_every_page_equals_the_plain_version(spark):
    pages = {r["page_id"]: r["html"] for r in queries.table(spark, SF, "pages").collect()}
    got = queries.op1_html_paths(spark, SF).collect()
    assert len(got) == len(pages) > 100
    for r in got:
        assert r["text"] == plain_text(pages[r["page_id"]] or "") and r["n_chars"] == len(r["text"])


SENTENCE = "The first sentence of this text is rather long, as it has commas, too; it goes on and on. "
BODY = "".join(f"<p>{SENTENCE * 3}{k}</p>" for k in range(3))
WANT = "\n".join(f"{SENTENCE * 3}{k}" for k in range(3))
SIDE = f"<p>{SENTENCE}</p><p>{SENTENCE}</p>"
NAMES = ["comment-list", "user-comments", "cookie-bar", "sidebar-left", "ad-box", "related-posts", "userComments", "post__comments", "newsletter_signup",
         "site-header", "comments", "AdBanner"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("shape", ["<article>{b}</article>{s}", "<article>{b}{s}</article>", "<div class=post>{b}{s}</div>", "<main>{s}{b}</main>"])
def test_names_that_mark(name, shape):
    page = "<html><body>" + shape.format(b=BODY, s=f'<div class="{name}">{SIDE}</div>') + "</body></html>"
    assert H.main_text(page)[0] == WANT == plain_text(page)


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "with-ads", "content", "page-header-less", "entry-header", "readable", "search-results"])
def test_names_that_do_not_mark(name):
    for page in (f'<body><div class="{name}">{BODY}</div></body>', f'<body class="{name}"><article class="{name}">{BODY}</article></body>'):
        assert H.main_text(page)[0] == WANT == plain_text(page)


def test_a_mark_on_most_of_the_text_does_not_count():
    page = f'<body><div class="sidebar-wrap">{BODY}</div><div class="footer-links"><a href=x>a</a></div></body>'
    assert H.main_text(page)[0] == WANT == plain_text(page)


def test_a_page_within_a_form():
    page = f'<body><form action=x><input name=q><select><option>One<option>Two</select>{BODY}<button>Send</button><label>Name</label></form></body>'
    assert H.main_text(page)[0] == WANT
    page = f"<body><article>{BODY}</article><form><p>{SENTENCE}</p><button>Send</button></form></body>"
    assert H.main_text(page)[0] == WANT == plain_text(page)


@pytest.mark.parametrize("piece, shown", [
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "x=2"), ("<svg><path d='M0'/><text>no</text></svg>", ""), ("<button><div>Copy</div></button>", ""),
    ("<label>Tick <input type=checkbox></label>", ""), ("<script>var a = '<p>';</script>", ""), ("<style>p > b {}</style>", ""),
    ("<select><option>a<option>b</select>", ""), ("<video><p>No player</p></video>", "")])
def test_inline_parts_do_not_cut_a_block(piece, shown):
    page = f"<body><div><p>{SENTENCE}Before {piece} behind. {SENTENCE}</p>{BODY}</div></body>"
    first = " ".join(f"{SENTENCE}Before {shown} behind. {SENTENCE}".split())
    assert H.main_text(page)[0].split("\n")[0] == first


def test_quotes():
    for tag in ("<p title=Don't>", "<p class=\"a>", "<p title='it\"s'>", "<p data-x=\"a > b\">", "<p a=\"x\"b='y'>", "<p a = \"x\" b>", "<p \">", "<p a='>"):
        page = f"<body><div>{tag}{SENTENCE * 3}</p><p>{SENTENCE * 3}it's</p><p class=\"b\">{SENTENCE * 3}</p></div></body>"
        lines = H.main_text(page)[0].split("\n")
        assert lines == [(SENTENCE * 3).strip(), f"{SENTENCE * 3}it's", (SENTENCE * 3).strip()], tag


def test_broken_tags():
    assert H.main_text(f"<p>{SENTENCE} if a <b and c</p>")[0].startswith(SENTENCE)
    assert H.main_text(f"<p>{SENTENCE}<a href='x")[0] == SENTENCE.strip()
    assert H.main_text(f"<p>{SENTENCE}1 < 2 <3 </ p> x")[0] == f"{SENTENCE}1 < 2 <3 x"
    assert H.main_text(f"<body><label>Name <p>{SENTENCE}</body>")[0] == SENTENCE.strip()
    assert H.main_text("<p>&lt;b&gt; &amp;amp; &#x41;&nbsp;\t b</p>")[0] == "<b> &amp; A b"


HOSTILE = {
    "names": "<a" * 500_000, "depth": "<div>a" * 40_000, "marks": "<div class=ad>a" * 40_000, "quotes": '<a b="<a b=" ' * 80_000 + 'b=">"', "singles": "<a b=' " * 150_000,
    "comments": "<!--" * 250_000, "scripts": "<script>" + "</script" * 120_000, "ends": "<div>" * 100_000 + "</p>" * 100_000, "mixed": "<a " + "b='x\" " * 150_000 + ">",
    "inline": "<p>" + "<span class=ad>x" * 60_000, "attributes": "<p " + "class='a b c' " * 70_000 + ">x", "controls": "<label>" * 150_000, "forms": "<form>" * 100_000 + "x",
    "articles": "<article>a<article class=ad>b" * 30_000, "steps": "".join(f"<div id=a{i}>x" for i in range(30_000)),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    page = HOSTILE[name]

    def seconds(html):
        start = time.process_time()
        H.main_text(html)
        return time.process_time() - start
    whole = min(seconds(page) for _ in range(2))
    assert whole < 4 * len(page) / 1e6 + 2
