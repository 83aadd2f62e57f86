"""Operator 6: the container by its amount of text, forms, what is dropped within a block, and a second reader of whole pages."""

import re
from html.parser import HTMLParser

import pytest

from glyphlake.llm import html

MAIN = "<main><h1>Title</h1><div class='post-body'><p>Long body</p></div><section><article><h3>Teaser</h3></article></section></main>"


def text_of(page):
    found = html.blocks(page)
    level = html.container_of(found)
    return "\n".join(t for c, marked, t in found if c >= level and not marked)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (MAIN, "Title\nLong body\nTeaser"),
        ("<div id='content'><p>x</p><article>only</article><p>after</p></div>", "x\nonly\nafter"),
        ("<main><article><p>the longer text</p></article><p>small print</p></main>", "the longer text"),
        ("<form><nav>menu</nav><main><article><p>text</p><form>reply</form></article></main><p>no</p></form>", "text"),
        ("<form id='aspnet'><div class='content'><p>text</p></div></form>", "text"),
        ("<article><section class='social'><p>essay</p></section><div class='social'>no</div></article>", "essay"),
        ("<article><p>let <math><mi>x</mi></math> be</p></article>", "let x be"),
        ("<article><p>a <svg><text>z</text></svg> b</p><p>Press <button>OK</button> to go</p></article>", "a b\nPress to go"),
        ("<article><p>c<span style='color:red; display: none'>d</span>e</p><div style='DISPLAY:none'>no</div><p style='x-display:nonesuch'>f</p></article>", "ce\nf"),
        ("<article><p>a <button>x<p>y</button> b</p>c</article>", "a b\nc"),
        ("<article><p>a <select><option>1<option>2</select> b</p><p>a <button>never closed</p><p>next</p></article>", "a b\na\nnext"),
        ("", ""),
    ],
)
def test_pieces(page, want):
    assert text_of(page) == want


class Tree(HTMLParser):
    """A second reader, for pages whose elements are all closed: a tree first, then text by a walk over it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ("", {}, [])
        self.path = [self.root]

    def handle_starttag(self, tag, attrs):
        node = (tag, {k: v or "" for k, v in attrs}, [])
        self.path[-1][2].append(node)
        if tag not in html._VOID:
            self.path.append(node)

    def handle_endtag(self, tag):
        if tag in [n[0] for n in self.path]:
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.path[-1][2].append(data)


def walk(node, inside, gone, out):
    """out gets pieces of text and block ends as (container, text or None)."""
    for child in node[2]:
        if isinstance(child, str):
            out.append((inside, child, gone))
            continue
        name, attributes, _ = child
        mark, container = html._role(name, attributes, inside)
        block = name in html._BLOCKS
        if name == "br":
            out.append((inside, " ", gone))
        if block:
            out.append((inside, None, gone))
        if mark != html._NEVER and name not in html._RAW:
            walk(child, max(inside, container), gone or mark == html._FORM, out)
        if block:
            out.append((inside, None, gone))


def second_reading(page):
    tree = Tree()
    tree.feed(page)
    tree.close()
    out, blocks, parts = [], [], []
    walk(tree.root, 0, False, out)
    for container, text, gone in [*out, (0, None, False)]:
        if parts and (text is None or (container, gone) != parts[-1][::2]):
            joined = re.sub(r"\s+", " ", "".join(t for _, t, _ in parts)).strip()
            if joined and not parts[-1][2]:
                blocks.append((parts[-1][0], joined))
            parts = []
        if text is not None:
            parts.append((container, text, gone))
    amount = [sum(len(t) for c, t in blocks if c >= level) for level in range(3)]
    level = 0 if not amount[1] else 2 if 2 * amount[2] >= amount[1] else 1
    return "\n".join(t for c, t in blocks if c >= level)


def test_whole_pages_by_a_second_reader(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) > 20
    for r in rows:
        want = second_reading(r["html"])
        assert want and got[r["page_id"]] == (want, len(want)), r["page_id"]
