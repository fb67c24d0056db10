"""Main-text extraction with inferred wrappers.

The wrapper of a host (one for its pages with an element that says it holds the article, one for the
others) is a union-free regular expression over its pages' block tags: a tree whose
items are tags and text slots, each once, optional (?), repeated (+) or both (*). A page is first folded:
neighbouring blocks of one kind become a repeated group whose bodies are aligned with each other. Then its
children are aligned with the wrapper's by longest common subsequence: what both have is merged, what one
lacks becomes optional, text that differs becomes a slot and text that is always the same stays template text.

Every task merges the pages of each host it sees, and the tasks' wrappers (as large as a page layout, whatever
the number of pages) merge in two levels. The expression may place optional items differently when pages come in
another order, but what is decided for a slot depends on its path and on sums over all pages only, so
the text read is the same. Slots of the article are those inside the element that holds it, without
elements that mark menus, adverts and the like; text that never changes stays there.

Pages are then read once more and matched with their layout's expression: each block goes to the next item of its
kind, a repeated group may go back, and the text is what stands in the article's slots. Pages without
a host in their URL are of many sites; each is its own expression.

An element that is marked by its class is no mark when it holds the article: article and main elements, what
is around them, and whatever holds nearly all text of the page that is no link.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..runtime import Scratch
from . import common
from .url_terms import host_and_path

# Kinds of HTML elements.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "audio", "video", "select", "textarea", "button", "head", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
SCOPE = {"ul", "ol", "table", "dl", "select", "body", "html", "div", "article", "section", "main", "aside", "nav", "td", "th"}
# Elements and words in class, id or role that mark what is no article text.
NOT_TEXT = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "search"} | RAW
NOT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promoted promotion sidebar sidebars rail menu menus nav navbar navigation navigational "
    "breadcrumb breadcrumbs footer foot masthead topbar toolbar notice notices cookie cookies consent gdpr alert popup modal overlay comment comments commentlist reply replies respond disqus "
    "discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login paywall widget widgets pagination pager skip complementary contentinfo "
    "dialog search hidden".split())
# Words that only say where an element stands or what it is made of.
PLACES = set("top left right bottom site page list item items box block wrap wrapper container section bar area link links button buttons unit slot inner outer col row primary secondary global main first last".split())
HOLDERS = {"html", "body", "div", "section", "center", "table", "tbody", "tr", "td"}
MAIN_WORDS = {"article", "post", "entry", "story", "content", "main", "articlebody"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""", re.S)
MARKS = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
WORD = re.compile(r"[a-z]+")
BLANK = re.compile(r"\s+")
DEEPEST = 120  # elements below are read as part of the one at this depth; their texts are blocks as ever
NEARLY_ALL = 0.9


def is_mark(name: str) -> bool:
    """Whether a whole class name says that its element is no article text: its words are all marks, or marks and names of places."""
    words = WORD.findall(name)
    return any(w in NOT_WORDS for w in words) and all(w in NOT_WORDS or w in PLACES for w in words)


def label_of(tag: str, attributes: str) -> str:
    """Tag and the first six words of its class, id and role, without numbers, and those that say it holds the article; ``!`` marks what is no article text."""
    words, bad = [], tag in NOT_TEXT
    if attributes and ("=" in attributes or "hidden" in attributes.lower()):
        for name, value in MARKS.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                words.append("hidden")
                bad = True
            elif name in ("class", "id", "role", "itemprop"):
                words += WORD.findall(value)
                bad = bad or any(is_mark(x) for x in value.split())
    words = sorted(set(words))
    bad = bad and tag not in ("html", "body", "article", "main")
    return ("!" if bad else "") + tag + ("." + ".".join(words[:6] + [w for w in words[6:] if w in MAIN_WORDS]) if words else "")


class Block:
    """One run of text between block borders: the labels of its elements, its text, and how much of it are links."""

    __slots__ = ("path", "text", "links")

    def __init__(self, text: str, links: int) -> None:
        self.path, self.text, self.links = (), text, links


def parse(page: str) -> tuple[list, list[Block]]:
    """The tree of block elements, [label, children] with text leaves as Block, and the blocks in order."""
    root: list = ["", []]
    stack: list[tuple[str, list]] = [("", root)]
    held: list[str] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        if held:
            text = BLANK.sub(" ", "".join(held)).strip()
            if text:
                stack[-1][1][1].append(Block(text, min(links, len(text))))
            held.clear()
            links = 0

    def close(tag: str, within: set[str] = frozenset()) -> bool:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                flush()
                del stack[k:]
                return True
            if stack[k][0] in within:
                return False
        return False

    def down(tag: str, label: str) -> None:
        node = stack[-1][1]
        if len(stack) <= DEEPEST:
            node[1].append(below := [label, []])
            node = below
        stack.append((tag, node))

    def marked(tag: str) -> int | None:
        """Place of the innermost open inline element of that tag on the stack (only marked ones are there); p ends with it, other blocks hold it open."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                return k
            if stack[k][0] not in INLINE and stack[k][0] != "p":
                return None
        return None

    def close_inline(tag: str) -> None:
        k = marked(tag)
        if k is not None and nested.get(k):
            nested[k] -= 1
        elif k is not None:
            flush()
            del stack[k:]

    nested: dict[int, int] = {}  # by place on the stack: plain inline elements of the same tag open inside a marked one
    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text:
            text = entities.unescape(text)
            held.append(text)
            links += len(text) if in_link else 0
        if not m:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        tag, end = m.group(2).lower(), m.group(1)
        if end:
            if tag == "a":
                in_link = 0
            if tag in INLINE:
                close_inline(tag)
            elif tag != "br":
                if tag == "p" and not any(t == "p" for t, _ in stack):
                    flush()
                else:
                    close(tag)
            continue
        if tag in RAW and tag != "head":
            if not m.group(3).endswith("/>"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
                if not stop:
                    break
                at = page.find(">", stop.end())
                if at < 0:
                    break
                at += 1
            if tag not in INLINE:
                flush()
            continue
        if tag == "a":
            close_inline("a")  # links do not nest
            in_link = 1
        if tag in INLINE:
            words = label_of(tag, m.group(3))
            if not words.startswith("!"):
                if (k := marked(tag)) is not None:
                    nested[k] = nested.get(k, 0) + 1
                continue
            # an inline element that marks an advert or the like is cut out as a block of its own
            flush()
            nested[len(stack)] = 0
            down(tag, words)
            continue
        flush()
        if tag == "br" or tag in VOID:
            continue
        if any(t == "p" for t, _ in stack):
            close("p", SCOPE)
        for other in CLOSES.get(tag, ()):
            close(other, SCOPE)
        if tag == "body":
            close("head")
        down(tag, label_of(tag, m.group(3)))
    flush()
    protect(root)
    return root, blocks_of(root)


def _weigh(root: list) -> list[tuple[list, int, bool]]:
    """Each element, the element before its children, with its text that is no link and whether it is or holds an article or main element."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node[1] if not isinstance(c, Block)]
    weight: dict[int, tuple[int, bool]] = {}
    for node in reversed(order):
        own = sum(max(0, len(c.text) - c.links) for c in node[1] if isinstance(c, Block))
        below = [weight[id(c)] for c in node[1] if not isinstance(c, Block)]
        holds = node[0].split(".")[0] in ("article", "main") and own + sum(w for w, _ in below) > 0
        weight[id(node)] = own + sum(w for w, _ in below), holds or any(h for _, h in below)
    return [(node, *weight[id(node)]) for node in order]


def protect(root: list) -> None:
    """Take the mark off elements that hold the article: an article or main element with most of their text, or nearly all text of the page."""
    weighed = _weigh(root)
    total = weighed[0][1]
    for node, text, holds in weighed:
        if node[0].startswith("!") and text and (text >= NEARLY_ALL * total or holds and 2 * text >= total):
            node[0] = node[0][1:]


def blocks_of(root: list) -> list[Block]:
    """The blocks in page order, with the labels of their elements."""
    out, todo = [], [(root, ())]
    while todo:
        node, path = todo.pop()
        if isinstance(node, Block):
            node.path = path
            out.append(node)
        else:
            below = (*path, node[0]) if node is not root else ()
            todo += [(c, below) for c in reversed(node[1])]
    return out


# A wrapper item: [label, occurs, children, stats]. occurs: "1", "?", "+", "*". A text slot has label "#" and stats
# [pages' characters, link characters, constant text or None, sightings]; an element has stats [sightings].

def item(node) -> list:
    if isinstance(node, Block):
        return ["#", "1", [], [len(node.text), node.links, node.text if len(node.text) <= 200 else None, 1]]
    return [node[0], "1", fold([item(c) for c in node[1]]), [1]]


def fold(children: list[list]) -> list[list]:
    """Neighbours of one kind become a repeated group, then alternations of two or three kinds."""
    out: list[list] = []
    for c in children:
        if out and out[-1][0] == c[0]:
            out[-1] = repeated(merge(out[-1], c, same_page=True))
        else:
            out.append(c)
    for width in (2, 3):
        k = 0
        while k + 2 * width <= len(out):
            if all(out[k + i][0] == out[k + width + i][0] for i in range(width)):
                out[k:k + 2 * width] = [repeated(merge(out[k + i], out[k + width + i], same_page=True)) for i in range(width)]
            else:
                k += 1
    return out


def repeated(x: list) -> list:
    return [x[0], {"1": "+", "?": "*"}.get(x[1], x[1]), x[2], x[3]]


def optional(x: list) -> list:
    return [x[0], {"1": "?", "+": "*"}.get(x[1], x[1]), x[2], x[3]]


def occurs(a: str, b: str) -> str:
    many, none = bool({a, b} & {"+", "*"}), bool({a, b} & {"?", "*"})
    return "*" if many and none else "+" if many else "?" if none else "1"


def merge(a: list, b: list, same_page: bool = False) -> list:
    """The least general item that has both: equal text stays, other text becomes a slot, children are aligned."""
    if a[0] == "#":
        text = a[3][2] if a[3][2] == b[3][2] else None
        return ["#", occurs(a[1], b[1]), [], [a[3][0] + b[3][0], a[3][1] + b[3][1], text, max(a[3][3], b[3][3]) if same_page else a[3][3] + b[3][3]]]
    seen = max(a[3][0], b[3][0]) if same_page else a[3][0] + b[3][0]
    return [a[0], occurs(a[1], b[1]), align(a[2], b[2], same_page), [seen]]


def align(a: list[list], b: list[list], same_page: bool = False) -> list[list]:
    """Longest common subsequence of labels; unmatched items become optional."""
    n, m = len(a), len(b)
    if n == m and all(x[0] == y[0] for x, y in zip(a, b)):
        return [merge(x, y, same_page) for x, y in zip(a, b)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i][0] == b[j][0]:
            out.append(merge(a[i], b[j], same_page))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    out += [optional(x) for x in a[i:]] + [optional(x) for x in b[j:]]
    joined: list[list] = []
    for x in out:  # neighbours of one kind after the merge are one repeated group
        if joined and joined[-1][0] == x[0]:
            joined[-1] = repeated(merge(joined[-1], x, True))
        else:
            joined.append(x)
    return joined


def regex(x: list) -> str:
    """The wrapper as a union-free regular expression, for people."""
    mark = "" if x[1] == "1" else x[1]
    if x[0] == "#":
        return (json.dumps(x[3][2]) if x[3][2] is not None and x[3][3] > 1 else "#PCDATA") + mark
    inner = " ".join(regex(c) for c in x[2])
    tag = x[0].lstrip("!")
    return inner if not tag else f"(<{tag}> {inner} </{tag}>){mark}" if mark else f"<{tag}> {inner} </{tag}>"


def article(path: tuple[str, ...]) -> int:
    """Depth of the outermost element that says it holds the article; 0 if none does."""
    for tags in (("article",), ("main",)):
        for k, w in enumerate(path):
            if w.split(".")[0] in tags:
                return k + 1
    for k, w in enumerate(path):
        if MAIN_WORDS & set(w.split(".")[1:]) and w.split(".")[0] not in ("html", "body"):
            return k + 1
    return 0


def layout(blocks: list[Block]) -> int:
    """1 for a page with an element that says it holds the article and has text there that is no link, 0 for others."""
    return int(any(b.links < len(b.text) and article(b.path) and not any(w.startswith("!") for w in b.path) for b in blocks))


def rules(wrapper: list) -> list:
    """The expression as far as a page is matched with it: [label, whether it is a slot of the article, children]."""
    slots: list[tuple[tuple[str, ...], list]] = []

    def walk(x: list, path: tuple[str, ...]) -> None:
        for c in x[2]:
            if c[0] == "#":
                slots.append((path, c))
            else:
                walk(c, (*path, c[0]))

    walk(wrapper, ())
    # sums by path are the same whatever the order in which pages were aligned
    text: dict[tuple[str, ...], list[int]] = {}
    for p, s in slots:
        if not any(w.startswith("!") for w in p):
            held = text.setdefault(p, [0, 0])
            held[0] += s[3][0]
            held[1] += s[3][1]
    weight: dict[tuple[str, ...], int] = {}
    for p, (chars, links) in text.items():
        if k := article(p):
            weight[p[:k]] = weight.get(p[:k], 0) + chars - links
    if any(w > 0 for w in weight.values()):
        keep = {p for p in text if article(p) and weight[p[:article(p)]] > 0}
    else:
        # no element says so: go down from the root while one child holds nearly all text that is no link
        top: tuple[str, ...] = ()
        while True:
            own: dict[tuple[str, ...], int] = {}
            total = 0
            for p, (chars, links) in text.items():
                if p[:len(top)] == top:
                    rest = max(0, chars - links)
                    total += rest
                    if len(p) > len(top):
                        own[p[:len(top) + 1]] = own.get(p[:len(top) + 1], 0) + rest
            best = max(own, key=lambda k: (own[k], k), default=())
            if not best or not total or own[best] < NEARLY_ALL * total or best[-1].split(".")[0] not in HOLDERS:
                break
            top = best
        keep = {p for p, (chars, links) in text.items() if p[:len(top)] == top and 2 * links <= chars}

    def cut(x: list, path: tuple[str, ...]) -> list:
        return [[c[0], int(path in keep), []] if c[0] == "#" else [c[0], 0, cut(c, (*path, c[0]))] for c in x[2]]

    return cut(wrapper, ())


def matched(root: list, rule: list) -> list[str] | None:
    """Texts of a page in the article's slots of the expression; None if the page is no match.

    Children of an element go through its items in order: each to the next item of its kind, or, where a repeated
    group begins again, to the first one.
    """
    out: list[str] = []
    todo: list[tuple[list, list]] = [(root, rule)]
    while todo:
        node, items = todo.pop()
        if isinstance(node, Block):
            if items[1]:
                out.append(node.text)
            continue
        at, found = 0, []
        for child in node[1]:
            label = "#" if isinstance(child, Block) else child[0]
            here = next((i for i in range(at, len(items)) if items[i][0] == label), None)
            if here is None:
                here = next((i for i in range(at) if items[i][0] == label), None)
            if here is None:
                return None
            at = here
            found.append((child, items[here] if label == "#" else items[here][2]))
        todo += reversed(found)
    return out


def article_text(page: str, known: dict[str, list] | None) -> str:
    """The page matched with the expression of its host's layout, article slots joined by line ends.

    A page that is no match, or has nothing in the article's slots, is built in another way: its own expression says what to take.
    """
    root, blocks = parse(page)
    rule = known.get(str(layout(blocks))) if known else None
    texts = matched(root, rule) if rule is not None else None
    return "\n".join(texts or matched(root, rules(item(root))))


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    return ("" if t is None else t for t in batch.column("html").to_pylist())


HELD_HOSTS = 2000
BROADCAST_CHARS = 16 << 20  # rules of all hosts that go to every task; beyond, they are joined


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host and layout of the task."""
    held: dict[tuple[str, int], list] = {}

    def emit():
        return pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in held], pa.string()), pa.array([k for _, k in held], pa.int32()), pa.array([json.dumps(w) for w in held.values()], pa.string())],
            names=["host", "layout", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), _texts(batch)):
            if not host:
                continue
            root, blocks = parse(page)
            own, key = item(root), (host, layout(blocks))
            held[key] = merge(held[key], own) if key in held else own
            if len(held) > HELD_HOSTS:
                yield emit()
                held = {}
    if held:
        yield emit()


def _merge_all(table: pa.Table) -> list:
    out = None
    for w in sorted(table.column("wrapper").to_pylist()):
        out = json.loads(w) if out is None else merge(out, json.loads(w))
    return out


def _merge_some(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    return pa.table({"host": [key[0].as_py()], "layout": pa.array([key[1].as_py()], pa.int32()), "wrapper": [json.dumps(_merge_all(table))]})


def infer(pages: DataFrame) -> DataFrame:
    """(host, layout, wrapper as JSON): the wrapper of each layout of a host, from all its pages (host, html)."""
    schema = "host string, layout int, wrapper string"
    some = pages.select("host", "html").mapInArrow(_infer, schema).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(64)))
    part = some.groupBy("host", "layout", "salt").applyInArrow(_merge_some, schema)
    return part.groupBy("host", "layout").applyInArrow(_merge_some, schema)


@F.pandas_udf(T.StringType())
def _rules(wrapper: pd.Series) -> pd.Series:
    return wrapper.map(lambda w: json.dumps(rules(json.loads(w))))


EXTRACT_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for batch in batches:
        texts = []
        for raw, page in zip(batch.column("rules").to_pylist(), _texts(batch)):
            both = known.get(raw)
            if both is None and raw is not None:
                got = json.loads(raw)
                if len(known) > HELD_HOSTS:
                    known.clear()
                both = known[raw] = {kind: json.loads(rule) for kind, rule in got.items()}
            texts.append(article_text(page, both))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.string())], schema=EXTRACT_ROW)


def extract(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    The host is what stands after ``://`` in the URL; a page without one is its own wrapper. A host has a wrapper for its pages
    with an element that says it holds the article, and one for those without. Null html is empty. A page
    whose blocks are all left out has an empty text.
    """
    scratch = scratch or Scratch(pages.sparkSession, "wrappers")
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    known = infer(rows).select("host", F.col("layout").cast("string").alias("layout"), _rules("wrapper").alias("rules"))
    known = known.groupBy("host").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("layout", "rules")))).alias("rules"))  # two layouts at most
    known = scratch.cut(known, "rules")
    few = (known.agg(F.sum(F.length("rules"))).first()[0] or 0) <= BROADCAST_CHARS
    read = rows.join(F.broadcast(known) if few else known, "host", "left").select("page_id", "url", "html", "rules")
    return read.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
