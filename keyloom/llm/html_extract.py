"""HTML extraction by wrapper induction.

For each host, a few pages (those of the smallest hashes) are parsed. Those of
one layout (the same elements near the root) are aligned to the first of them
by simple tree matching, from the root down. Text at aligned nodes that is the
same on most pages is template; nodes whose text differs, or that have no
partner, are slots. The wrapper of a host is its template and, for each layout,
the path of the element that holds the slots; it is then applied to every page
of it. Hosts of one page share a wrapper, induced from a few of their pages.

Menus, headers, footers, asides, forms and the like, marked by tag, role, class
or id, are neither template nor slots. What is left within the holder, without
the template, is content. Markup alone decides on a page without any of the
wrapper's paths, and where there is no wrapper.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Pages of a host that its wrapper is induced from; pages that must share a text, at least, and their share; levels that tell layouts apart.
SAMPLE, LEAST, SHARE, LEVELS = 12, 3, 0.7, 3
#: Stands for the hosts of one page; no host has this name.
LONE = "/"

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"'>]+)")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}
#: An element that its like ends, and what keeps it open.
_ALIKE = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_DROPPED = set("head script style noscript template iframe nav footer aside form button select input textarea dialog menu svg canvas object embed audio video map title link meta xmp noembed noframes".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note status".split())
_NAMES = set(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist disqus replies respond widget widgets toolbar pagination pager paywall login searchbox skiplink".split()
)
#: What may stand beside such a word in the name of a part that isn't content.
_BESIDE = set("site main page global top bottom left right box block bar list item items wrap wrapper container area section panel inner outer link links button buttons icons posts stories articles thread form primary secondary user slot unit".split())


_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("children", "drop", "label", "tag")

    def __init__(self, tag: str, drop: bool = False, attributes: str = ""):
        self.tag, self.drop, self.children = tag, drop, []
        self.label = tag + _names(attributes) if attributes else tag


def _names(attributes: str) -> str:
    """Class and id for a path, without digits, which tend to number pages."""
    found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes) if m[1]]
    return "".join(f".{re.sub(r'[^a-z]+', '-', v.lower())}" for k, v in sorted(found) if k in ("class", "id"))


def _is_boilerplate(tag: str, attributes: str) -> bool:
    if tag in _DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main") and "class" not in attributes and "id" not in attributes and "hidden" not in attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name = (m[1] or m[5]).lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and tag not in ("html", "body", "main") and not (name == "id" and tag in _HEADINGS):
            for one in value.split():  # a name counts as a whole: notice and site-notice, but neither notice-board nor related-work
                words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower()))
                if words & _NAMES and words <= _NAMES | _BESIDE and not (tag == "article" and "header" in words):
                    return True
        elif name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _tokens(source: str):
    """(text before it, slash, name, attributes, end) of each tag; of comments and the like slash is None, and a name is [ for CDATA. In linear time:

    a quote that isn't closed before the source ends hides no tags, here or further on.
    """
    at, begin, quotes = 0, 0, True
    while True:
        m = _OPEN.search(source, at)
        if not m:
            yield source[begin:], None, None, "", len(source)
            return
        i = m.start()
        if source.startswith("<!--", i):
            end = source.find("-->", i + 4)
            end = len(source) if end < 0 else end + 3
            begin, at = (yield source[begin:i], None, "", "", end) or end, end
            continue
        if source.startswith("<![CDATA[", i):
            end = source.find("]]>", i + 9)
            stop, end = (len(source), len(source)) if end < 0 else (end, end + 3)
            begin, at = (yield source[begin:i], None, "[", source[i + 9 : stop], end) or end, end
            continue
        tag = _TAG.match(source, i + 1)
        if not tag and source[i + 1] == "/":
            at = i + 1  # not a tag
            continue
        end = k = tag.end() if tag else i + 1
        while tag and quotes:
            stop = _STOP.search(source, k)
            if not stop:
                quotes = False
            elif stop[0] == ">":
                end = stop.start()
                break
            else:
                k = source.find(stop[0], stop.end()) + 1
                quotes = k > 0
        else:
            end = source.find(">", end)
            if end < 0:
                yield source[begin:], None, None, "", len(source)
                return
        if tag:
            begin = (yield source[begin:i], tag[1], tag[2].lower(), source[tag.end() : end], end + 1) or end + 1
        else:
            begin = (yield source[begin:i], None, "", "", end + 1) or end + 1
        at = begin


def parse(source: str) -> Node:
    """A tree of a page, however broken: unclosed and stray tags are mended as browsers mostly do."""
    root = Node("#root")
    stack, tokens, jump = [root], _tokens(source), None
    while True:
        text, slash, tag, attributes, end = tokens.send(jump)
        jump = None
        if text:
            stack[-1].children.append(entities.unescape(text) if "&" in text else text)
        if tag is None:
            return root
        if slash is None:
            if tag == "[":
                stack[-1].children.append(attributes)
            continue
        if slash:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "td", "th", "table", "body") and tag not in ("article", "main", "table", "tr", "tbody", "body", "html", "td", "th"):
                    break
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK:
                    break
        elif tag in _ALIKE:
            alike, until = _ALIKE[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in alike:
                    del stack[k:]
                    break
                if stack[k].tag in until:
                    break
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        node = Node(tag, _is_boilerplate(tag, attributes), attributes)
        stack[-1].children.append(node)
        if tag in _RAW:
            found = _RAW[tag].search(source, end)
            jump = found.end() if found else len(source)
        elif tag not in _VOID and not (attributes.endswith("/") and tag in ("svg", "path")):
            stack.append(node)  # a slash means nothing on other elements


def joined(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _containers(root: Node) -> list[Node]:
    """The outermost article elements that aren't dropped, else the main ones."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        x = todo.pop()
        if x.drop or x.tag == "header":
            continue
        if x.tag in found:
            found[x.tag].append(x)
        if x.tag != "article":
            todo.extend(c for c in reversed(x.children) if not isinstance(c, str))
    return found["article"] or found["main"]


def step(path: int, label: str) -> int:
    """A path of labels as a number: that of the element above it, and its own label."""
    return xxhash.xxh3_64_intdigest(label, path)


def path_of(*labels: str) -> int:
    return reduce(step, labels, 0)


def _inside(x: Node, inside: bool) -> bool:
    return inside or x.tag in ("article", "main")


def _blocks(root: Node, path: int) -> list[tuple[int, str]]:
    """(path, text) of the innermost blocks of a page, or of a part with a path, without dropped parts. Without recursion: trees may be deep."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    paths = [path]

    def flush() -> None:
        text = joined(parts)
        if text:
            out.append((paths[-1], text))
        parts.clear()

    todo: list = [(c, _inside(root, False)) for c in reversed(root.children)]
    while todo:
        x, inside = todo.pop()
        if x is None:
            flush()
            paths.pop()
        elif isinstance(x, str):
            parts.append(x)
        elif x.tag == "br":
            parts.append(" ")
        elif not (x.drop or x.tag == "header" and not inside):
            if x.tag in _BLOCK:
                flush()
                paths.append(step(paths[-1], x.label))
                todo.append((None, inside))
            todo.extend((c, _inside(x, inside)) for c in reversed(x.children))
    flush()
    return out


class Shape:
    """A tree of blocks for alignment, without dropped parts: tag, path, depth, own texts around the children, children, a number of the whole."""

    __slots__ = ("children", "depth", "parts", "path", "tag", "text", "whole")

    def __init__(self, tag: str, path: int, depth: int):
        self.tag, self.path, self.depth, self.children = tag, path, depth, []

    @classmethod
    def of(cls, root: Node) -> Shape:
        top = cls(root.tag, step(0, root.label), 0)
        todo, order = [(root, top, False)], []
        while todo:
            node, s, inside = todo.pop()
            inside, own, inner = _inside(node, inside), [[]], list(reversed(node.children))
            order.append(s)
            while inner:
                c = inner.pop()
                if isinstance(c, str):
                    own[-1].append(c)
                elif c.drop or c.tag == "header" and not inside:
                    continue
                elif c.tag == "br":
                    own[-1].append(" ")
                elif c.tag not in _BLOCK:  # what is inline belongs to the block around it
                    inner.extend(reversed(c.children))
                else:
                    s.children.append(cls(c.tag, step(s.path, c.label), s.depth + 1))
                    todo.append((c, s.children[-1], inside))
                    own.append([])
            s.parts = [t for t in map(joined, own) if t]
            s.text = " ".join(s.parts)
        for s in reversed(order):  # children before parents
            s.whole = hash((s.tag, s.text, *(c.whole for c in s.children)))
        return top


def _weights(x: list[Shape], y: list[Shape]) -> np.ndarray:
    """tag, own text and whole of two lists of nodes as numbers: (3, nodes of both)."""
    out = []
    for value in (lambda s: s.tag, lambda s: s.text, lambda s: s.whole):
        of: dict = {}
        out.append([of.setdefault(value(s), len(of)) for s in (*x, *y)])
    return np.array(out, np.int64).reshape(3, -1)


def _last_row(c: np.ndarray, d: np.ndarray, full: np.ndarray) -> np.ndarray:
    """The greatest weights of pairs of all of c with the beginnings of d."""
    best = np.zeros(d.shape[1] + 1, np.int64)
    for i in range(c.shape[1]):
        tag = c[0, i] == d[0]
        w = tag * (1 + (full[i] & (c[1, i] == d[1])) + (c[2, i] == d[2]))
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + w))
    return best


def _pairs(x: list[Shape], y: list[Shape]) -> list[tuple[Shape, Shape]]:
    """The pairs of two lists that keep order with the greatest weight, in space that grows with the lists' lengths alone (halved again and again)."""
    if not x or not y:
        return []
    numbers = _weights(x, y)
    c, d, full = numbers[:, : len(x)], numbers[:, len(x) :], np.array([bool(s.text) for s in x])
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, e, f = todo.pop()
        if a == b or e == f:
            continue
        if b - a == 1:
            w = (c[0, a] == d[0, e:f]) * (1 + (full[a] & (c[1, a] == d[1, e:f])) + (c[2, a] == d[2, e:f]))
            if w.max():
                out.append((x[a], y[e + int(np.argmax(w))]))
            continue
        half = (a + b) // 2
        before = _last_row(c[:, a:half], d[:, e:f], full[a:half])
        after = _last_row(c[:, half:b][:, ::-1], d[:, e:f][:, ::-1], full[half:b][::-1])[::-1]
        cut = e + int(np.argmax(before + after))
        todo += [(half, b, cut, f), (a, half, e, cut)]
    return out


def align(a: Shape, b: Shape) -> list[tuple[Shape, Shape]]:
    """Simple tree matching from the roots down: pairs of nodes of equal tags that keep order and ancestry.

    The children of a pair are paired with the greatest weight: one for equal
    tags, one more for equal own texts, and one for equal subtrees.
    """
    out = [(a, b)]
    for x, y in out:
        out.extend(_pairs(x.children, y.children))
    return out


def _nodes(x: Shape) -> list[Shape]:
    out = [x]
    for s in out:
        out.extend(s.children)
    return out


@dataclass(frozen=True)
class Wrapper:
    """holders: path of the element with the slots, for each layout; template: paths and texts of constant nodes."""

    holders: tuple[int, ...] = ()
    template: frozenset[tuple[int, str]] = frozenset()


def induce(sources: list[str]) -> Wrapper:
    """The wrapper of pages of a host: what is the same on most pages of a layout, and where the rest is. One page alone has none.

    Pages whose layout no other has are aligned with those of the commonest.
    """
    layouts: dict[frozenset, list[list[Shape]]] = {}
    for source in dict.fromkeys(sources):  # copies say nothing about what varies
        nodes = _nodes(Shape.of(parse(source)))
        layouts.setdefault(frozenset(x.path for x in nodes if x.depth <= LEVELS), []).append(nodes)
    some = sorted(layouts.values(), key=len, reverse=True)
    some = [some[0] + [s for other in some[1:] if len(other) == 1 for s in other], *(x for x in some[1:] if len(x) > 1)] if some else []
    found = [_of_layout(pages) for pages in some if len(pages) > 1]
    return Wrapper(tuple(dict.fromkeys(h for h, _ in found if h is not None)), frozenset().union(*(t for _, t in found)))


def _of_layout(pages: list[list[Shape]]) -> tuple[int | None, set[tuple[int, str]]]:
    """(holder, template) of two pages or more, given as their nodes."""
    shared: Counter = Counter()
    held: Counter = Counter()  # text of slots in and below a path
    total, first = 0, pages[0]
    known = {x.path: x for nodes in pages for x in nodes if x.children or x.tag in ("article", "main")}
    for nodes in pages[1:]:
        same = set()
        for x, y in align(first[0], nodes[0]):
            if x.text == y.text:
                same |= {id(x), id(y)}
                shared[id(x)] += bool(x.text)
        for side in (first, nodes):
            sizes = {}
            for x in reversed(side):  # children before parents; nodes without a partner, or of another text, are slots
                own = len(x.text) if id(x) not in same else 0
                sizes[id(x)] = own + sum(sizes[id(c)] for c in x.children)
                held[x.path] += sizes[id(x)]
            total += sizes[id(side[0])]
    template = {(x.path, t) for x in first if shared[id(x)] + 1 >= max(LEAST, SHARE * len(pages)) for t in x.parts}
    if not total:
        return None, template
    marked = [x for p, x in known.items() if x.tag in ("article", "main") and 2 * held[p] > total]
    if marked:
        return min(marked, key=lambda x: (x.tag != "article", x.depth, x.path)).path, template
    whole = [x for p, x in known.items() if held[p] >= total and x.children]
    return max(whole, key=lambda x: (x.depth, x.path)).path if whole else None, template


def _at(root: Node, path: int) -> list[Node]:
    """The outermost blocks with a path, without dropped parts."""
    found, todo = [], [(root, step(0, root.label))]
    while todo:
        x, at = todo.pop()
        if at == path and (x.tag in _BLOCK or x is root):
            found.append(x)
            continue
        for c in reversed(x.children):
            if not isinstance(c, str) and not c.drop:
                todo.append((c, step(at, c.label) if c.tag in _BLOCK else at))
    return found


def main_text(source: str | None, wrapper: Wrapper = Wrapper(), spare: Wrapper = Wrapper()) -> str:
    """The content of a page by the wrapper of its host, by a spare one if that has no holder, else by markup."""
    if not source:
        return ""
    root = parse(source)
    for path in wrapper.holders or spare.holders:
        found = _at(root, path)
        if found:
            break
    else:
        found, path = _containers(root), 0  # a path that no template has
        found, path = (found, path) if found else ([root], step(0, root.label))
    parts = [x for node in found for x in _blocks(node, path)]
    return " ".join(t for x in parts if x not in wrapper.template for t in x[1:])


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    text is the content of the whole html: character references decoded, white
    space within a block as one space, blocks joined by one space; empty if
    there is none. n_chars counts its code points.

    A null or empty html gives an empty text. A null url belongs to the host
    "". Repeated rows give repeated rows; equal pages count once in a wrapper.
    A host (and a layout) with under LEAST different pages has an empty template. A host of
    one page, or whose pages don't differ, uses the wrapper of the hosts of one
    page. Other columns are ignored; an empty table gives an empty table.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    # a few pages of each host: a hash below a rate, then the smallest; only ids are grouped
    light = rows.where("html is not null").select("host", "page_id", F.xxhash64("page_id", "url").alias("h"))
    sizes = stage(light.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    lone = F.lit(sizes.where("n = 1").count())
    pool = light.join(sizes, "host")
    pool = pool.select("host", "page_id", "h", F.when(F.col("n") == 1, LONE).otherwise(F.col("host")).alias("pool"), F.when(F.col("n") == 1, lone).otherwise(F.col("n")).alias("n"))
    u = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = pool.where(u <= F.lit(4.0 * sample) / F.col("n"))
    few = few.withColumn("r", F.expr("row_number() over (partition by pool order by h, page_id)")).where(F.col("r") <= sample)
    few = stage(few.select("page_id", "host", "h", "pool").distinct(), "few")
    chosen = rows.withColumn("h", F.xxhash64("page_id", "url")).join(few, ["page_id", "host", "h"])

    def signed(x: int) -> int:
        return x - 2**64 if x >= 2**63 else x

    def known_(holders: list[int], paths: list[int], texts: list[bytes]) -> Wrapper:
        return Wrapper(tuple(p % 2**64 for p in holders), frozenset((p % 2**64, t.decode("utf-8", "surrogatepass")) for p, t in zip(paths, texts, strict=True)))

    def wrapper(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h", kind="stable")
        made = induce(group["html"].tolist()[: 2 * sample])
        template = sorted(made.template)
        paths, texts = [signed(p) for p, _ in template], [t.encode("utf-8", "surrogatepass") for _, t in template]
        return pd.DataFrame({"host": [group["pool"].iloc[0]], "holders": [[signed(p) for p in made.holders]], "paths": [paths], "texts": [texts]})

    wrappers = stage(chosen.select("pool", "h", "html").groupBy("pool").applyInPandas(wrapper, "host string, holders array<long>, paths array<long>, texts array<binary>"), "wrappers")
    spare = next((known_(r["holders"], [], []) for r in wrappers.where(F.col("host") == LONE).collect()), Wrapper())  # one row

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                known: dict[str, Wrapper] = {}
                lists, made = [part.column(c) for c in ("holders", "paths", "texts")], []
                for i, (s, h) in enumerate(zip(part.column("html").to_pylist(), part.column("host").to_pylist(), strict=True)):
                    if h not in known:
                        known[h] = known_(*(x[i].as_py() or [] for x in lists))
                    made.append(main_text(s, known[h], spare))
                made = [t.encode("utf-8", "replace").decode() for t in made]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(made, pa.string()), pa.array(np.array([len(t) for t in made], np.int64))], names=["page_id", "url", "text", "n_chars"]
                )

    return rows.join(wrappers, "host", "left").mapInArrow(texts, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
