"""Main-text extraction with wrappers: union-free regular expressions inferred per host.

A page is a token stream (tags and text), held as a tolerant tree.  A host's wrapper is a union-free expression over
these tokens: a sequence of parts that are required, optional or repeated, each part a tag with an inner expression or a
group of parts; a text position is a constant or a slot.  Inference aligns one page after the other with the
wrapper so far: equal tags recurse, differing texts become a slot, neighbouring equal parts and groups of two to
four parts that recur become repeated, and parts that only one side has become optional.  Wrappers of the same host from
different tasks are aligned with each other in the same way.  The part that holds the article is found in the wrapper
by the text that its slots hold over all pages of the host, leaving out parts that are menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or comments by tag or by class and id words; texts in the article part that are
the same on all pages of at least ``template_pages`` different articles (told apart by their longest text, so copies that differ
a little are one) belong to the template and are left out too: an element's own text, not what its children hold, and only where
they are a small part of the article.

Text: character references decoded, white space inside a block turned into one space, trimmed, blocks joined by a space.

Defined cases: null or empty html has empty text; a page that lacks the host's article part is taken by its own wrapper; null
urls form a host of their own; tags left open end with their parents, a tag cut off by the end of the page is dropped;
repeated pages count as often as they occur; elements nested deeper than ``DEEP`` are read in place of their ancestor
there; tags may have any number and length of attributes; an empty table gives an empty result; extra columns pass through, and columns named like result columns are replaced.

Scale: pages are read twice and never grouped: each task aligns its own pages (all of them, no sample) and passes on one
wrapper per host, wrappers are merged ``fan`` at a time, and pages find the few bytes they need of their host's
wrapper through ``lookup``.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.llm.common import lookup, written
from tillscope.llm.host_reputation import with_host
from tillscope.session import ship_package

#: Fixed values of HTML: elements without content, raw-text elements, inline elements, elements whose start ends an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("html body table td th ul ol dl article section div main".split())
#: Parts that are never article text, by tag or by a word of class or id.
NOT_TEXT = frozenset("head title nav header footer aside form button select textarea script style noscript template iframe object svg menu dialog".split())
NOT_WORDS = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs "
                      "header footer cookie cookies consent notice alert popup modal comment comments reply replies share sharing social related "
                      "newsletter subscribe widget copyright".split())

KEPT = frozenset("html body main article".split())
BESIDE = frozenset("with has no without".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)""", re.S)
#: What an attribute list is read by: plain stretches, the start of a quoted value, other quotes and signs.
_PIECE = re.compile(r"""[^<>"'=]++|=[ \t\r\n\f]*+(["']?)|["']""")
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_ATTR = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_MANY = 2
_SLOT = 1
#: Levels of elements in a tree (deeper elements belong to their ancestor there), parts before mixed content is folded by label.
DEEP, WIDE = 100, 64
#: Constant texts above this length are told apart by a digest.
PLAIN = 200
#: Article signs that a wrapper carries (the smallest ones).
SIGNS = 32
#: Constants are template text only below this share of the article part's text: above it the pages are copies of one article.
TEMPLATE_SHARE = 0.25


class Node:
    """An element of a page: label, own children (nodes and texts in page order)."""

    __slots__ = ("label", "tag", "kids", "skip")

    def __init__(self, tag: str, label: str, skip: bool):
        self.tag, self.label, self.skip, self.kids = tag, label, skip, []


def _is_skipped(tag: str, words) -> bool:
    """By tag, or by a word of class, id or role: a whole word, or a part of it (``cookie-box``) unless the element is the
    article's own or the word only says what stands beside (``with-sidebar``)."""
    if tag in NOT_TEXT:
        return True
    for w in words:
        parts = re.split(r"[^a-z]+", w)
        if w in NOT_WORDS or (tag not in KEPT and not BESIDE.intersection(parts) and not NOT_WORDS.isdisjoint(parts)):
            return True
    return False


def _label(tag: str, attrs: str) -> tuple[str, bool]:
    words: list[str] = []
    if attrs and "=" in attrs:
        for m in _ATTR.finditer(attrs):
            words += re.sub(r"[0-9]+", "", (m[2] or m[3] or m[4] or "").lower()).replace(".", "-").split()
    return (tag + "." + ".".join(sorted(set(words))) if words else tag), _is_skipped(tag, words)


def _tag_end(page: str, at: int, end: int, closed: dict[str, int]) -> int:
    """Place behind the tag whose attributes start at ``at``; -1 - q if it is no tag, being broken off at q.

    ``closed`` has the last place of each quote mark, so that a value without its closing mark ends no search at the end of the page.
    """
    while at < end:
        c = page[at]
        if c == ">":
            return at + 1
        if c == "<":
            return -1 - at
        m = _PIECE.match(page, at, end)
        at = m.end()
        if m[1] and closed[m[1]] >= at:
            at = page.find(m[1], at) + 1
    return -1 - end


def parse(page: str | None) -> Node:
    """The tree of a page.  Elements below ``DEEP`` levels are read like all others, but their content goes to the ancestor
    at that level, between empty marks of their own."""
    root = Node("", "", False)
    stack: list[tuple[str, Node]] = [("", root)]
    open_: dict[str, int] = {}
    at, page = 0, page or ""
    end = len(page)
    cut = _CUT_OFF.search(page, max(0, page.rfind("<")))
    if cut:
        end = cut.start()
    closed = {q: page.rfind(q, 0, end) for q in "\"'"}

    def close(k: int) -> None:
        for tag, node in stack[k:]:
            open_[tag] -= 1
            if node is stack[k - 1][1]:   # an element below DEEP ends a block here
                node.kids.append(Node(tag, tag, False))
        del stack[k:]

    while at < end:
        m = _TOKEN.search(page, at, end)
        text = page[at: m.start() if m else end]
        if text:
            stack[-1][1].kids.append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        start, at = at, _tag_end(page, at, end, closed)
        if at < 0:   # no tag: plain text up to where it broke off
            at = -1 - at
            stack[-1][1].kids.append(page[m.start():at])
            continue
        tag, attrs = m[2].lower(), page[start:at - 1]
        if m[1]:
            if open_.get(tag):
                close(max(k for k in range(1, len(stack)) if stack[k][0] == tag) if stack[-1][0] != tag else len(stack) - 1)
            continue
        ends = ENDS.get(tag) or (("p",) if tag in ENDS_P else ())
        if any(open_.get(t) for t in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        label, skip = _label(tag, attrs)
        node = Node(tag, label, skip)
        stack[-1][1].kids.append(node)
        if tag in RAW:
            close_at = re.compile(f"</{tag}", re.I).search(page, at, end)
            at = close_at.start() if close_at else end
            node.skip = True
        if tag not in VOID and not (attrs.endswith("/") and tag not in INLINE and tag not in ENDS_P):
            deep = len(stack) >= DEEP and not node.skip
            stack.append((tag, stack[-1][1] if deep else node))
            open_[tag] = open_.get(tag, 0) + 1
    return root


def _constant(own: list[str]) -> str | None:
    """A part's own text as its constant; long texts end in a digest of the whole."""
    if not own:
        return None
    text = " ".join(own)
    return text if len(text) <= PLAIN else text[:PLAIN] + "\0" + hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def _own_text(node: Node) -> list[str]:
    return [k.strip() for k in node.kids if isinstance(k, str) and not k.isspace()]


# ---- wrappers: [label, pages, characters, text (None, constant or _SLOT), parts]; part: [wrapper, least, most] ----

def _merge_text(a, b):
    """A text that only one side has is no constant."""
    return a if a == b else _SLOT


def _merge(a: list, b: list) -> list:
    both = [a[0], a[1] + b[1], a[2] + b[2], _merge_text(a[3], b[3]), _align(a[4], b[4])]
    return [*both, sorted({*a[5], *b[5]})[:SIGNS]] if len(a) > 5 else both


def page_wrapper(page: str) -> list:
    """The wrapper of a page with the sign of its article: a digest of its longest text, which copies share."""
    root, longest = parse(page), ""
    todo = [root]
    while todo:
        node = todo.pop()
        if not node.skip:
            longest = max(longest, " ".join(_own_text(node)), key=lambda t: (len(t), t))
            todo += [k for k in node.kids if isinstance(k, Node)]
    return [*wrapper_of(root), [hashlib.md5(longest.encode("utf-8", "surrogatepass")).hexdigest()[:12]]]


def _labels(parts: list) -> list[str]:
    return [p[0][0] for p in parts]


def _fold(parts: list) -> list:
    """Neighbouring equal parts and recurring groups of two to four parts become repeated."""
    out: list = []
    for p in parts:
        if out and out[-1][0][0] == p[0][0]:
            q = out[-1]
            out[-1] = [_merge(q[0], p[0]), max(q[1], p[1]), _MANY]
        else:
            out.append(p)
    for k in (2, 3, 4):
        i = 0
        while i + 2 * k <= len(out):
            names = _labels(out[i: i + k])
            if names != _labels(out[i + k: i + 2 * k]):
                i += 1
                continue
            group = out[i: i + k]
            j = i + k
            while _labels(out[j: j + k]) == names:
                group = [[_merge(x[0], y[0]), min(x[1], y[1]), max(x[2], y[2])] for x, y in zip(group, out[j: j + k])]
                j += k
            out[i:j] = [[["(" + " ".join(names) + ")", group[0][0][1], 0, None, group], 1, _MANY]]
            i += 1
    if len(out) > WIDE:  # mixed content: one optional repeated part per label
        by: dict[str, list] = {}
        for p in out:
            have = by.get(p[0][0])
            by[p[0][0]] = [_merge(have[0], p[0]) if have else p[0], 0, _MANY]
        out = list(by.values())
    return out


def _align(a: list, b: list) -> list:
    la, lb = _labels(a), _labels(b)
    if la == lb:
        return [[_merge(x[0], y[0]), min(x[1], y[1]), max(x[2], y[2])] for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if la[i] == lb[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if la[i] == lb[j]:
            out.append([_merge(a[i][0], b[j][0]), min(a[i][1], b[j][1]), max(a[i][2], b[j][2])])
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], 0, a[i][2]])
            i += 1
        else:
            out.append([b[j][0], 0, b[j][2]])
            j += 1
    out += [[p[0], 0, p[2]] for p in a[i:]] + [[p[0], 0, p[2]] for p in b[j:]]
    return _fold(out)


def wrapper_of(node: Node) -> list:
    """The wrapper of one page; parts that are never article text keep their tag only."""
    own = [] if node.skip else _own_text(node)
    parts = [] if node.skip else [[wrapper_of(k), 1, 1] for k in node.kids if isinstance(k, Node)]
    return [node.label, 1, len(" ".join(own)), _constant(own), _fold(parts) if len(parts) > 1 else parts]


def expression(w: list) -> str:
    """The wrapper as a readable expression: ``#`` is a slot, ``?``, ``+`` and ``*`` as usual."""
    inner = ("#" if w[3] == _SLOT else repr(w[3]) if w[3] is not None else "") + "".join(
        " " + expression(p[0]) + {(0, 1): "?", (1, 1): "", (0, 2): "*", (1, 2): "+"}[p[1], p[2]] for p in w[4])
    return inner.strip() if w[0].startswith("(") and not inner else f"({inner.strip()})" if w[0].startswith("(") else f"<{w[0]}>{inner}</>"


def _is_boiler(label: str) -> bool:
    tag, _, words = label.partition(".")
    return _is_skipped(tag, words.split("."))


def _text_size(w: list) -> int:
    return 0 if _is_boiler(w[0]) else w[2] + sum(_text_size(p[0]) for p in w[4])


def _walk(w: list, path: tuple) -> Iterator[tuple[tuple, list]]:
    """(path of labels, wrapper) of all parts that may hold article text; groups are no path steps."""
    for p in w[4]:
        if p[0][0].startswith("("):
            yield from _walk(p[0], path)
        elif not _is_boiler(p[0][0]):
            here = (*path, p[0][0])
            yield here, p[0]
            yield from _walk(p[0], here)


def article_part(w: list, share: float = 0.2, descend: float = 0.6) -> tuple[str, ...]:
    """Path of the part that holds the article."""
    total = _text_size(w)
    marked: dict[tuple, int] = {}
    for path, x in _walk(w, ()):
        if x[0].split(".")[0] in ("article", "main") or ".main" in x[0]:
            marked[path] = marked.get(path, 0) + _text_size(x)
    for tag in ("article", "main"):
        some = [(n, path) for path, n in marked.items() if path[-1].startswith(tag) and n >= share * total and n > 0]
        if some:
            return max(some, key=lambda s: (s[0], -len(s[1]), s[1]))[1]
    path: tuple = ()
    while True:
        sizes: dict[str, tuple[int, list]] = {}
        stack = list(w[4])
        while stack:
            p = stack.pop()
            if p[0][0].startswith("("):
                stack += p[0][4]
            elif not _is_boiler(p[0][0]):
                n, old = sizes.get(p[0][0], (0, None))
                sizes[p[0][0]] = (n + _text_size(p[0]), p[0] if old is None else _merge(old, p[0]))
        inner = [(n, label, x) for label, (n, x) in sizes.items()
                 if n >= descend * total and n > 0 and label.split(".")[0] in ("html", "body", "div", "section", "table", "tbody", "tr", "td", "center")]
        if not inner:
            return path
        total, label, w = max(inner, key=lambda s: (s[0], s[1]))
        path = (*path, label)


def template_texts(w: list, part: tuple[str, ...], pages: int) -> list[list]:
    """(path, text) of constants that stand once on every page of at least ``pages`` different articles, inside the article part.

    None where the constants hold ``TEMPLATE_SHARE`` or more of the part's text: then the pages are copies of one article.
    """
    if len(w[5]) < pages:
        return []
    out, seen, every, constant = [], {}, 0, 0
    for path, x in _walk(w, ()):
        seen.setdefault(path, []).append(x)
    for path, xs in seen.items():
        if path[: len(part)] != part:
            continue
        every += sum(x[2] for x in xs)
        if len(path) > len(part) and len(xs) == 1 and xs[0][1] == w[1] and isinstance(xs[0][3], str):
            out.append([list(path), xs[0][3]])
            constant += xs[0][2]
    return out if constant < TEMPLATE_SHARE * every else []


def main_text(root: Node, part: tuple[str, ...], template: dict[tuple, str]) -> str | None:
    """The text of the parts at ``part``; null if the page has none."""
    level = [root]
    for label in part:
        level = [k for x in level for k in x.kids if isinstance(k, Node) and k.label == label]
    if not level:
        return None
    blocks: list[str] = []
    own: list[str] = []

    def end() -> None:
        if own:
            text = _html.unescape("".join(own))
            blocks.append(" ".join(text.split()))
            own.clear()

    def collect(node: Node, path: tuple) -> None:
        # only the element's own text is the template's: what its children hold is not
        known = template.get(path) is not None and _constant(_own_text(node)) == template[path]
        for k in node.kids:
            if isinstance(k, str):
                if not known:
                    own.append(k)
            elif not k.skip:
                if k.tag not in INLINE:
                    end()
                collect(k, (*path, k.label) if template else path)
                if k.tag not in INLINE:
                    end()
            elif k.tag not in INLINE:
                end()

    for x in level:
        collect(x, part)
        end()
    return " ".join(b for b in blocks if b)


def extract_page(page: str | None, digest: str | None) -> str:
    root = parse(page)
    if digest:
        d = json.loads(digest)
        text = main_text(root, tuple(d["part"]), {tuple(p): t for p, t in d["template"]})
        if text is not None and (text or not d["part"]):
            return text
    return main_text(root, article_part(wrapper_of(root)), {}) or ""


def infer_wrappers(pages: DataFrame, host: str = "host", html: str = "html", fan: int = 16) -> DataFrame:
    """(host, wrapper): the wrapper of all pages of each host, as JSON."""
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        known: dict[str, list] = {}

        def flush() -> pa.RecordBatch:
            rows = [json.dumps(w) for w in known.values()]
            batch = pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([part] * len(rows), pa.int64()),
                                                pa.array(rows, pa.string())], ["host", "part", "wrapper"])
            known.clear()
            return batch

        for b in batches:
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if page:
                    w = page_wrapper(page)
                    known[h] = _merge(known[h], w) if h in known else w
                    if len(known) > 2000:
                        yield flush()
        if known:
            yield flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf["wrapper"])
        if len(rows) > 1:
            w = json.loads(rows[0])
            for r in rows[1:]:
                w = _merge(w, json.loads(r))
            rows = [json.dumps(w)]
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "part": pdf["part"].iloc[:1], "wrapper": rows})

    out = written(pages.select(F.col(host).alias("host"), F.col(html).cast("string").alias("html")).mapInArrow(
        align, "host string, part long, wrapper string"), "wrapper-parts")
    while True:
        most = out.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return out.select("host", "wrapper")
        ways = -(-most // fan)
        keyed = out.withColumn("part", F.pmod("part", F.lit(ways)) if ways > 1 else F.lit(0).cast("long"))
        out = written(keyed.groupBy("host", "part").applyInPandas(merge, "host string, part long, wrapper string"), "wrapper-merged")


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", template_pages: int = 8) -> DataFrame:
    """``pages`` with text and n_chars (code points)."""
    ship_package(pages.sparkSession)
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    at = with_host(pages.select(F.struct(*keep).alias("row"), F.col(url).alias("url"), F.col(html).alias("html")), "url")

    @F.pandas_udf("string")
    def digest(ws: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            w = json.loads(text)
            part = article_part(w)
            return json.dumps({"part": part, "template": template_texts(w, part, template_pages)})
        return ws.map(one)

    digests = written(infer_wrappers(at).select("host", digest("wrapper").alias("digest")), "wrapper-digests")
    found = lookup(at.select("row", "host", F.col("row")[html].alias("html")), digests, ["host"]).select("row", "html", "digest")
    schema = T.StructType([found.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract_page(p, d) if p else "" for p, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["row", "text"])

    return found.mapInArrow(run, schema).select("row.*", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_wrapper_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
