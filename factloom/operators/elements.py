"""Pages as element trees in rows, and the parts of a page that selectors name.

``element_tree`` gives one row per element and text of a page in document order: ``node`` (its place), ``last`` (the last place
inside it), parent and depth.  A subtree is the interval node..last, so what a subtree holds is a difference of two
running sums, and no tree is walked.

``candidates`` gives the content of each selector that matches, and of the whole cleaned page, each content once.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS_CHARS
from .html import VOID

# fixed values: where main text is looked for, in order, and what is never part of it
SELECTORS = (
    "article", "main", "[role='main']", ".article", ".article-content", ".post", ".post-content", ".entry-content", ".content", "#content",
    ".main-content", "[class*='content']", "[id*='content']", "[class*='article']", "[id*='article']", "[class*='post']", "[id*='post']",
    ".detail", ".detail-content", "[class*='detail']", "[id*='detail']", "section",
)
EXCLUDED = (
    "nav", "footer", "header", "aside", "script", "style", "noscript", "form", ".sidebar", ".side-bar", ".rightbar", ".right-bar", ".leftbar",
    ".left-bar", ".recommend", ".recommended", ".related", ".related-posts", ".hot", ".rank", ".ranking", ".advertisement", ".advertisements",
    ".ads", ".ad", ".banner", ".cookie", ".modal", ".comment", ".comments", ".reply", ".share", ".social", ".breadcrumb", ".pagination",
    ".toolbar", ".copyright", ".download", ".login", ".register",
)
WHOLE = "full_cleaned_html"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!.*?(?:>|\Z)|<(?P<raw>script|style)\b(?P<rawattrs>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)|"
    r"<(?P<close>/)?(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>[^>]*)>|(?P<text>[^<]+|<)", re.I | re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.S)
TEXT = "#text"
TREE = "node int, last int, parent int, depth int, tag string, names array<string>, element_id string, role string, text string"


def _elements(page: str) -> list[list]:
    """[node, last, parent, depth, tag, names, id, role, text] in document order.  An end tag closes what is open inside its
    element, one without an open element is ignored; what is open at the end ends there."""
    rows: list[list] = []
    held: list[int] = []

    def add(tag: str, attributes: str, text: str | None) -> int:
        known = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes or "")}
        node = len(rows)
        rows.append([node, node, held[-1] if held else None, len(held), tag, (known.get("class") or "").split(), known.get("id"), known.get("role"), text])
        return node

    for found in _TOKEN.finditer(page):
        if found["raw"]:
            add(found["raw"].lower(), found["rawattrs"], None)
        elif found["tag"] and found["close"]:
            tag = found["tag"].lower()
            if any(rows[n][4] == tag for n in held):
                while True:
                    node = held.pop()
                    rows[node][1] = len(rows) - 1
                    if rows[node][4] == tag:
                        break
        elif found["tag"]:
            tag = found["tag"].lower()
            node = add(tag, found["attrs"], None)
            if tag not in VOID and not found["attrs"].endswith("/"):
                held.append(node)
        elif found["text"]:
            text = entities.unescape(found["text"]).strip(WS_CHARS)
            if text:
                add(TEXT, "", text)
    for node in held:
        rows[node][1] = len(rows) - 1
    return rows


def element_tree(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row per element and text of every page; a page without any gives none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("node", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()),
                                   ("names", pa.list_(pa.string())), ("element_id", pa.string()), ("role", pa.string()), ("text", pa.string())]))
        names = [f.name for f in kind.value_type]
        for batch in batches:
            for i in range(len(batch)):  # a page at a time: a tree is many times its page
                rows = [dict(zip(names, row, strict=True)) for row in _elements(batch.column(1)[i].as_py() or "")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([rows], kind)], names=["key", "tree"])

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(work, f"key {kind}, tree array<struct<{TREE.replace(' ', ':').replace(',:', ',')}>>")
    return out.select(F.col("key").alias(key), F.inline("tree"))


_PART = re.compile(r"""([.#])([\w-]+)|\[(class|id|role)(\*?=)['"]?([^'"\]]+)['"]?\]""")


def matches(selector: str) -> Column:
    """Whether an element row matches a selector: a tag, classes, an id, [attribute='value'] and [attribute*='part'] in one."""
    tag = re.match(r"[a-zA-Z][\w-]*", selector)
    out = F.col("tag") == tag[0].lower() if tag else F.col("tag") != TEXT
    at = tag.end() if tag else 0
    whole = {"class": F.array_join("names", " "), "id": F.col("element_id"), "role": F.col("role")}
    while at < len(selector):
        part = _PART.match(selector, at)
        if not part:
            raise ValueError(f"selector not understood: {selector}")
        if part[1] == ".":
            test = F.array_contains("names", part[2])
        elif part[1] == "#":
            test = F.col("element_id") == part[2]
        else:
            test = F.contains(whole[part[3]], F.lit(part[5])) if part[4] == "*=" else whole[part[3]] == part[5]
        out = out & F.coalesce(test, F.lit(False))
        at = part.end()
    return out


def any_match(selectors: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for selector in selectors:
        out = out | matches(selector)
    return out


def _sums(tree: DataFrame, key: str, excluded: tuple[str, ...]) -> DataFrame:
    """The tree with a second row (``ending`` 1) where each element ends, ``hidden`` (inside an excluded element), and running sums over the page of its
    visible texts: their number, characters and characters in links.  A subtree holds the sums at its end less those at its start."""
    text = F.col("tag") == TEXT
    both = F.when(text, F.array(F.struct(F.col("node").alias("at"), F.lit(0).alias("ending")))).otherwise(
        F.array(F.struct(F.col("node").alias("at"), F.lit(0).alias("ending")), F.struct(F.col("last").alias("at"), F.lit(1).alias("ending")))
    )
    rows = tree.select("*", F.inline(both))
    # at one place the text or start comes first, then the ends there
    until = Window.partitionBy(key).orderBy("at", "ending").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col("ending") == 0
    rows = rows.withColumn("_hidden", F.max(F.when(begins & any_match(excluded), F.col("last"))).over(until))
    rows = rows.withColumn("_links", F.max(F.when(begins & (F.col("tag") == "a"), F.col("last"))).over(until))
    rows = rows.withColumn("hidden", F.coalesce(F.col("_hidden") >= F.col("at"), F.lit(False)))
    shown = text & begins & ~F.col("hidden")
    length = F.when(shown, F.length("text")).otherwise(0)
    linked = F.when(F.coalesce(F.col("_links") >= F.col("at"), F.lit(False)), length).otherwise(0)
    sums = {"texts": F.sum(shown.cast("int")), "chars": F.sum(length), "link_chars": F.sum(linked)}
    return rows.withColumns({name: value.over(until) for name, value in sums.items()}).withColumn("shown", shown).drop("_hidden", "_links")


def candidates(tree: DataFrame, key: str, selectors: tuple[str, ...] = SELECTORS, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(key, place, candidate, nodes, chars, link_chars, content) of each selector that matches a visible element of a page, and of the whole
    page: texts one a line, in order; a selector that matches inside its own match repeats them.  Of equal contents the first stays; blank ones leave.

    One shuffle, by page: running sums, and what is gathered of a page, are bounded by the page."""
    rows = _sums(tree, key, excluded)
    named = F.array_compact(F.array(*[F.when(matches(s), F.lit(i)) for i, s in enumerate(selectors)]))
    # a hidden element holds no visible text and leaves below
    rows = rows.withColumn("_places", F.when(F.col("tag") != TEXT, named))
    hit = F.when(F.size("_places") > 0, F.struct("ending", "node", "texts", "chars", "link_chars", "_places"))
    pages = rows.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("shown"), F.struct("node", "text")))).alias("_texts"),
        F.sort_array(F.collect_list(hit)).alias("_hits"),
        *[F.max(c).alias(c) for c in ("texts", "chars", "link_chars")],
    )
    pages = pages.where("texts > 0").withColumn("_texts", F.transform("_texts", lambda x: x["text"]))

    def candidate(place: int, selector: str) -> Column:
        own = lambda ending: F.filter("_hits", lambda h: (h["ending"] == ending) & F.array_contains(h["_places"], place))
        # starts and ends of the same elements, both by node
        part = lambda a, b: F.struct(a["texts"].alias("before"), *[(b[c] - a[c]).alias(c) for c in ("texts", "chars", "link_chars")])
        parts = F.filter(F.zip_with(own(0), own(1), part), lambda p: p["texts"] > 0)
        return F.struct(F.lit(place).alias("place"), F.lit(f"candidate:{selector}").alias("candidate"), parts.alias("parts"))

    whole = F.array(F.struct(F.lit(0).cast("long").alias("before"), *[F.col(c) for c in ("texts", "chars", "link_chars")]))
    every = [candidate(i, s) for i, s in enumerate(selectors)] + [F.struct(F.lit(len(selectors)).alias("place"), F.lit(WHOLE).alias("candidate"), whole.alias("parts"))]
    found = pages.select(key, "_texts", F.inline(F.array(*every))).where(F.size("parts") > 0)
    lines = F.flatten(F.transform("parts", lambda p: F.slice("_texts", p["before"].cast("int") + 1, p["texts"].cast("int"))))
    total = lambda c: F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p[c])
    nodes = F.size("parts").cast("long").alias("nodes")
    found = found.select(key, "place", "candidate", nodes, total("chars").alias("chars"), total("link_chars").alias("link_chars"), F.array_join(lines, "\n").alias("content"))
    first = found.groupBy(key, "content").agg(F.min(F.struct("place", "candidate", "nodes", "chars", "link_chars")).alias("_r"))
    return first.select(key, "_r.*", "content")


def chosen(found: DataFrame, key: str, mode: str = "auto", fit: Column | None = None, score: Column | None = None) -> DataFrame:
    """One candidate of each page.

    ``fit`` says which candidates are cut out of the page (default: all but the whole).  Mode "fit" prefers the first of these, "raw" the first of the
    others, and either takes the other kind where its own is missing.  Mode "auto" takes the best ``score`` (default: the share of
    characters outside links), then the longest, then the first.
    """
    fit = F.col("candidate") != WHOLE if fit is None else fit
    score = F.round((F.col("chars") - F.col("link_chars")) / F.greatest(F.col("chars"), F.lit(1)), 6) if score is None else score
    if mode not in ("fit", "raw", "auto"):
        raise ValueError(f"unknown mode: {mode}")
    rows = found.withColumn("score", score)
    first = -F.col("place")
    rank = F.struct("score", "chars", first) if mode == "auto" else F.struct((fit if mode == "fit" else ~fit).cast("int"), first)
    keep = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*keep), rank).alias("_b")).select(key, "_b.*")
