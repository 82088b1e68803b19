"""Main text of web pages: the contiguous region of highest score.

A page is a sequence of words and tags. Words score positive and tags negative;
the weights come from labelled pages, those whose article is marked as such:
the log ratio of how often a kind of token occurs inside the article and
outside. One linear scan finds the region with the highest sum. Elements that
never hold main text (menus, forms, adverts, comments and the like) are left
out of the scan and of the region.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spotflow.llm.common import batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
#: Elements whose content is no markup, up to the closing tag.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")}
#: Elements without content, which never close.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no main text.
OUTSIDE = frozenset("head nav header footer aside form button select menu dialog".split())
#: Words in a class, id or role of an element that holds no main text.
NAMED = re.compile(
    r"""(?:^|[\s"'_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|header|footer|sidebar|comments?|replies|respond|disqus"""
    r"""|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|social|related|breadcrumbs?|complementary|contentinfo)(?:$|[\s"'_-])""", re.I,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Tags that stand inside a block; all others end one.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ARTICLE = frozenset(("article", "main"))
#: Elements whose class tells about the page.
WHOLE = frozenset(("html", "body", "main"))


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(tag name, text, outside): text has an empty name; closing tags begin with /.

    ``outside`` holds for what lies in an element without main text. Such an
    element ends at its closing tag, at a tag that closes an element around it,
    or where the first article begins.
    """
    at, open_, skipped, seen = 0, [], 0, False  # open_: (name, starts an outside element)
    names: Counter = Counter()  # how many elements of a name are open
    while at < len(page):
        m = TOKEN.match(page, at)
        if m is None:
            return
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if not m[0].startswith(("<!", "<?")):
                yield "", m[0], bool(skipped)
            continue
        if m[1]:
            within = bool(skipped)
            if names[name]:
                while True:
                    n, outside = open_.pop()
                    names[n] -= 1
                    skipped -= outside
                    if n == name:
                        break
            yield "/" + name, "", within
            continue
        if name in ARTICLE and not seen:  # the first one is no comment
            open_, skipped, seen = [(n, False) for n, _ in open_], 0, True
        if name in RAW:
            end = RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        outside = name in OUTSIDE or name not in WHOLE and any(NAMED.search(v) for v in ATTRIBUTE.findall(m[3] or ""))
        if name not in VOID and not m[0].endswith("/>"):
            open_.append((name, outside))
            names[name] += 1
            skipped += outside
        yield name, "", bool(skipped)


@dataclass
class Weights:
    """Score of a word, and of each tag; ``other`` is that of tags unseen in training."""

    word: float
    tags: dict[str, float]
    other: float


def train(pages: DataFrame, most: int = 2000) -> Weights:
    """(page_id, html) → weights, from about so many labelled pages, chosen by a hash of page_id.

    A page is labelled if it has an ``article`` or ``main`` element. Without
    any labelled page a word counts 1 and a tag -1.
    """
    labelled = pages.where(F.lower("html").rlike(r"<(article|main)[\s>]"))
    n = labelled.count()
    chosen = labelled.where(F.pmod(F.xxhash64("page_id"), F.lit(max(1, n // most))) == 0).select("html")

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in source:
            for page in batch["html"].to_pylist():
                depth = 0
                for name, text, outside in tokens(page):
                    bare = name.lstrip("/")
                    if bare in ARTICLE:
                        depth += -1 if name[0] == "/" else 1
                    elif name:
                        found[bare, depth > 0 and not outside] += 1
                    else:
                        found["", depth > 0 and not outside] += len(text.split())
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([found[k] for k in keys], pa.int64())],
            names=["tag", "inside", "n"],
        )

    rows = chosen.mapInArrow(count, "tag string, inside boolean, n long").groupBy("tag", "inside").agg(F.sum("n").alias("n"))
    common = rows.groupBy("tag").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("in"))
    counts = {r["tag"]: (r["in"], r["all"] - r["in"]) for r in common.collect()}  # as many as the chosen pages have
    if not counts:
        return Weights(1.0, {}, -1.0)
    inside, outside = (sum(c[i] for c in counts.values()) for i in (0, 1))

    def ratio(tag: str) -> float:
        a, b = counts.get(tag, (0, 0))
        return math.log((a + 0.5) / (inside + 1)) - math.log((b + 0.5) / (outside + 1))

    return Weights(max(0.1, ratio("")), {t: min(-0.01, ratio(t)) for t in counts if t}, -0.5)


def extract(page: str, weights: Weights) -> str:
    """Blocks of the best region, joined by an empty line."""
    scored = []  # (score, tag name, text)
    for name, text, outside in tokens(page):
        if outside:
            scored.append((0.0, "/p", ""))  # ends a block, and counts nothing
        elif name:
            scored.append((weights.tags.get(name.lstrip("/"), weights.other), name, ""))
        else:
            scored.append((weights.word * len(text.split()), "", text))
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, (score, _, _) in enumerate(scored):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, begin, end = total, start, i + 1
    blocks, block = [], []
    for _, name, text in [*scored[begin:end], (0.0, "/p", "")]:
        bare = name.lstrip("/")
        if not name:
            block.append(text)
        elif bare == "br":
            block.append(" ")
        elif bare not in INLINE:
            if words := html.unescape("".join(block)).split():
                blocks.append(" ".join(words))
            block = []
    return "\n\n".join(blocks)


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """Add ``text``, the main text of each whole page; empty if it has none.

    Null and empty pages have an empty text. Of regions of equal score the first
    wins. A column ``text`` is replaced.
    """
    out = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c != "text"])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, column="html"):
            texts = [extract(p or "", weights) for p in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField("text", T.StringType())]))
