"""The own body of a page, without what surrounds it on every page of its site.

Each block of visible text is a line with a text-to-tag ratio (characters over tags). The ratios are
smoothed with a Gaussian over neighbouring lines and split into two clusters by a threshold between
their means; lines of the upper cluster mark content. The content region is the container of the
page's main heading (where that wraps headings only, what is around it, if marked text prevails there),
or, where there is none, the container that holds most of the marked text.

Density alone keeps a long footer sentence and loses a short paragraph, so the region decides what is
content and is then cleaned: elements that declare themselves navigation, side column, footer, dialog or
form (by tag, class, id or role) go, and so do inner groups that read like a menu, sharing strip, teaser
list or notice (mostly short lines without sentence ends, buttons, or the fixed phrases of such boxes).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from millrace.llm.page_events import Page, read_page
from millrace.session import spread

#: Tags whose content never is a page's own body.
ASIDE_TAGS = frozenset({"nav", "aside", "footer", "form", "button", "select", "dialog", "menu", "iframe", "object", "canvas", "svg"})
#: Words of class, id and role that name surroundings of the body, in English and Norwegian.
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu meny toppmeny sidemeny header topp top topbar footer bunn bunntekst sidebar "
    "aside hoyre høyre venstre widget cookie cookies kapsler informasjonskapsler consent samtykke gdpr banner "
    "newsletter nyhetsbrev brev subscribe share sharing del deling social sosiale breadcrumb breadcrumbs sti "
    "brodsmuler related relatert teaser teasers promo popup modal contentinfo complementary search sok".split()
)
#: Phrases that only boxes around the body have, in folded form.
ASIDE_PHRASES = re.compile(
    r"©|alle rettigheter forbeholdt|all rights reserved|nyhetsbrev|newsletter|informasjonskapsler|\bkapsler\b|\bcookies?\b|personvern|privacy|"
    r"del på nett|share this|skriv ut|tips en venn|e-mail a friend|følg oss|follow us|les også|read also|mest lest|most popular|"
    r"siste nytt|latest news|samarbeidspartnere|our partners|org\.nr|company no|nettsiden er laget av|website by|godta alle|accept all|"
    r"e-postadresse|e-mail address"
)
_NAME_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?…:][\"'»”’)\]]*$")
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
#: Elements that belong to running text, whatever is in them.
FLOW = frozenset({"p", "ul", "ol", "dl", "li", "dt", "dd", "table", "tbody", "thead", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", *HEADINGS})

#: Gaussian weights over two neighbours on each side (standard deviation 1 line).
_KERNEL = (0.40261995, 0.24420134, 0.05448868)


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian smoothing; beyond the first and last line the weights are renormalised."""
    n = len(ratios)
    a, b, c = _KERNEL
    out = []
    for i in range(n):
        total, weight = a * ratios[i], a
        if i:
            total, weight = total + b * ratios[i - 1], weight + b
            if i > 1:
                total, weight = total + c * ratios[i - 2], weight + c
        if i + 1 < n:
            total, weight = total + b * ratios[i + 1], weight + b
            if i + 2 < n:
                total, weight = total + c * ratios[i + 2], weight + c
        out.append(total / weight)
    return out


def cluster_threshold(values: list[float]) -> float:
    """Threshold midway between the means of the two clusters it separates (found by iteration)."""
    low, high = min(values), max(values)
    at = (low + high) / 2
    for _ in range(20):
        upper = [v for v in values if v > at]
        if not upper or len(upper) == len(values):
            break
        lower_mean = (sum(values) - sum(upper)) / (len(values) - len(upper))
        moved = (lower_mean + sum(upper) / len(upper)) / 2
        if abs(moved - at) < 1e-6:
            break
        at = moved
    return at


def dense_lines(page: Page) -> list[bool]:
    """Which blocks the density of their neighbourhood marks as content."""
    if not page.texts:
        return []
    ratios = [len(t) / max(1, w) for t, w in zip(page.texts, page.weights, strict=True)]
    values = smoothed(ratios)
    at = cluster_threshold(values)
    return [v > at for v in values] if max(values) > min(values) else [True] * len(values)


def _surroundings(page: Page) -> list[bool]:
    """Which elements declare themselves, or lie in one that does, to be no part of the body."""
    out = [False]
    known: dict[str, bool] = {"": False}
    for tag, parent, name in zip(page.tags[1:], page.parents[1:], page.names[1:], strict=True):
        if out[parent] or tag in ASIDE_TAGS:
            out.append(True)
            continue
        named = known.get(name)
        if named is None:
            named = known[name] = not ASIDE_WORDS.isdisjoint(_NAME_WORD.findall(name.lower()))
        out.append(named and tag not in ("body", "html", "main", "article"))
    return out


def main_heading(page: Page, aside: list[bool]) -> int | None:
    """The first h1, else the first h2, outside of declared surroundings."""
    return next((e for level in ("h1", "h2") for e, tag in enumerate(page.tags) if tag == level and not aside[e]), None)


def body_region(page: Page, aside: list[bool]) -> int | None:
    """The element that holds the page's own body; null for a page without one."""
    if (heading := main_heading(page, aside)) is not None:
        at = page.parents[heading]
        while page.tags[at] in ("header", "hgroup") and page.parents[at] > 0:
            at = page.parents[at]
        return _around_wrapper(page, aside, at)
    weight: dict[int, int] = {}
    boxes: set[int] = set()
    for text, owner, link, dense in zip(page.texts, page.owners, page.links, dense_lines(page), strict=True):
        if aside[owner]:
            continue
        at, inside = owner, False
        while page.tags[at] in FLOW and page.parents[at] > 0:
            at = page.parents[at]
        up = at
        while up > 0 and not inside:
            inside = page.tags[up] in ("main", "article")
            up = page.parents[up]
        if ASIDE_PHRASES.search(text.lower()):
            boxes.add(at)
        elif 2 * link <= len(text):
            weight[at] = weight.get(at, 0) + (len(text) if dense else 1) + 1_000_000 * inside
    for at in boxes:
        weight.pop(at, None)
    return max(weight, key=lambda e: (weight[e], -e)) if weight else None


def _around_wrapper(page: Page, aside: list[bool], at: int) -> int:
    """The heading's container ``at``, or, where it wraps headings only, the nearest element around it in
    which lines that the density marks, outside of boxes, hold most of the text besides headings."""
    tags, parents, owners = page.tags, page.parents, page.owners
    inside = [False] * len(tags)
    inside[at] = True
    for e in range(at + 1, len(tags)):
        inside[e] = inside[parents[e]]
    if tags[at] in ("main", "article") or any(inside[o] and tags[o] not in HEADINGS for o in owners):
        return at
    marked = [0] * len(tags)
    other = [0] * len(tags)
    for text, owner, link, dense in zip(page.texts, owners, page.links, dense_lines(page), strict=True):
        if aside[owner] or tags[owner] in HEADINGS:
            continue
        content = dense and 2 * link <= len(text) and not ASIDE_PHRASES.search(text.lower()) and _SENTENCE.search(text) is not None
        (marked if content else other)[owner] += len(text)
    for e in range(len(tags) - 1, 0, -1):
        marked[parents[e]] += marked[e]
        other[parents[e]] += other[e]
    up = at
    while parents[up] > 0:
        up = parents[up]
        if marked[up] or other[up] or tags[up] in ("main", "article"):
            return up if marked[up] > other[up] else at
    return at


def own_blocks(page: Page) -> list[int]:
    """Positions of the blocks of the page's own body, in order; found once for a page."""
    if page.own is None:
        page.own = _own_blocks(page)
    return page.own


def _own_blocks(page: Page) -> list[int]:
    if not page.texts:
        return []
    aside = _surroundings(page)
    region = body_region(page, aside)
    if region is None:
        return []
    # The outermost group between each block and the region; -1: directly in it; -2: outside.
    top = [-2] * len(page.tags)
    top[region] = -1
    tags, parents = page.tags, page.parents
    for e in range(region + 1, len(tags)):
        above = top[parents[e]]
        if above == -2 or aside[e] or (tags[e] == "header" and above == -1):
            continue
        top[e] = e if above == -1 and tags[e] not in FLOW else above
    groups: dict[int, list[int]] = {}
    for i, owner in enumerate(page.owners):
        if top[owner] != -2:
            groups.setdefault(top[owner], []).append(i)
    kept = groups.pop(-1, [])
    heading = main_heading(page, aside)
    for group, members in groups.items():
        wraps = any(page.owners[i] == heading for i in members) and all(tags[page.owners[i]] in HEADINGS for i in members)
        if wraps or _reads_as_body(page, group, members):
            kept += members
    return sorted(kept)


def _reads_as_body(page: Page, group: int, members: list[int]) -> bool:
    """Whether an inner group of lines reads like running text rather than like a box around it."""
    texts = [page.texts[i] for i in members]
    linked = sum(page.links[i] for i in members)
    if 2 * linked > sum(map(len, texts)):
        return False
    single = all(page.owners[i] == group for i in members)
    sentences = sum(_SENTENCE.search(t) is not None for t in texts)
    if single and len(members) == 1:
        return True
    if any(ASIDE_PHRASES.search(t.lower()) for t in texts):
        return False
    flow = sum(page.tags[page.owners[i]] in ("li", "td", "th", "dd", "dt", *HEADINGS) for i in members)
    return 2 * sentences > len(texts) - flow and sentences > 0


def main_bodies(pages: DataFrame, keys: dict[str, Column], html: Column, leave_out=None) -> DataFrame:
    """``keys``, ``block_ord`` and ``block`` of the own body of each page, a row a block.

    Null, empty and contentless pages give no rows. ``leave_out(page)`` says which pages to pass over.
    Each page is read by itself: nothing is shuffled."""
    return _per_page(pages, keys, html, leave_out, hashed=False)


def main_body_hashes(pages: DataFrame, keys: dict[str, Column], html: Column, leave_out=None) -> DataFrame:
    """As ``main_bodies``, with ``block_md5`` (of the block's UTF-8 text) in place of the block."""
    return _per_page(pages, keys, html, leave_out, hashed=True)


def _per_page(pages: DataFrame, keys: dict[str, Column], html: Column, leave_out, hashed: bool) -> DataFrame:
    picked = pages.select(*[c.alias(k) for k, c in keys.items()], html.alias("__html")).where("__html IS NOT NULL AND __html != ''")
    names = list(keys)
    value = "block_md5" if hashed else "block"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, order, blocks = [], [], []
            for i, text in enumerate(b.column("__html").to_pylist()):
                page = read_page(text)
                if leave_out is not None and leave_out(page):
                    continue
                for k, j in enumerate(own_blocks(page)):
                    at.append(i)
                    order.append(k)
                    block = page.texts[j]
                    blocks.append(hashlib.md5(block.encode("utf-8", "surrogatepass")).hexdigest() if hashed else block)
            kept = [b.column(n).take(pa.array(at, pa.int32())) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(order, pa.int32()), pa.array(blocks, pa.string())], names=[*names, "block_ord", value])

    return spread(picked).mapInArrow(run, picked.select(*names).schema.add("block_ord", "integer").add(value, "string"))
