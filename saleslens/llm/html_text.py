"""Operator 1, main text of web pages by maximum-scoring subsequence.

A page is a sequence of tokens: words, scored by the element that holds them,
and tags. Weights are log odds of a token inside against outside the labelled
content of pages that mark it themselves (``article`` or ``main``), so words
of paragraphs score positive and the tags and words of page furniture
negative. One linear scan finds the contiguous region of the largest sum;
furniture inside the region is left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslens.llm.common import bounded_sample, through_storage

#: Labelled pages that the weights are learned from, at most (chosen by their content hashes).
MAX_LABELLED = 3_000
#: Weights are bounded, so that no single tag decides alone.
MOST = 6.0
#: Weights where no page is labelled, and of tokens that the labels never show.
DEFAULT_WORD, DEFAULT_LINK_WORD, DEFAULT_FURNITURE_WORD, DEFAULT_TAG = 1.0, -1.0, -3.0, -0.5

# Elements whose content is code, not text.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select".split())
# Elements that hold page furniture.
FURNITURE = frozenset("nav header footer aside form menu dialog button figcaption label head title".split())
# Elements that hold the content in pages that mark it.
CONTENT = frozenset("article main".split())
# Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that stay inside a block; all others start and end one.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
# Names and roles that mark furniture, as whole parts of a class or id.
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo menu nav navbar navigation "
    "breadcrumb breadcrumbs header footer sidebar aside widget related share sharing social cookie cookies consent notice "
    "notices alert popup modal newsletter subscribe signup login form search comment comments reply replies disqus "
    "pagination pager toc masthead toolbar copyright".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
# Elements that an opening tag of the same kind ends.
_CLOSED_BY_ITSELF = frozenset("p li dt dd tr td th option".split())
# Blocks before which an open paragraph ends.
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section "
    "table ul".split()
)

# Elements that hold more than a line of text: inside marked content the names of these alone tell furniture.
_CONTAINERS = frozenset("details dl div fieldset figure ol section table ul".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*([\"']?))?")
_UNQUOTED = re.compile(r"[^\s>]*")
_GAP = re.compile(r"[\s/]*")
_PARTS = re.compile(r"[^a-z0-9]+")
#: Attributes that are looked at.
_KEYS = frozenset("class id role hidden aria-hidden".split())


class _Scanner:
    """Reads markup from left to right, each character a fixed number of times."""

    def __init__(self, page: str):
        self.page = page
        self.gone: set[str] = set()  # what does not occur any more

    def find(self, what: str, at: int) -> int:
        """Place of ``what`` from ``at`` on, -1 if there is none; one that is not found is not looked for again."""
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag(self, at: int) -> tuple[int, list[tuple[str, str]]] | None:
        """End of the tag whose name ends at ``at``, and its attributes; None if the page ends in it.

        A quote opens a value right after the equals sign alone; a value
        without one ends at white space or at the tag's end. A quote that
        nothing closes is part of its value.
        """
        page, found = self.page, []
        while True:
            at = _GAP.match(page, at).end()
            if at >= len(page):
                return None
            if page[at] == ">":
                return at + 1, found
            match = _ATTRIBUTE.match(page, at)
            key, quote, at, value = match[1].lower(), match[2], match.end(), ""
            if quote and (stop := self.find(quote, at)) >= 0:
                value, at = page[at:stop], stop + 1
            elif quote is not None:
                end = _UNQUOTED.match(page, at).end()
                value, at = page[at:end], end
            if key in _KEYS:
                found.append((key, value))


def _is_furniture(name: str, attributes: list[tuple[str, str]], inside: bool) -> bool:
    """Whether an element holds furniture; an article's own header is part of it, and so are its named paragraphs."""
    if name in FURNITURE:
        return not (inside and name == "header")
    if name in ("html", "body") or not attributes:
        return False
    for key, value in attributes:
        value = value.lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value in FURNITURE_ROLES:
            return True
        if inside and name not in _CONTAINERS:
            continue
        if key in ("class", "id") and FURNITURE_NAMES.intersection(_PARTS.split(value)) - ({"header"} if inside else set()):
            return True
    return False


@dataclass
class Block:
    """A run of text in one block: its words' kind, and whether it is furniture or marked content."""

    kind: str
    text: str
    furniture: bool
    content: bool


#: Furniture inside marked content: it weighs nothing, so it does not part the content around it.
INNER = "inner"


def tokens(page: str) -> Iterator[tuple[str, Block | None]]:
    """(token kind, block or None) in page order: ``<name`` and ``</name`` of tags, one token for each block of text.

    Comments, declarations and the content of code elements give nothing. A
    page may stop anywhere; what is open then ends there.
    """
    stack: list[tuple[str, bool, bool]] = []  # name, whether in furniture, whether in marked content
    opened: Counter = Counter()  # names in the stack: one that is not open is not looked for
    parts: list[str] = []
    linked = [0, 0]  # characters inside links, and all

    def state() -> tuple[bool, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def close(i: int) -> None:
        opened.subtract(n for n, _, _ in stack[i:])
        del stack[i:]

    def flush() -> Iterator[tuple[str, Block | None]]:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            furniture, content = state()
            holder = next((n for n, _, _ in reversed(stack) if n not in INLINE), "body")
            if furniture:
                kind = INNER if content else "furniture"
            else:
                kind = f"link@{holder}" if linked[0] * 2 > linked[1] else f"word@{holder}"
            yield kind, Block(kind, text, furniture, content)
        parts.clear()
        linked[:] = [0, 0]

    def add(text: str) -> None:
        if text:
            parts.append(text)
            size = len(text.strip())
            linked[1] += size
            if any(n == "a" for n, _, _ in stack[-4:]):
                linked[0] += size

    at, end, scanner = 0, len(page), _Scanner(page)
    while at < end:
        opening = scanner.find("<", at)
        if opening < 0:
            add(page[at:])
            break
        add(page[at:opening])
        at = opening
        if page.startswith("<!--", at):
            stop = scanner.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if page.startswith(("<!", "<?"), at):
            stop = scanner.find(">", at)
            at = stop + 1 if stop >= 0 else end
            continue
        found = _TAG.match(page, at)
        if not found:  # no markup
            add("<")
            at += 1
            continue
        read = scanner.tag(found.end())
        if read is None:  # a tag that the page's end cuts off
            break
        name, (at, attributes) = found.group(2), read
        name = name.lower()
        closing = found.group(1)
        if name == "br":
            add("\n")
            continue
        if not closing and name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        block = name not in INLINE
        if block:
            yield from flush()
            yield INNER if all(state()) else f"</{name}" if closing else f"<{name}", None
        if closing:
            for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[i][0] == name:
                    close(i)
                    break
                if stack[i][0] in CONTENT | FURNITURE and name in INLINE | _CLOSED_BY_ITSELF:
                    break  # a stray end does not reach out of its section
        elif name not in VOID:
            if name in _ENDS_P and opened["p"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            if name in _CLOSED_BY_ITSELF and name != "p" and opened[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "select", "article", "main", "div"):
                        break
            furniture, content = state()
            inside = content or name in CONTENT
            opened[name] += 1
            stack.append((name, furniture or _is_furniture(name, attributes, inside), inside))
    yield from flush()


# ---------------------------------------------------------------- weights --


def _size(block: Block | None) -> int:
    """Words of a block of text; a tag and a block of furniture count once."""
    return 1 if block is None or block.furniture else block.text.count(" ") + 1


def label_counts(page: str) -> Counter | None:
    """How often each token kind stands inside and outside the marked content; None without a mark."""
    marked, seen = False, Counter()
    depth = 0
    for kind, block in tokens(page):
        if kind == INNER:
            continue
        if block is None:
            name = kind.lstrip("</")
            if name in CONTENT:
                marked = True
                depth += 1 if kind[1] != "/" else 0
                seen[kind, True] += 1
                depth -= 1 if kind[1] == "/" else 0
                continue
            seen[kind, depth > 0] += 1
        else:
            seen[kind, block.content] += _size(block)
    return seen if marked else None


def default_weight(kind: str) -> float:
    if kind == INNER:
        return 0.0
    if kind == "furniture":
        return DEFAULT_FURNITURE_WORD
    if kind.lstrip("</") in CONTENT:
        return 0.0
    if kind.startswith("link@"):
        return DEFAULT_LINK_WORD
    return DEFAULT_WORD if kind.startswith("word@") else DEFAULT_TAG


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of each kind, words and tags each against their own share; ends of furniture stay negative."""
    out = {}
    total = {inside: sum(n for (_, i), n in counts.items() if i == inside) for inside in (True, False)}
    if not total[True] or not total[False]:
        return out
    for kind in {k for k, _ in counts}:
        a, b = counts.get((kind, True), 0), counts.get((kind, False), 0)
        odds = float(np.log((a + 0.5) / (total[True] + 1)) - np.log((b + 0.5) / (total[False] + 1)))
        odds = max(-MOST, min(MOST, odds))
        name = kind.lstrip("</")
        if "@" not in kind and kind != "furniture":
            # tags pay, words earn; a mark of content is free
            odds = min(odds, 0.0 if name in CONTENT else DEFAULT_TAG)
        out[kind] = odds
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[first, end) of the contiguous run of the largest sum; the first and longest of equals; empty if none is positive."""
    best = total = 0.0
    first = start = end = 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and best > 0 and start == first):
            best, first, end = total, start, i + 1
    return first, end


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best region without its furniture, joined by an empty line; empty for null or none."""
    if not page:
        return ""
    kinds, blocks, scores = [], [], []
    for kind, block in tokens(page):
        weight = weights.get(kind)
        if weight is None:
            weight = default_weight(kind)
        kinds.append(kind)
        blocks.append(block)
        scores.append(weight * _size(block))
    first, end = best_region(scores)
    return "\n\n".join(b.text for b in blocks[first:end] if b is not None and not b.furniture)


# --------------------------------------------------------------- operator --


def learn_weights(pages: DataFrame) -> dict[str, float]:
    """Weights from at most MAX_LABELLED pages that mark their content; empty without any."""
    marked = pages.filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]")).select("html")
    sample = through_storage(bounded_sample(marked, MAX_LABELLED, F.col("html")), "labelled-pages")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for part in parts:
            for page in part["html"]:
                seen.update(label_counts(page) or {})
        if seen:
            yield pd.DataFrame(
                {"kind": [k for k, _ in seen], "inside": [i for _, i in seen], "n": list(seen.values())}
            )

    rows = sample.mapInPandas(count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(
        F.sum("n").alias("n")
    )
    return weights_of({(r.kind, r.inside): r.n for r in rows.collect()})


def extract_pages(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    ``text``: the main text of the whole page, its blocks in page order joined
    by an empty line, character references decoded, white space inside a block
    one space; empty for a null or empty page and for one without content.
    Rows are independent, so repeated rows, null ids and an empty table need
    no care; other columns are not read. ``weights`` are learned from the
    pages if not given.
    """
    if weights is None:
        weights = learn_weights(pages)
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("string")
    def extract(texts: pd.Series) -> pd.Series:
        return pd.Series([main_text(t, shared.value) for t in texts], dtype=object)

    return pages.select("page_id", "url", extract("html").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
