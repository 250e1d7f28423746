"""Main text of web pages by tag-path ratios (operator 5).

A page becomes a sequence of text nodes, each with its root-to-leaf tag path.
Text length and punctuation are aggregated per path and divided by the path's
nodes; both ratios are smoothed along the page, fused (geometric mean) and
compared with a threshold taken from their spread. An article or main element
around a node raises its ratio; links, and class names or ids of boilerplate
(menus, side bars, notices, adverts, comments), lower it. The common ancestor of
all paths over the threshold bounds the article; within it, text of any length
stays unless its names or its links speak against it. Navigation, headers, footers,
asides, forms and hidden elements are never part of it.

Nulls and edges: null or empty html gives an empty text; markup that never ends
is read up to the page's end; text without any markup is one block. A null
page_id or url stays null. Repeated rows give the same text. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Comments, declarations, elements whose content is read up to their end tag, tags, and text.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the first kind ends an open element of the second.
_ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = frozenset("ul ol dl table menu dir".split())
#: Elements whose content is no text; a start tag of the first two may close itself.
_SKIPPED = frozenset("svg math select object video audio canvas template noscript".split())
_SELF_CLOSED = frozenset("svg math".split())
_NOT_ARTICLE = frozenset("head title nav header footer aside form button menu dialog label fieldset legend option".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|comments?|commentlist|replies|reply|respond|disqus|"
    r"side-?bar\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|footer\w*|header|masthead|topbar|cookies?\w*|consent|notices?|alert|gdpr|"
    r"pop-?up\w*|modal|overlay|newsletter|subscri\w*|sign-?up|log-?in|shar(?:e|ing)|social|related|recommend\w*|widget\w*|search\w*|"
    r"pagination|pager|copyright|toolbar|skip)(?=$|[\s_-])",
    re.I,
)
_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog form menu menubar toolbar".split())
_ATTR = re.compile(r"([a-zA-Z_:-][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_MARKS = re.compile(r"[.,;:!?…。，；：！？]")
_SPACE = re.compile(r"\s+")
#: Evidence: a ratio within article or main counts so many times, one within an element of a boilerplate name so many;
#: one of nothing but links loses this share.
NAMED = 2.0
UNNAMED = 0.1
LINKED = 0.75


@dataclass
class _Element:
    tag: str
    path: str
    number: int
    prior: float  # 0: part of what is not the article
    link: bool  # within a link
    skipped: bool = False


@dataclass
class _Block:
    tag: str
    prior: float
    above: tuple[int, ...]  # numbers of its elements
    parts: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)  # of its text nodes
    linked: int = 0

    @cached_property
    def text(self) -> str:
        return _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()


def _prior(tag: str, attrs: str) -> float:
    """What an element's tag, role and names say of its text: 0 for what is never the article, ``UNNAMED`` for a boilerplate name, else 1."""
    if tag in _NOT_ARTICLE:
        return 0.0
    if not attrs or tag in ("html", "body", "article", "main"):
        return 1.0
    found = 1.0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in _ROLES:
            return 0.0
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 0.0
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 0.0
        if name in ("class", "id") and _NAMES.search(value.lower().replace("header", "") if tag in _HEADING else value):
            found = UNNAMED
    return found


def blocks(page: str) -> tuple[list[_Block], dict[int, tuple[int, str]]]:
    """Text blocks in page order, and each element's parent and tag by number."""
    stack = [_Element("", "", 0, 1.0, False)]
    elements: dict[int, tuple[int, str]] = {0: (0, "")}
    found: list[_Block] = []
    current: _Block | None = None
    number = 0
    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            if stack[-1].skipped:
                continue
            if current is None:
                if not text.strip():
                    continue
                top = next((e for e in reversed(stack) if e.tag in _BLOCK), stack[0])
                current = _Block(top.tag, stack[-1].prior, tuple(e.number for e in stack))
                found.append(current)
            current.parts.append(text)
            letters = len(text.strip())
            if letters:
                current.paths.append(stack[-1].path)
                if stack[-1].link:
                    current.linked += letters
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing = bool(m["close"] or m["close2"])
        if tag in _VOID or tag == "p" and closing and not any(e.tag == "p" for e in stack):
            if tag == "br" and current is not None:
                current.parts.append(" ")
            elif tag in _BLOCK:
                current = None
            continue
        if closing:
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if at:
                if any(e.tag in _BLOCK and not e.skipped for e in stack[at:]):
                    current = None
                del stack[at:]
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in _SELF_CLOSED and attrs.endswith("/"):
            continue
        if tag in _SKIPPED or stack[-1].skipped:
            number += 1
            elements[number] = (stack[-1].number, tag)
            stack.append(_Element(tag, f"{stack[-1].path}/{tag}", number, 0.0, stack[-1].link, True))
            continue
        if tag in _BLOCK:
            current = None
            if any(e.tag == "p" for e in stack):
                del stack[next(k for k, e in enumerate(stack) if e.tag == "p") :]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _ENDS.get(tag, ()):
                    del stack[k:]
                    break
                if stack[k].tag in _LISTS and tag not in ("td", "th", "tr") or stack[k].tag == "table":
                    break
        number += 1
        prior = min(stack[-1].prior, _prior(tag, attrs))
        if current is not None and prior != current.prior:
            current = None
        elements[number] = (stack[-1].number, tag)
        stack.append(_Element(tag, f"{stack[-1].path}/{tag}", number, prior, stack[-1].link or tag == "a"))
    return found, elements


def path_scores(found: list[_Block], spread: float = 1.0) -> np.ndarray:
    """Fused tag-path ratio of each block: aggregated per path, smoothed along the page."""
    length: dict[str, float] = defaultdict(float)
    marks: dict[str, float] = defaultdict(float)
    nodes: dict[str, int] = defaultdict(int)
    shares = []
    for b in found:
        text = b.text
        paths = b.paths or [""]
        for p in set(paths):
            share = paths.count(p) / len(paths)
            length[p] += len(text) * share
            marks[p] += len(_MARKS.findall(text)) * share
            nodes[p] += 1
        shares.append(paths)
    if not found:
        return np.zeros(0)
    by_length = np.array([sum(length[p] / nodes[p] for p in paths) / len(paths) for paths in shares])
    by_marks = np.array([sum(marks[p] / nodes[p] for p in paths) / len(paths) for paths in shares])
    kernel = np.exp(-0.5 * (np.arange(-1, 2) / spread) ** 2)
    kernel /= kernel.sum()

    def smooth(x: np.ndarray) -> np.ndarray:
        return np.convolve(np.pad(x, 1, mode="edge"), kernel, mode="valid")

    return np.sqrt(smooth(by_length) * smooth(by_marks))


def main_text(page: str | None, strictness: float = 0.5) -> str:
    """The article's blocks, joined by an empty line."""
    found, elements = blocks(page or "")
    found = [b for b in found if b.text]
    if not found:
        return ""
    ratios = path_scores(found)
    inside = [k for k, b in enumerate(found) if b.prior]
    if not inside:
        return ""
    threshold = strictness * float(np.std(ratios))
    named = [any(elements[e][1] in ("article", "main") for e in b.above) for b in found]
    scores = ratios * [(1 - LINKED * min(1.0, b.linked / len(b.text))) * (NAMED if n else 1.0) * b.prior for b, n in zip(found, named)]
    by_path: dict[tuple[str, float], list[float]] = defaultdict(list)  # what has another prior is another path
    at = [(b.paths[0] if b.paths else "", b.prior) for b in found]
    for k in inside:
        by_path[at[k]].append(scores[k])
    clear = [scores[k] for k in inside if found[k].prior == 1 and scores[k] >= threshold]
    high = max(threshold, float(np.median(clear)) / 2) if clear else threshold  # what has a boilerplate name must stand out
    over = {p for p, x in by_path.items() if sum(x) / len(x) >= (threshold if p[1] == 1 else high)}
    content = [k for k in inside if at[k] in over] or inside
    box = max(set(found[content[0]].above).intersection(*(found[k].above for k in content)), default=0)
    chosen = set(content)
    # Within the article short text stays, whatever its ratio: only a prior or a share of links of half or more speaks against it.
    # Where nothing but the whole page holds all content, that is the text between the first and the last of it and in its elements.
    loose = elements[box][1] in ("", "html", "body")
    around = {e for k in content for e in found[k].above if e > box}
    kept = [
        found[k].text for k in inside
        if box in found[k].above and (k in chosen or found[k].prior == 1 and (
            found[k].tag in _HEADING or scores[k] >= threshold and (found[k].tag == "p" or 2 * found[k].linked < len(found[k].text))
            or 2 * found[k].linked < len(found[k].text) and (not loose or content[0] < k < content[-1] or not around.isdisjoint(found[k].above))
        ))
    ]
    return "\n\n".join(kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        _extracted, "page_id long, url string, text string, n_chars long"
    )
