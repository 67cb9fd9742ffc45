"""Main text of HTML pages by tag-path ratios (operator 3).

A page is read as blocks of text; a block's *tag path* is the chain of block
elements from the root to it.  Per path: text length, punctuation, link text
and number of blocks.  The ratios (length per block, punctuation per block)
are fused into a score, weighted by what the path says about its role, and
smoothed over neighbouring blocks.  Inside an article or main element every
path with a score is content; elsewhere, with bounded ratios, those whose score
reaches a share of the best one, and the lists and tables beside their
paragraphs.  The blocks of content are the main text, in page order.

The work is one pass per page, without a shuffle.  Defined results: null or
empty HTML and pages without content give an empty text; broken markup is read
as browsers do (implied end tags, unclosed elements, cut-off tags); extra
columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["Block", "blocks", "path_scores", "main_text", "extract"]

# Element names of the HTML standard, by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea noscript noembed noframes iframe xmp template".split())
#: Elements that never hold main text.
BOILERPLATE = frozenset("nav footer aside form button select menu dialog svg canvas object audio video map head header search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class and id that name boilerplate.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side widget widgets menu nav "
    "navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup login related recommended recommendations share sharing social "
    "toolbar pagination pager search disclaimer paywall skip hidden bottom copyright".split())
DISCUSSION = re.compile(r"(comment|repl(y|ies)|discussion|disqus|respond|feedback)", re.I)
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
           "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
SCOPE = frozenset("html table td th caption object template button".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。、！？；：]")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    link_chars: int
    weight: float       # 0: boilerplate by its elements; 1 else
    inside: bool        # within article or main


@dataclass
class _Open:
    name: str
    label: str | None   # None for inline elements
    out: bool           # boilerplate
    inside: bool
    link: bool
    talk: bool          # reader comments
    head: bool = False  # the header of an article: only its headings count


@dataclass
class _Page:
    stack: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    found: list[Block] = field(default_factory=list)

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.stack[-1] if self.stack else None
                path = tuple(e.label for e in self.stack if e.label)
                skip = top and top.head and not any(re.fullmatch("h[1-6]", e.name) for e in self.stack)
                self.found.append(Block(path, text, min(self.linked, len(text)), 0.0 if top and (top.out or skip) else 1.0,
                                        bool(top and top.inside)))
            self.parts, self.linked = [], 0

    def pop_to(self, at: int):
        if any(e.label for e in self.stack[at:]):
            self.flush()
        del self.stack[at:]

    def close(self, names, stops):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name in names:
                self.pop_to(i)
                return self.close(names, stops) if len(names) > 1 else None
            if self.stack[i].name in stops:
                return None

    def start(self, name: str, attributes: str):
        if name in BLOCK:
            self.flush()
            self.close({"p"}, SCOPE)
            if re.fullmatch("h[1-6]", name):
                self.close({"h1", "h2", "h3", "h4", "h5", "h6"}, BLOCK - {"h1", "h2", "h3", "h4", "h5", "h6"})
        if name in IMPLIED:
            self.close(*IMPLIED[name])
        if name == "br":
            self.parts.append(" ")
        if name in VOID:
            return
        up = self.stack[-1] if self.stack else _Open("", None, False, False, False, False)
        marks = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip("/ \t\n") else {}
        names = f"{marks.get('class', '')} {marks.get('id', '')}"
        talk = up.talk or bool(DISCUSSION.search(names)) and name not in ("html", "body", "main")
        out = up.out or talk or name in BOILERPLATE
        head = up.head
        if name == "header" and up.inside and not up.out:
            out, head = talk, True
        if name not in ("html", "body", "main", "article"):
            out = out or marks.get("role", "").lower() in ROLES or "hidden" in marks or marks.get("aria-hidden", "").lower() == "true" \
                or "display:none" in marks.get("style", "").replace(" ", "").lower()
            if not out and names.strip():
                for token in names.split():
                    words = [w.lower() for w in _WORD.findall(token)]
                    if WORDS.intersection(words) and words[0] not in ("has", "with", "no", "without", "is") and not {"article", "content", "main", "body", "post", "entry"} & set(words):
                        out = True
        elif name in ("main", "article") and not talk:
            out = False  # an unclosed menu or advert before it does not swallow the article
        label = None
        if name in BLOCK:
            first = marks.get("class", "").split()
            label = f"{name}.{first[0]}" if first else name
        self.stack.append(_Open(name, label, out, up.inside or name in ("main", "article"), up.link or name == "a", talk, head))

    def end(self, name: str):
        if name == "br":
            self.parts.append(" ")
        for i in range(len(self.stack) - 1, -1, -1):
            e = self.stack[i]
            if e.name == name:
                return self.pop_to(i)
            if e.name in SCOPE and name not in ("html", "body", "table") or name not in BLOCK and e.label:
                return None

    def text(self, raw: str):
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.stack and self.stack[-1].link:
                self.linked += len(text)


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order, boilerplate included (weight 0)."""
    p, at = _Page(), 0
    while m := _TOKEN.search(page, at):
        p.text(page[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            p.end(name)
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        p.start(name, m[3] if m[2] else m[6])
    p.text(page[at:])
    p.pop_to(0)
    p.flush()
    return p.found


def path_scores(found: list[Block], most: tuple[float, float] = (math.inf, math.inf)) -> dict[tuple[str, ...], float]:
    """Fused, smoothed score of every tag path; ``most``: length and punctuation per block that count at most."""
    length, marks, linked, number, weight = (defaultdict(float) for _ in range(5))
    article = any(b.inside and b.weight for b in found)
    for b in found:
        length[b.path] += len(b.text)
        marks[b.path] += len(_PUNCTUATION.findall(b.text))
        linked[b.path] += b.link_chars
        number[b.path] += 1
        weight[b.path] = max(weight[b.path], b.weight * (b.inside or not article))
    fused = {}
    for p in number:
        text_ratio = math.log2(1 + min(length[p] / number[p], most[0]))
        mark_ratio = math.log2(2 + min(marks[p] / number[p], most[1]))
        share = linked[p] / length[p]
        fused[p] = weight[p] * text_ratio * mark_ratio * (0.0 if share > 0.5 else 1 - share)
    # smoothing: a path's score is the mean over its blocks of a weighted mean with the neighbours that are no boilerplate
    row = np.array([fused[b.path] for b in found])
    live = np.array([weight[b.path] > 0 for b in found], float)
    smooth, total = np.zeros(len(row)), np.zeros(len(row))
    for shift, w in ((-2, 0.5), (-1, 1.0), (0, 4.0), (1, 1.0), (2, 0.5)):
        a, b = slice(max(0, -shift), len(row) - max(0, shift)), slice(max(0, shift), len(row) - max(0, -shift))
        smooth[a] += w * row[b] * live[b]
        total[a] += w * live[b]
    smooth = np.where(row > 0, smooth / np.maximum(total, 1e-9), 0.0)
    out = defaultdict(float)
    for b, s in zip(found, smooth.tolist(), strict=True):
        out[b.path] += s / number[b.path]
    # a heading counts as much as the best path beside it: it belongs to what it heads
    beside = defaultdict(float)
    for p, s in out.items():
        beside[p[:-1]] = max(beside[p[:-1]], s)
    return {p: beside[p[:-1]] if s > 0 and p and re.match(r"h[1-6]\b", p[-1]) else s for p, s in out.items()}


#: Outside article and main elements: share of the best path's score that content reaches, and the length and punctuation
#: per block that count at most, so that one very long block does not raise the bar for paragraphs.
SHARE, BOUND = 0.6, (200.0, 4.0)
#: What stands beside paragraphs in the same container and is part of their text.
PARTS = frozenset("blockquote caption dd dl dt figcaption figure li ol p pre table tbody td tfoot th thead tr ul".split())


def _partner(path: tuple[str, ...], homes: set[tuple[str, ...]]) -> bool:
    """Whether the path leads through lists, tables, quotes and the like from a container of content."""
    at = len(path)
    while at and path[at - 1].split(".")[0] in PARTS:
        at -= 1
    return at < len(path) and path[:at] in homes


def main_text(page: str | None) -> str:
    """The blocks of the content paths, joined by line feeds: inside an article or main element every path that is no
    boilerplate and not mostly links; elsewhere the paths that come near the best one, and their lists and tables."""
    found = blocks(page) if page else []
    if not found:
        return ""
    if any(b.inside and b.weight for b in found):
        score = path_scores(found)
        return "\n".join(b.text for b in found if b.weight and b.inside and score[b.path] > 0)
    score = path_scores(found, BOUND)
    best = max(score.values())
    if best <= 0:
        return ""
    good = {p for p, s in score.items() if s >= best * SHARE}
    homes = {p[:-1] for p in good if p and p[-1].split(".")[0] == "p"}
    good |= {p for p, s in score.items() if s > 0 and _partner(p, homes)}
    return "\n".join(b.text for b in found if b.weight and b.path in good)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars of every page."""
    src = pages.select(*keep, F.col(html).cast("string").alias("html"))
    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, "text", "n_chars"]

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=names)

    return src.mapInArrow(run, f"{kinds}, text string, n_chars bigint")
