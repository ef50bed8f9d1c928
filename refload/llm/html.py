"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks. What is known of each block by itself (the elements around it, their classes,
links, length, punctuation) gives a log-odds score; it is the block's capacity to the source (content) or to the sink
(boilerplate). Blocks in a row are tied by edges that are the stronger the nearer they stand in the document tree, and so
are blocks of one parent. The minimum cut is the labelling that pays least for scores overruled and ties cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refload.llm.common import map_batches

#: A quote opens a value only right behind the equals sign; an unquoted value ends at white space or '>'.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)|[^>])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.DOTALL,
)
NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
RAW = set("script style noscript template textarea iframe svg title canvas annotation annotation-xml".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody"
    " td tfoot th thead tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends an open element of these kinds.
ENDS = {"p": BLOCKS - {"head", "body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ENDS |= {"tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"}}

#: Log-odds by element and by word in a class, id or role.
ELEMENTS = {"article": 6.0, "main": 5.0, "header": -9.0}
ELEMENTS |= dict.fromkeys("nav footer aside form menu select button dialog fieldset head option label legend".split(), -14.0)
AGAINST = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer foot sidebar side aside widget widgets rail"
    " ad ads adv advert adverts advertisement advertising adsbox adsense sponsor sponsored promo promotion banner cookie cookies consent"
    " gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended"
    " recommendations trending popular comment comments commentlist reply replies respond disqus form login search toolbar"
    " pagination pager tagcloud copyright legal disclaimer contentinfo complementary navigation hidden skip".split()
)
FOR = set("article content post entry story main body text prose".split())
#: With one of these a header is the article's own.
OWN_HEADER = set("article post entry story title".split())
#: Words that say what page surrounds an element, not what the element is: has-sidebar, with-comments, no-footer.
MODIFIERS = set("has with without no not non hide show is".split())
#: Last words of a name that leave its meaning to the word in front: footer-links, menu-item.
STRUCTURE = set(
    "list lists item items link links box bar wrapper wrap container area section block blocks panel inner outer group row col column"
    " left right top bottom button buttons icon icons slot unit count title heading posts articles stories module component".split()
)
#: Tags that a form has only where it goes round a page.
WRAPPED = re.compile(r"<(?:(/form)|(?:article|main|nav|header|footer|h1))\b", re.IGNORECASE)
ARTICLE = re.compile(r"<article\b", re.IGNORECASE)
#: A form round a page has running text: so many words, and so many for each of its fields; choices and scripts do not count.
FORM_WORDS, WORDS_A_FIELD = 60, 20
FORM_EDGE = re.compile(r"</?form\b", re.IGNORECASE)
FIELD = re.compile(r"<(?:textarea|select|button|input(?![^<>]*type\s*=\s*[\"']?hidden))\b", re.IGNORECASE)
SILENT = re.compile(r"<(script|style|select|textarea|nav|ul|ol)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>", re.IGNORECASE | re.DOTALL)
#: What every block gains where a page would else have no content at all: then unmarked blocks, however short, are it.
LENIENT = 2.5
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SMOOTH = 1.5
SIBLINGS = 0.5


def _names(words: list[str]) -> str | None:
    """The word of ``AGAINST`` that a class, id or role of these words is the name of, if it is one."""
    if not MODIFIERS.isdisjoint(words):
        return None
    k = len(words)
    while k > 1 and words[k - 1] in STRUCTURE:
        k -= 1
    return words[k - 1] if k and words[k - 1] in AGAINST else None


def _evidence(tag: str, attributes: str, inside: bool, wrapper: bool = False) -> tuple[float, float]:
    """What an element says about all that is in it: for good, and until an article or main in it says otherwise.

    ``inside``: it stands in an article; ``wrapper``: it is a form round a page.
    """
    score, names = ELEMENTS.get(tag, 0.0), 0.0
    if (tag == "header" and inside) or wrapper:
        score = 0.0
    if not attributes or tag in ("html", "body"):
        return score, names
    words: set[str] = set()
    against: set[str] = set()
    for name, *values in NAMED.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                score -= 14.0
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            score -= 14.0
        elif name in ("class", "id", "role"):
            for token in value.split():
                parts = WORD.findall(CAMEL.sub(" ", token).lower())
                words.update(parts)
                if found := _names(parts):
                    against.add(found)
    if against == {"header"} and (inside or words & OWN_HEADER):
        against = set()
    if against:
        names -= 12.0
    elif words & FOR:
        score += 3.0
    return score, names


def _text_forms(html: str) -> set[int]:
    """Starts of the forms that go round running text. Forms cannot nest: one ends where the next edge of a form stands."""
    edges = [(m.start(), m[0].startswith("</")) for m in FORM_EDGE.finditer(html)] + [(len(html), True)]
    found = set()
    for (start, closing), (end, _) in zip(edges, edges[1:], strict=False):
        if closing:
            continue
        words = len(SILENT.sub(" ", html[start:end]).split())
        if words >= FORM_WORDS and words >= WORDS_A_FIELD * len(FIELD.findall(html, start, end)):
            found.add(start)
    return found


def blocks(html: str) -> list[tuple[str, float, float, int]]:
    """(text, score, nearness to the block before, parent) of every block with text, in page order."""
    made: list[tuple[str, float, float, int]] = []
    # tag, evidence so far, in an article, number, part of the evidence that an article or main in it ends
    stack: list[tuple[str, float, bool, int, float]] = [("", 0.0, False, 0, 0.0)]
    formed = "<form" in html.lower()
    marks = [(m.start(), bool(m[1])) for m in WRAPPED.finditer(html)] if formed else []
    texts = _text_forms(html) if formed else set()
    spots = [m[0] for m in marks]
    single = len(ARTICLE.findall(html)) == 1
    pieces: list[str] = []
    linked = 0
    lowest = depth_before = count = 0

    def flush() -> None:
        nonlocal linked, lowest, depth_before
        text = " ".join(unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            place = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in BLOCKS), 0)
            tag, evidence = stack[place][0], stack[-1][1]
            words = text.count(" ") + 1
            share = min(1.0, linked / len(text))
            score = evidence - 4.0 * share + (2.0 if tag in HEADINGS and evidence > 0 else 0.0)
            score += min(words, 40) / 20 - 1.0 + (0.5 if text[-1] in ".!?:;\"'”»…)" else 0.0)
            if "©" in text or "all rights reserved" in text.lower():
                score -= 3.0
            steps = depth_before + place - 2 * min(lowest, place)
            made.append((text, score, 1.0 / (1 + steps), stack[max(place - 1, 0)][3]))
            lowest = depth_before = place
        linked = 0

    at, end = 0, len(html)
    anchors = 0
    while at < end:
        match = TAG.search(html, at)
        if match is None:
            rest = html[at:]
            pieces.append(rest if "<" not in rest or not re.search(r"<[a-zA-Z/]", rest) else rest[: re.search(r"<[a-zA-Z/]", rest).start()])
            break
        if match.start() > at:
            text = html[at : match.start()]
            pieces.append(text)
            if anchors:
                linked += len(text)
        at = match.end()
        tag = match[2] or match[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(match[1] or match[4])
        attributes = match[3] or match[6] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                close = re.compile(f"</{tag}\\b[^>]*>?", re.IGNORECASE).search(html, at)
                at = close.end() if close else end
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    anchors -= sum(s[0] == "a" for s in stack[k:])
                    del stack[k:]
                    lowest = min(lowest, len(stack) - 1)
                    break
        elif tag not in VOID:
            while len(stack) > 1 and tag in ENDS.get(stack[-1][0], ()):
                anchors -= stack[-1][0] == "a"
                stack.pop()
            if tag in BLOCKS:  # formatting left open inside a paragraph ends with it
                k = len(stack) - 1
                while k > 0 and stack[k][0] not in BLOCKS:
                    k -= 1
                if k and tag in ENDS.get(stack[k][0], ()):
                    anchors -= sum(s[0] == "a" for s in stack[k:])
                    del stack[k:]
            lowest = min(lowest, len(stack) - 1)
            if not attributes.endswith("/") or tag in BLOCKS:
                count += 1
                _, before, inside, _, open_names = stack[-1]
                if tag == "main" or (tag == "article" and single):
                    before, open_names = before - open_names, 0.0
                k = bisect_right(spots, match.start()) if tag == "form" else len(marks)
                wrapper = tag == "form" and (match.start() in texts or (k < len(marks) and not marks[k][1]))
                lasting, names = _evidence(tag, attributes, inside, wrapper)
                stack.append((tag, before + lasting + names, inside or tag in ("article", "main"), count, open_names + names))
                anchors += tag == "a"
    flush()
    return made


def content_side(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of the minimum cut: True on the source's side. Dinic's method, with lists for the residual graph."""
    n = len(scores)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def tie(i: int, j: int, forward: float, back: float) -> None:
        heads[i].append(len(to))
        to.append(j)
        room.append(forward)
        heads[j].append(len(to))
        to.append(i)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            tie(source, i, s, 0.0)
        elif s < 0:
            tie(i, sink, -s, 0.0)
    for i, j, w in edges:
        tie(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for e in heads[i]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nexts = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                at = to[path[full] ^ 1]
                del path[full:]
                continue
            while nexts[at] < len(heads[at]):
                e = heads[at][nexts[at]]
                if room[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    break
                nexts[at] += 1
            if nexts[at] < len(heads[at]):
                path.append(heads[at][nexts[at]])
                at = to[path[-1]]
            elif at == source:
                break
            else:
                level[at] = -1
                at = to[path.pop() ^ 1]


def main_text(html: str | None) -> tuple[str, int, int]:
    """(text, blocks kept, blocks) of a page."""
    found = blocks(html or "")
    edges, last = [], {}
    for i, (_, _, near, parent) in enumerate(found):
        if i:
            edges.append((i - 1, i, SMOOTH * near))
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, SIBLINGS))
        last[parent] = i
    labels = content_side([b[1] for b in found], edges) if found else []
    if not any(labels):
        labels = content_side([b[1] + LENIENT for b in found], edges) if found else []
    kept = [b[0] for b, keep in zip(found, labels, strict=True) if keep]
    return "\n".join(kept), len(kept), len(found)


def extract_pages(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, and text, n_chars, n_kept, n_blocks: one row for every row of ``pages``.

    A class, id or role speaks against what is in it where it names the element itself (its last word that says
    more than "list" or "box"); has-, with- and no- name something else. main, and the article of a page that has
    one, take back what such names around them say; what elements say (nav, aside, hidden) stays. A form that goes
    round headings, articles, menus or running text is the page, not a form. Where nothing would be content, blocks that
    nothing speaks against are, however short.

    Null and empty pages, and pages without content, have the empty text. Unclosed elements end with what holds them;
    a page cut short is read to its end. Character references are decoded in text, runs of white space become one
    space, blocks are joined by a line feed. A page's cost is about linear in its length.
    """
    kept = [f for f in pages.schema.fields if f.name in keep]
    columns = [F.col(f.name).alias(f"k{i}") for i, f in enumerate(kept)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [main_text(h) for h in batch.column("html").to_pylist()]
        arrays = [batch.column(f"k{i}") for i in range(len(kept))]
        arrays += [pa.array([m[0] for m in made], pa.string()), pa.array([len(m[0]) for m in made], pa.int64())]
        arrays += [pa.array([m[k] for m in made], pa.int32()) for k in (1, 2)]
        names = [f"k{i}" for i in range(len(kept))] + ["text", "n_chars", "n_kept", "n_blocks"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "".join(f"k{i} {f.dataType.simpleString()}, " for i, f in enumerate(kept))
    done = map_batches(pages.select(*columns, F.col(html_column).alias("html")), run, f"{schema}text string, n_chars long, n_kept int, n_blocks int")
    return done.select(*[F.col(f"k{i}").alias(f.name) for i, f in enumerate(kept)], "text", "n_chars", "n_kept", "n_blocks")
