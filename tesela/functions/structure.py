"""Structure of legal text in plain Python: cleaning, boundaries, outline, hierarchical pieces. No Spark in here.

Everything works on spans of one text at a time and is called from batches (see ``operators.chunk``).
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

GAP = "\n\n"
# Patterns by which the kinds of lines are told apart, in the order they are tried.
LINE_KINDS = (
    ("numbered", re.compile(r"^\s*(?:\d{1,4}[.)]|[ivxlcdmIVXLCDM]+[.)]|art(?:ículo|iculo)?\.?\s*\d+)", re.I)),
    ("item", re.compile(r"^\s*[a-z]{1,2}[.)]\s")),
    ("heading", re.compile(r"^#{1,6}\s+")),
    ("heading", re.compile(r"^\d+(\.\d+)*[.):]?\s|\b[A-Z][A-Za-zÀ-ÿ0-9 ]{3,50}:$", re.A)),
    ("list", re.compile(r"^\s*(?:[-*•·])\s+")),
)
KIND_RANK = {"numbered": 5, "item": 4, "heading": 4, "list": 3, "paragraph": 2, "page": 1}
# Fixed value: lines whose breaks stay when a legal text is cleaned.
KEEP_BREAK = re.compile(
    r"^(\d{1,4}[.)]|[a-z]{1,2}\)|[ivxlcdm]{2,8}[.)]|art(?:[ií]culo|iculo)?\.?\s*\d+|#{1,6}\s+|[-*•·]\s+|(?:T[IÍ]TULO|CAP[IÍ]TULO|SECCI[OÓ]N|ANEXO|PARTE|LEY|DECRETO|DISPOSICIONES?)(?a:\b)|[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ]{3,48}:)",
    re.I,
)
# The levels of a norm, their rank and the lines that open them, in the order they are tried.
LEVELS = (
    ("ley", 1, re.compile(r"^(?:LEY|DECRETO-LEY)\s+(?:N[°º]\.?\s*)?([0-9]+(?:\.[0-9]+)*|[IVXLCDM]+)", re.I)),
    ("decreto", 2, re.compile(r"^DECRETO\s+(?:N[°º]\.?\s*)?(\d+(?:\.\d+)*|[IVXLCDM]+)", re.I)),
    ("titulo", 3, re.compile(r"^T[IÍ]TULO\s+([IVXLCDM]+|\d+)", re.I)),
    ("capitulo", 4, re.compile(r"^(?:CAP[IÍ]TULO|CAP\.)\s+([IVXLCDM]+|\d+)", re.I)),
    ("seccion", 5, re.compile(r"^SECCI[OÓ]N\s+([IVXLCDM]+|\d+)", re.I)),
    ("seccion", 5, re.compile(r"^DISPOSICIONES?(?:\s+(?:GENERALES|TRANSITORIAS|COMPLEMENTARIAS|ADICIONALES|FINALES|MODIFICATORIAS))?", re.I)),
    ("anexo", 6, re.compile(r"^ANEXO\s+([IVXLCDM]+|\d+|[A-Za-zÀ-ÿ]{1,3})(?:[\s.:-]|$)", re.I)),
    ("articulo", 6, re.compile(r"^ART(?:[IÍ]CULO|ICULO)?\.?\s+(\d+)", re.I)),
    ("inciso", 7, re.compile(r"^(?:Inciso|NUMERAL|INCISO)\s+([a-zA-Z0-9]+)", re.I)),
)
# Fixed value: the end of a line of a table of contents.
PAGE_NUMBER = re.compile(r"(?:\.{2,}\s*|\s{2,})\d{1,3}\s*\.?\s*$", re.A)


@dataclass(frozen=True)
class Strategy:
    """Sizes of a way of splitting. ``by_article``: one parent an article; ``clean``: lines are joined first."""

    name: str
    parent_max: int
    child_max: int
    child_min: int = 150
    by_article: bool = False
    clean: bool = False


GENERIC = Strategy("generic", 2500, 1000)
LEGAL = Strategy("legal", 3500, 1200, by_article=True, clean=True)
STRATEGIES = {s.name: s for s in (GENERIC, LEGAL)}


@dataclass
class Span:
    text: str
    start: int
    end: int
    kind: str | None = None


@dataclass
class Parent:
    text: str
    index: int
    start: int
    first_child: int = 0
    last_child: int = 0


@dataclass
class Child:
    text: str
    index: int
    parent: int
    start: int
    end: int
    path: str | None = None
    extended: str | None = None


@dataclass
class Split:
    parents: list[Parent] = field(default_factory=list)
    children: list[Child] = field(default_factory=list)


# --- cleaning --------------------------------------------------------------------------------------------------------------

_BREAK = re.compile(r"-( *)\n( *)|\n")


def _word(c: str) -> bool:
    return c == "_" or (c.isascii() and c.isalnum())


def clean(text: str) -> tuple[str, np.ndarray]:
    """The text with broken words joined and lines flowed, and for each of its characters the offset in the original.

    Breaks of paragraphs and beside structural lines stay.
    """
    parts: list[str] = []
    maps: list[np.ndarray] = []
    at = 0

    def keep(a: int, b: int) -> None:
        if b > a:
            parts.append(text[a:b])
            maps.append(np.arange(a, b))

    def structural(line: str) -> bool:
        return KEEP_BREAK.match(line.strip()) is not None

    pos = 0
    while m := _BREAK.search(text, pos):
        a, b = m.span()
        if m.group(0)[0] == "-":
            if a > 0 and b < len(text) and _word(text[a - 1]) and _word(text[b]):
                keep(at, a)
                at = pos = b
            else:
                pos = a + 1
            continue
        pos = b
        if text[a - 1 : a] == "\n" or text[b : b + 1] == "\n":
            continue
        following = re.compile(r"[ \t]*").match(text, b).end()
        end = text.find("\n", following)
        line_before = text[text.rfind("\n", 0, a) + 1 : a]
        if structural(line_before) or structural(text[following : end if end >= 0 else following + 60]):
            continue
        keep(at, a)
        parts.append(" ")
        maps.append(np.array([a]))
        at = b
    keep(at, len(text))
    out = "".join(parts)
    index = np.concatenate(maps) if maps else np.empty(0, np.int64)
    lead = len(out) - len(out.lstrip(" "))
    body = out.strip(" ")
    return body, index[lead : lead + len(body)]


def original_offset(index: np.ndarray, at: int, length: int) -> int:
    """Offset in the original of an offset in the cleaned text; ends map behind the last character."""
    if not len(index):
        return length
    if at >= len(index):
        return int(index[-1]) + 1
    return int(index[max(at, 0)])


# --- boundaries and outline -------------------------------------------------------------------------------------------------


def line_spans(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        out.append((at, end))
        at = end + 1
    return out


def boundaries(text: str, kinds: set[str] | None = None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, label) of the places where structure begins, the most specific kind at each offset."""
    found: dict[int, tuple[int, int, str, str]] = {}

    def add(start: int, end: int, kind: str, label: str) -> None:
        if kinds is not None and kind not in kinds:
            return
        known = found.get(start)
        if known is None or KIND_RANK[kind] > KIND_RANK[known[2]]:
            found[start] = (start, end, kind, label)

    for m in re.finditer(r"\A\s*(?=\S)|\n[ \t]*\n\s*(?=\S)", text):
        add(m.end(), m.end(), "paragraph", text[m.end() : m.end() + 48])
    for m in re.finditer("\f", text):
        add(m.end(), m.end(), "page", "página")
    for a, b in line_spans(text):
        line = text[a:b]
        if not line.strip():
            continue
        for kind, pattern in LINE_KINDS:
            if pattern.search(line):
                add(a, b, kind, line.strip()[:48])
                break
    return [found[k] for k in sorted(found)]


def outline(text: str | None) -> list[tuple[int, str, int, str]]:
    """(start, level, rank, label) of the lines that open a level of the norm."""
    out = []
    for a, b in line_spans(text or ""):
        line = text[a:b]
        for level, rank, pattern in LEVELS:
            m = pattern.match(line)
            if m:
                number = m.group(1) if pattern.groups else ""
                out.append((a, level, rank, f"{level.upper()} {number.upper()}".strip()))
                break
    return out


def path_at(nodes: list[tuple[int, str, int, str]], offset: int) -> str:
    """Open ancestors at an offset from the highest level down: of each rank the last node that no higher one closed."""
    n = bisect.bisect_right([x[0] for x in nodes], offset)
    path, lowest = [], 99
    for _, _, rank, label in reversed(nodes[:n]):
        if rank < lowest:
            path.append(label)
            lowest = rank
    return " > ".join(reversed(path))


# --- pieces -----------------------------------------------------------------------------------------------------------------


def _trimmed(text: str, a: int, b: int, kind: str | None = None) -> Span | None:
    raw = text[a:b]
    body = raw.strip()
    if not body:
        return None
    lead = len(raw) - len(raw.lstrip())
    return Span(body, a + lead, a + lead + len(body), kind)


def segments(text: str) -> list[Span]:
    """The text between boundaries, each with the kind of the boundary it begins at."""
    marks = {b[0]: b[2] for b in boundaries(text)}
    cuts = sorted({0, *marks, len(text)})
    spans = (_trimmed(text, a, b, marks.get(a) if a else None) for a, b in zip(cuts, cuts[1:]))
    return [s for s in spans if s]


_STOP = re.compile(r"[.;:!?](?=\s|\Z)")


def long_pieces(text: str, limit: int) -> list[Span]:
    """Pieces of at most ``limit``: cut at the last line break, else the last end of a sentence, else the last blank, else hard."""
    out, at = [], 0
    while at < len(text):
        stop = at + limit
        if stop < len(text):
            window = text[at:stop]
            line, blank = window.rfind("\n"), window.rfind(" ")
            ends = [m.end() for m in _STOP.finditer(window)]
            stop = at + (line if line > 0 else ends[-1] if ends else blank if blank > 0 else limit)
        stop = min(stop, len(text))
        body = text[at:stop].strip()
        if body:
            out.append(Span(body, at, stop))
        at = stop
    return out


def _joined(spans: list[Span]) -> Span:
    return Span(GAP.join(s.text for s in spans), spans[0].start, spans[-1].end)


@dataclass(frozen=True)
class Place:
    """Where a span goes: the number of its piece, the size of the piece up to here, and whether the piece ends with it."""

    piece: int = 0
    size: int = 0
    full: bool = True


def _places(spans: list[Span], limits: list[int], opens: list[bool], head_stays: bool) -> list[Place]:
    """The piece of each span, by one fold: a piece is left where the span opens a new one, doesn't fit, or the piece is full.

    A span above its limit fills a piece by itself, with what is pending before it if ``head_stays``.
    """

    def put(at: Place, i: int) -> Place:
        size, too_long = len(spans[i].text), len(spans[i].text) > limits[i]
        fits = head_stays if too_long else at.size + len(GAP) + size <= limits[i]
        if at.full or opens[i] or not fits:
            return Place(at.piece + 1, size, too_long)
        return Place(at.piece, at.size + len(GAP) + size, too_long)

    return list(itertools.accumulate(range(len(spans)), put, initial=Place()))[1:]


def _pieces(spans: list[Span], limits: list[int], opens: list[bool], head_stays: bool) -> list[Span]:
    """Spans put together by their places; a piece above the limit of its last span is cut into long pieces."""
    out: list[Span] = []
    placed = zip(_places(spans, limits, opens, head_stays), spans, limits)
    for _, group in itertools.groupby(placed, lambda x: x[0].piece):
        members = list(group)
        whole, limit = _joined([s for _, s, _ in members]), members[-1][2]
        long = members[-1][0].full
        out += [Span(p.text, whole.start + p.start, whole.start + p.end) for p in long_pieces(whole.text, limit)] if long else [whole]
    return out


def structural_pieces(text: str, limit: int, least: int = 1, size_for: Callable[[str], int] | None = None) -> list[Span]:
    """Pieces of at most ``limit`` along boundaries; numbered provisions always begin a new one."""
    spans = segments(text)
    limits = [size_for(s.text) if size_for else limit for s in spans]
    return [p for p in _pieces(spans, limits, [s.kind == "numbered" for s in spans], True) if len(p.text.strip()) >= least]


def grouped(blocks: list[str], limit: int) -> list[Span]:
    """Blocks packed in order up to the limit."""
    n = len(blocks)
    return _pieces([Span(b, 0, len(b)) for b in blocks], [limit] * n, [False] * n, False)


def merged_short(spans: list[Span], least: int) -> list[Span]:
    """Pieces below the minimum go in front of the next one."""
    if not spans:
        return []
    glue = ["", *("" if a.text.endswith("\n") or b.text.startswith("\n") else " " for a, b in itertools.pairwise(spans))]
    # the length of the piece up to each span: it goes on as long as it is short
    sizes = itertools.accumulate(zip(glue, spans), lambda n, x: len(x[1].text) + (n + len(x[0]) if n < least else 0), initial=least)
    number = list(itertools.accumulate(int(n >= least) for n in list(sizes)[:-1]))
    out = []
    for _, group in itertools.groupby(range(len(spans)), number.__getitem__):
        i, *rest = group
        body = "".join([spans[i].text, *(glue[k] + spans[k].text for k in rest)])
        out.append(Span(body, spans[i].start, spans[rest[-1] if rest else i].end))
    return out


#: Signs by which the nodes of an outline are written as a string; upper case where text stands between a node and the one before.
SIGNS = {"articulo": "a", "anexo": "x", "ley": "h", "decreto": "h", "titulo": "h", "capitulo": "h", "seccion": "h"}
#: Headings in a row, with nothing but blank lines between them, and the article below.
_SECTION = re.compile(r"(?P<run>[hH]h*)?(?P<article>[aA])|(?P<annex>[xX])")
#: Numbered lines in a row from the first four on; shorter rows before them end in a line without number.
_CONTENTS = re.compile(r"(?:[oO]|[nN]n{0,2}o)*(?P<run>[nN]n{3,})")


def _signed(text: str, nodes: list[tuple[int, str, int, str]], signs: list[str]) -> str:
    """The signs of nodes as a string, in upper case after text."""
    ends = [text.find("\n", n[0]) for n in nodes]
    apart = [False, *(e >= 0 and text[e : n[0]].strip() != "" for e, n in zip(ends, nodes[1:]))]
    return "".join(s.upper() if x else s for s, x in zip(signs, apart))


def contents_lines(text: str, nodes: list[tuple[int, str, int, str]]) -> set[int]:
    """Starts of the lines of a table of contents: four or more structural lines in a row that end in a page number."""
    lines = [text[n[0] :].split("\n", 1)[0] for n in nodes]
    row = _CONTENTS.match(_signed(text, nodes, ["n" if PAGE_NUMBER.search(x) else "o" for x in lines]))
    return {n[0] for n in nodes[slice(*row.span("run"))]} if row else set()


def article_starts(text: str, nodes: list[tuple[int, str, int, str]], skipped: set[int]) -> list[int]:
    """Where articles and annexes begin, with the headings that stand directly above an article.

    Text between a heading and the first article makes the heading part of the preamble.
    """
    # a line of contents parts what is around it and is no node
    kept = [n for n in nodes if n[1] in SIGNS or n[0] in skipped]
    signed = _signed(text, kept, ["." if n[0] in skipped else SIGNS[n[1]] for n in kept])
    found = list(_SECTION.finditer(signed))
    first = next((m for m in found if m["article"]), None)
    starts = []
    for m in found:
        headed = m["run"] and (m is not first or m["article"] == "a")
        starts.append(kept[m.start() if headed or m["annex"] else m.start("article")][0])
    return starts


def article_pieces(text: str, limit: int = 1 << 60, least: int = 1, pdf: bool = False) -> list[Span] | None:
    """One piece an article or annex, the headings above it attached; the preamble by itself. None without articles and annexes."""
    nodes = outline(text)
    if not {"articulo", "anexo"} & {n[1] for n in nodes}:
        return None
    starts = article_starts(text, nodes, contents_lines(text, nodes) if pdf else set())
    out: list[Span] = []
    for a, b in itertools.pairwise([0, *starts, len(text)]):
        whole = _trimmed(text, a, b)
        if whole and len(whole.text) > limit:
            out += [Span(p.text, a + p.start, a + p.end) for p in structural_pieces(text[a:b], limit, least)]
        elif whole and len(whole.text) >= least:
            out.append(whole)
    return out


# --- page text --------------------------------------------------------------------------------------------------------------

# Lines of page text.
_FOOTER = re.compile(r"^-+\s*\d+\s+of\s+\d+\s*-+$", re.I)
_NUMBERED = re.compile(r"^\d+(\.\d+)*[.):]?\s|\b[A-Z][A-Za-zÀ-ÿ0-9 ]{3,50}:$", re.A)
_INDEX = re.compile(r"^\d+(\.\d+)*[.)]?\s+[A-Za-zÀ-ÿ0-9].{0,140}$")
_OPENS_BODY = re.compile(r"^(ART[IÍ]CULO|CAP[IÍ]TULO|T[IÍ]TULO|SECCI[OÓ]N|ANEXO|Anexo|Cap[íi]tulo|T[íi]tulo|Secci[óo]n)(?a:\b)", re.I)


def page_fragments(text: str, limit: int = 1200, least: int = 20) -> list[str]:
    """Fragments of page text by lines: begun at headings or at the limit, without footers and the contents before the body."""
    lines = [x.strip() for x in re.split(r"\r?\n", text)]
    lines = [x for x in lines if x and not _FOOTER.match(x)]
    body = next((i for i, x in enumerate(lines) if _OPENS_BODY.match(x)), len(lines))
    heads = [bool(_NUMBERED.search(x)) for x in lines]
    drop = {i for i in range(min(body, len(lines) - 1)) if heads[i] and heads[i + 1] and _INDEX.match(lines[i])}
    out: list[list[str]] = []
    size = 0
    for i, x in enumerate(lines):
        if i in drop:
            continue
        if not out or heads[i] or size + len(x) > limit:
            out.append([])
            size = 0
        out[-1].append(x)
        size += len(x)
    return [f for f in ("\n".join(p).strip() for p in out) if len(f) >= least]


def is_pdf(mime: str | None) -> bool:
    return "pdf" in (mime or "").lower()


def block_paragraphs(text: str, mime: str = "", least: int = 20) -> list[str]:
    """Paragraphs of a text; of page text its fragments."""
    if is_pdf(mime):
        return page_fragments(text)
    blocks = (p.strip() for p in re.split(r"\n\s*\n", text))
    return [p for p in blocks if len(p) >= least and not re.match(r"#{1,6}\s", p)]


def _slices(text: str, limit: int, mime: str | None, size_for: Callable[[str], int] | None) -> list[Span]:
    if not is_pdf(mime):
        return structural_pieces(text, limit, size_for=size_for)
    out, at = [], 0
    for g in grouped(page_fragments(text), limit):
        out.append(Span(g.text, at, at + len(g.text)))
        at += len(g.text) + len(GAP)
    return out


def hierarchy(text: str, mime: str = "", parent_max: int = 1800, child_max: int = 450, child_min: int = 80, parents: list[Span] | None = None, size_for: Callable[[str], int] | None = None) -> Split:
    """Parents and their children, numbered through; short children go with the next one."""
    out = Split()
    for number, p in enumerate(parents if parents is not None else _slices(text, parent_max, mime, size_for)):
        first = len(out.children)
        for c in merged_short(_slices(p.text, child_max, None, size_for), child_min):
            start = p.start + c.start
            out.children.append(Child(c.text, len(out.children), number, start, p.start + c.end))
        out.parents.append(Parent(p.text, number, p.start, first, max(first, len(out.children) - 1)))
    return out


def split_document(text: str, strategy: Strategy, mime: str = "", overlap: int = 0, size_for: Callable[[str], int] | None = None, **sizes: int) -> tuple[Split, np.ndarray | None]:
    """Hierarchical split of a document by a strategy, with structural paths and overlaps, and the map of the cleaned text."""
    prepared, index = clean(text) if strategy.clean else (text, None)
    parent_max = sizes.get("parent_max", strategy.parent_max)
    articles = article_pieces(prepared, parent_max, pdf=is_pdf(mime)) if strategy.by_article else None
    out = hierarchy(prepared, mime, parent_max, sizes.get("child_max", strategy.child_max), sizes.get("child_min", strategy.child_min), articles, size_for)
    nodes = outline(prepared) if strategy.name == "legal" else []
    for c in out.children:
        c.path = (path_at(nodes, c.start) or None) if nodes else None
        c.extended = prepared[max(0, c.start - overlap) : c.end] if overlap else None
    return out, index


def line_of(starts: list[int], offset: int) -> int:
    """Line number (from 1) of an offset, ``starts`` being the offsets of the lines."""
    return bisect.bisect_right(starts, offset)
