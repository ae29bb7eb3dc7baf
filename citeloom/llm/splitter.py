"""Problem 2: cut oversized texts at natural boundaries, by structure-tree packing.

A text is parsed into a tree. Headings (Markdown, underlined, HTML) own what follows up to the next heading of their level or a higher one; list items own
their deeper items and continuation lines; fenced code, tables, HTML blocks and paragraphs (blank lines) are leaves. Inside leaves come lines, sentences,
clauses, words, and for a word longer than a piece single characters. A subtree that fits stays whole; only an oversized one is descended
into. On the way up adjacent siblings are merged as long as they fit. A heading, and a short lead of a list (a paragraph or item before deeper
items), stays with the beginning of what it leads, whatever the level that has to be cut. Each piece after the first is preceded by the last
``overlap`` characters before it, less the part of a word they begin with; they count towards the limit.

Scale: a narrow map. Short texts never leave the JVM; only rows over the limit go to Python, in Arrow batches, each text in
time linear in its length.

Defined results: lengths are code points; white space at both ends is dropped; null, empty and blank texts give no piece;
repeated rows are cut each; an empty table gives no rows. Output columns are ``keep`` plus ``piece_no`` (from 1),
``n_pieces``, ``start_at``, ``end_at`` (the new part, in the stripped text) and ``piece``; a ``keep`` column of such a name is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Inside a leaf: ends of a node's children, level by level; each match ends a child.
LEVELS = (
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+|[。！？]+"),
    re.compile(r"[;:,，；：][\"'”’»)\]]*\s+|\s[–—]\s"),
    re.compile(r"\s+"),
)
PIECES = {"piece_no": T.IntegerType(), "n_pieces": T.IntegerType(), "start_at": T.IntegerType(), "end_at": T.IntegerType(), "piece": T.StringType()}


#: Starts of blocks: fences, headings, list items, table rows.
FENCE = re.compile(r" {0,3}(```+|~~~+)")
HEADING = re.compile(r" {0,3}(#{1,6})(?=[ \t\n])")
UNDERLINE = re.compile(r" {0,3}(=+|-{2,})[ \t]*$")
ITEM = re.compile(r"([ \t]*)(?:[-*+•‣–]|\(?\d{1,4}[.)]|\(?[a-z][.)])[ \t]+(?=\S)")
ROW = re.compile(r"[ \t]*\|")
#: Block elements of HTML.
TAG = re.compile(r"<(/?)(h[1-6]|p|div|section|article|ul|ol|li|table|tr|pre|blockquote)\b[^<>]*>", re.I)
#: Indentation and nesting from which list items count as of one level.
DEEPEST = 100
#: A lead keeps to what it leads up to this share of a piece.
LEAD = 0.25


class Node:
    """A span of a text with the spans it consists of; cuts stand behind ``guard`` only (the end of the lead it begins with)."""

    __slots__ = ("start", "end", "children", "guard")

    def __init__(self, start: int, end: int, children: list[Node] | None = None, guard: int = -1) -> None:
        self.start, self.end, self.children, self.guard = start, end, children or [], guard


def _line_blocks(text: str, start: int, end: int) -> list[tuple[int, str, int]]:
    """(start, kind, level) of the blocks of lines in a part of a text."""
    out: list[tuple[int, str, int]] = []
    fence, blank, at = "", True, start
    while at < end:
        stop = text.find("\n", at, end) + 1 or end
        line = text[at:stop].rstrip("\n")
        kind, level = out[-1][1:] if out else ("", 0)
        if fence:
            if line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                fence, blank = "", True
        elif not line.strip():
            blank = True
        else:
            if m := FENCE.match(line):
                fence = m[1]
                out.append((at, "leaf", 0))
            elif m := HEADING.match(line + "\n"):
                out.append((at, "heading", len(m[1])))
            elif (m := UNDERLINE.match(line)) and not blank and kind == "leaf" and "\n" not in text[out[-1][0] : at].rstrip("\n"):
                out[-1] = (out[-1][0], "heading", 1 if m[1][0] == "=" else 2)
            elif m := ITEM.match(line):
                out.append((at, "item", min(len(m[1].expandtabs(4)), DEEPEST)))
            elif ROW.match(line):
                if kind != "table" or blank:
                    out.append((at, "table", 0))
            elif kind == "item" and (not blank or line[:1] in " \t"):
                pass  # goes on with the item
            elif blank or kind in ("heading", "table"):
                out.append((at, "leaf", 0))
            elif kind == "":
                out.append((at, "leaf", 0))
            blank = False
        at = stop
    return out


def blocks(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, level) of the blocks of a text, one behind the other."""
    marks = [(0, 0, "leaf", 0)]
    depth = 0
    for m in TAG.finditer(text) if "<" in text else ():
        name = m[2].lower()
        if name in ("ul", "ol"):
            depth += -1 if m[1] else 1
        if m[1]:
            marks.append((m.end(), m.end(), "leaf", 0))
        elif name[0] == "h":
            marks.append((m.start(), m.end(), "heading", int(name[1])))
        else:
            marks.append((m.start(), m.end(), "item" if name == "li" else "leaf", min(max(depth, 0), DEEPEST)))
    starts: list[tuple[int, str, int]] = []
    for (start, body, kind, level), stop in zip(marks, [m[0] for m in marks[1:]] + [len(text)]):
        inner = _line_blocks(text, body, stop)
        if start < body:
            starts.append((start, kind, level))
            inner = inner[1:] if inner and inner[0][1] == "leaf" else inner
        starts += inner
    ends = [s for s, _, _ in starts[1:]] + [len(text)]
    return [(s, e, kind, level) for (s, kind, level), e in zip(starts, ends)]


def _pulled(node: Node, start: int, guard: int) -> Node:
    """A node that begins with its lead."""
    children = [_pulled(node.children[0], start, guard), *node.children[1:]] if node.children else []
    return Node(start, node.end, children, max(node.guard, guard))


def _led(lead: Node, nodes: list[Node], room: int) -> list[Node]:
    """Nodes behind a lead: the first of them begins with it, so that no cut falls between."""
    if lead.children or lead.end - lead.start > LEAD * room or not nodes:
        return [lead, *nodes]
    return [_pulled(nodes[0], lead.start, lead.end), *nodes[1:]]


def _items(run: list[tuple[int, int, str, int]], room: int) -> list[Node]:
    """The items of a list, each with the deeper ones that follow it."""
    out, at = [], 0
    while at < len(run):
        start, end, _, level = run[at]
        stop = at + 1
        while stop < len(run) and run[stop][3] > level:
            stop += 1
        children = _led(Node(start, end), _items(run[at + 1 : stop], room), room) if stop > at + 1 else []
        out.append(Node(start, run[stop - 1][1], children))
        at = stop
    return out


def tree(text: str, found: list[tuple[int, int, str, int]], room: int) -> list[Node]:
    """Nodes of consecutive blocks: sections by heading level, lists by depth."""
    out: list[Node] = []
    at = 0
    while at < len(found):
        start, end, kind, level = found[at]
        stop = at + 1
        if kind == "heading":
            while stop < len(found) and not (found[stop][2] == "heading" and found[stop][3] <= level):
                stop += 1
            children = _led(Node(start, end), tree(text, found[at + 1 : stop], room), room) if stop > at + 1 else []
            out.append(Node(start, found[stop - 1][1], children))
        elif kind == "item":
            while stop < len(found) and found[stop][2] == "item":
                stop += 1
            nodes = [Node(start, found[stop - 1][1], _items(found[at:stop], room))]
            if out and not out[-1].children and text[out[-1].start : out[-1].end].rstrip().endswith(":"):
                nodes = _led(out.pop(), nodes, room)
            out += nodes
        else:
            out.append(Node(start, end))
        at = stop
    return out


def _merge(units: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """Adjacent units joined greedily up to ``room``."""
    out: list[tuple[int, int]] = []
    for start, end in units:
        if out and end - out[-1][0] <= room:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def pack_leaf(text: str, start: int, end: int, room: int, guard: int = -1, level: int = 0) -> list[tuple[int, int]]:
    """Spans of at most ``room`` characters that cover ``text[start:end]``, cut at the coarsest boundaries behind ``guard``."""
    if end - start <= room:
        return [(start, end)]
    if level == len(LEVELS):
        return [(k, min(k + room, end)) for k in range(start, end, room)]
    ends = [m.end() for m in LEVELS[level].finditer(text, start, end) if guard < m.end() < end]
    children = zip([start, *ends], [*ends, end])
    return _merge([unit for a, b in children for unit in pack_leaf(text, a, b, room, guard, level + 1)], room)


def pack(text: str, node: Node, room: int) -> list[tuple[int, int]]:
    """Spans of at most ``room`` characters that cover a node."""
    if node.end - node.start <= room:
        return [(node.start, node.end)]
    if not node.children:
        return pack_leaf(text, node.start, node.end, room, node.guard)
    return _merge([unit for child in node.children for unit in pack(text, child, room)], room)


def overlap_from(text: str, at: int, overlap: int) -> int:
    """Start of the overlap before ``at``: the first word that begins in the last ``overlap`` characters, where there is one."""
    start = max(0, at - overlap)
    if start and not text[start - 1].isspace():
        m = re.compile(r"\s\S").search(text, start, at)
        start = m.start() + 1 if m else start
    return start


def pieces(text: str | None, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, piece with overlap) of each piece of the stripped text."""
    text = (text or "").strip()
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text), text)]
    room = limit - overlap
    spans = pack(text, Node(0, len(text), tree(text, blocks(text), room)), room)
    return [(a, b, text[overlap_from(text, a, overlap) : b]) for a, b in spans]


def split_oversized(df: DataFrame, text: str, keep: list[str], limit: int = 1500, overlap: int = 150) -> DataFrame:
    """All pieces of all texts of ``df``."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if clash := {c.lower() for c in keep} & PIECES.keys():
        raise ValueError(f"keep has reserved names: {sorted(clash)}")
    body = "__text"
    rows = df.select(*keep, F.col(text).alias(body)).filter(F.col(body).isNotNull())
    schema = T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(k, v) for k, v in PIECES.items())])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, out = [], []
            for i, value in enumerate(batch[body]):
                found = pieces(value, limit, overlap)
                at += [i] * len(found)
                out += [(k, len(found), a, b, p) for k, (a, b, p) in enumerate(found, 1)]
            made = pd.DataFrame(out, columns=list(PIECES))
            yield pd.concat([batch[keep].iloc[at].reset_index(drop=True), made], axis=1)

    long = rows.filter(F.char_length(body) > limit).mapInPandas(cut, schema)
    stripped = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    short = rows.filter(F.char_length(body) <= limit).withColumn(body, stripped).filter(F.col(body) != "")
    short = short.select(
        *keep, F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_at"), F.char_length(body).alias("end_at"), F.col(body).alias("piece")
    )
    return long.unionByName(short)
