"""Problem 2: splitting oversized items at natural boundaries.

Method: structure-tree packing. Boundaries found in one scan carry a rank (headings by depth, blank
lines, list items and table rows, line ends, sentence ends, clause marks, white space), which makes
the text a tree: a node's children lie between its strongest inner boundaries. Sibling subtrees are
merged in order up to the limit; only a node larger than the limit is descended into, and only a
leaf without any boundary is cut hard.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.runtime import arrow_map, spread, table

LIMITS = {"content": 512, "parent_content": 2000, "text": 2000}
OVERLAP = 64

_BOUNDARY = re.compile(
    r"(?P<block></(?:p|div|section|table|ul|ol|h[1-6])>\s*)|(?P<blank>\n[ \t\r]*\n\s*)|(?P<line>\n)"
    r"|(?P<sentence>[。！？；!?;]+[\"'”’）)」』\]]*\s*|\.(?:[\"'”’)]*\s+|$))|(?P<clause>[，、,:：]\s*)|(?P<space>\s+)"
)
_HEADING = re.compile(r"[ \t]{0,3}(#{1,6})[ \t]|<h([1-6])\b", re.I)
_ITEM = re.compile(r"[ \t]*(?:[-*+•][ \t]|\d{1,3}[.)、]|[（(]\d{1,3}[)）]|\||<(?:li|tr)\b)", re.I)
RANKS = {"block": 6, "blank": 6, "line": 4, "sentence": 3, "clause": 2, "space": 1}


def boundaries(text: str) -> dict[int, int]:
    """Position of each boundary and its rank; a heading's is 13 less its depth."""
    ranks = {}
    for m in _BOUNDARY.finditer(text):
        rank = RANKS[m.lastgroup]
        if rank >= 4 or "\n" in m.group():
            rank = max(rank, 4)
            if h := _HEADING.match(text, m.end()):
                rank = 13 - (len(h.group(1)) if h.group(1) else int(h.group(2)))
            elif rank == 4 and _ITEM.match(text, m.end()):
                rank = 5
        ranks[m.end()] = rank
    ranks.pop(len(text), None)
    return ranks


def _pack(a: int, b: int, marks: list[tuple[int, int]], cap: int) -> list[tuple[int, int]]:
    """Spans of at most ``cap`` characters that tile [a, b)."""
    if b - a <= cap:
        return [(a, b)]
    if not marks:
        return [(i, min(i + cap, b)) for i in range(a, b, cap)]
    top = max(rank for _, rank in marks)
    edges = [a, *(p for p, rank in marks if rank == top), b]
    parts, at = [], 0
    for x, y in zip(edges, edges[1:]):
        start = at
        while at < len(marks) and marks[at][0] < y:
            at += 1
        if y - x <= cap:
            inner = [(x, y)]
        else:
            inner = _pack(x, y, [m for m in marks[start:at] if m[0] > x], cap)
        for u, v in inner:
            if parts and v - parts[-1][0] <= cap and (u == x or len(inner) == 1):
                parts[-1] = (parts[-1][0], v)
            else:
                parts.append((u, v))
    return parts


def split_text(text: str | None, limit: int, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Ordered spans (start, end) of at most ``limit`` characters. Neighbours share exactly
    ``overlap`` characters, and together the spans hold the whole text. Null or empty: none."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    spans = _pack(0, len(text), sorted(boundaries(text).items()), limit - overlap)
    for i in range(len(spans) - 1, 0, -1):  # a first span too short to give the overlap joins the next
        if spans[i][0] < overlap:
            spans[: i + 1] = [(0, spans[i][1])] if spans[i][1] <= limit else [(0, limit - overlap), (limit - overlap, spans[i][1])]
            break
    return [(max(0, a - overlap), b) for a, b in spans]


def is_unbroken(text: str, limit: int) -> bool:
    """More than ``limit`` characters in a row are neither white space nor a sentence mark."""
    return re.search(r"[^\s。！？；.!?;]{%d}" % (limit + 1), text) is not None


def split_oversized(df: DataFrame, id_col: str, value: str, field: str, limit: int, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every value over ``limit`` characters: ``(field, row_id, kind, piece_no, start_pos,
    end_pos, piece)``. Nulls and values within the limit give none; repeated rows each give theirs."""
    big = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(value).alias("value")).filter(F.length("value") > limit)

    def pieces(c):
        out = {k: [] for k in ("row_id", "kind", "piece_no", "start_pos", "end_pos", "piece")}
        for row_id, text in zip(c["row_id"], c["value"]):
            kind = "unbroken" if is_unbroken(text, limit) else "natural"
            for n, (a, b) in enumerate(split_text(text, limit, overlap)):
                for k, v in zip(out, (row_id, kind, n, a, b, text[a:b])):
                    out[k].append(v)
        return out

    rows = arrow_map(spread(big), pieces, "row_id long, kind string, piece_no int, start_pos long, end_pos long, piece string")
    return rows.select(F.lit(field).alias("field"), "*")


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, segments = table(spark, sf_dir, "structured_chunks"), table(spark, sf_dir, "parsed_segments")
    parts = [split_oversized(chunks, "chunk_id", "content", "content", LIMITS["content"]),
             split_oversized(chunks, "chunk_id", "parent_content", "parent_content", LIMITS["parent_content"]),
             split_oversized(segments, "segment_id", "text", "text", LIMITS["text"])]
    return reduce(DataFrame.unionByName, parts)


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized values."""
    return _all(spark, sf_dir)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One row a value is its first piece; the ids are unique, so no shuffle is needed.
    return _all(spark, sf_dir).filter("piece_no = 0").select("field", "row_id", "kind")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}
