"""Chunking: one text to many chunks."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.runtime import arrow_map, spread

SIZE, OVERLAP, THRESHOLD = 512, 64, 0.42
BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace())  # what str.strip takes off
_SENTENCE = re.compile(r"(?<=[。！？!?；;])\s*|(?<=\.)\s+")


def check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and below it")


def fixed(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of windows of ``size`` characters every ``size - overlap`` of the normalised text; null for null
    and blank texts."""
    check(size, overlap)
    step = size - overlap
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    text = F.btrim(F.regexp_replace(text, "\n{3,}", "\n\n"), F.lit(BLANK))
    # The normalised text is bound once, as a lambda's argument; each window would make it anew.
    windows = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(0), F.length(t) - 1, F.lit(step)), lambda s: F.substring(t, s + 1, F.lit(size))))
    return F.element_at(F.transform(F.array(text), windows), 1)


def normalize(text: str) -> str:
    text = re.sub(r"\r\n?", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def _slices(text: str, size: int, overlap: int) -> list[str]:
    return [text[a : a + size] for a in range(0, len(text), size - overlap)]


def merge(units: list[str], size: int, overlap: int) -> list[str]:
    """Units joined with line breaks while they fit. What doesn't fit begins a chunk, led by the end of the one
    before; where that makes it too long, the unit alone is cut into windows."""
    out: list[str] = []
    for unit in units:
        if out and len(out[-1]) < size - len(unit):
            out[-1] = f"{out[-1]}\n{unit}"
            continue
        lead = f"{out[-1][-overlap:]}\n" if out and overlap else ""
        out += [lead + unit] if len(lead) + len(unit) <= size else _slices(unit, size, overlap)
    return out


def _long(paragraph: str, size: int) -> list[str]:
    if len(paragraph) <= size:
        return [paragraph]
    return [p for s in _SENTENCE.split(paragraph) if s for p in (_slices(s, size, 0) if len(s) > size else [s])]


def split(text: str | None, strategy: str = "recursive", size: int = SIZE, overlap: int = OVERLAP, line_paragraphs: bool = False) -> list[str]:
    """Chunks of at most ``size`` characters by one of the strategies fixed, paragraph, recursive,
    section (which is recursive within a section) and semantic. Blank texts give none."""
    check(size, overlap)
    text = normalize(text or "")
    if not text:
        return []
    paragraphs = [p.strip() for p in re.split(r"\n" if line_paragraphs else r"\n\s*\n", text) if p.strip()]
    if strategy == "fixed":
        return _slices(text, size, overlap)
    if strategy == "paragraph":
        return merge([u for p in paragraphs for u in (_slices(p, size, 0) if len(p) > size else [p])], size, overlap)
    if strategy in ("recursive", "section"):
        return [text] if len(text) <= size else merge([u for p in paragraphs for u in _long(p, size)], size, overlap)
    if strategy == "semantic":
        return semantic(paragraphs, text, size, overlap)
    raise ValueError(f"unknown strategy {strategy!r}")


def hashed_vector(text: str, width: int = 64) -> np.ndarray:
    """A unit vector of hashed character bigrams: stands for an embedding model where there is none."""
    v = np.zeros(width)
    for i in range(len(text) - 1):
        h = (ord(text[i]) * 1000003 ^ ord(text[i + 1]) * 8191) & 0x7FFFFFFF
        v[h % width] += 1 if h >> 8 & 1 else -1
    n = float(np.sqrt((v * v).sum()))
    return v / n if n else v


def semantic(paragraphs: list[str], text: str, size: int, overlap: int, threshold: float = THRESHOLD, embed=hashed_vector) -> list[str]:
    """A new unit where consecutive paragraphs are less similar than ``threshold`` or the size is full."""
    if len(paragraphs) < 2:
        return split(text, "recursive", size, overlap)
    units, current, last = [], "", None
    for p in paragraphs:
        v = embed(p)
        if current and (float(v @ last) < threshold or len(current) + 1 + len(p) > size):
            units.append(current)
            current = p
        else:
            current = f"{current}\n{p}" if current else p
        last = v
    units.append(current)
    return merge([u for unit in units for u in _long(unit, size)], size, overlap)


def chunks(df: DataFrame, id_col: str, text: str, strategy: str = "recursive", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``(id, seq, content)`` of all texts; null and blank texts give no chunks."""
    check(size, overlap)
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter("text is not null")
    if strategy == "fixed":
        return rows.select("id", F.posexplode(fixed(F.col("text"), size, overlap)).alias("seq", "content"))

    def run(c):
        out = {"id": [], "seq": [], "content": []}
        for i, t in zip(c["id"], c["text"]):
            for n, p in enumerate(split(t, strategy, size, overlap)):
                out["id"].append(i)
                out["seq"].append(n)
                out["content"].append(p)
        return out

    return arrow_map(spread(rows), run, f"id {rows.schema['id'].dataType.simpleString()}, seq int, content string")
