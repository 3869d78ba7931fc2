"""Whole-text cleaning, which needs compatibility forms and so runs over Arrow batches."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.runtime import arrow_map, spread

# Marks that keep their width, and beginnings of lines that are no content.
KEPT_MARKS = "，。！？；：、“”‘’（）【】《》"
BOILERPLATE = r"(?i)(?:copyright|all rights reserved|版权所有|扫码关注|点击下载|返回顶部|cookie policy|privacy policy)\b"
_MARKS = re.compile(f"([{KEPT_MARKS}])")
_DROPPED = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufeff\ufffd]")
_BOILERPLATE = re.compile(BOILERPLATE)
LONG = 12  # characters from which a repeated line is left out


def clean_text(text: str | None, deduplicate: bool = True) -> str:
    """Compatibility forms (but for Chinese marks), line ends and blanks evened out; control characters,
    boilerplate lines and, if asked for, repeated long lines left out. Null is the empty text."""
    s = "".join(p if k % 2 else unicodedata.normalize("NFKC", p) for k, p in enumerate(_MARKS.split(text or "")))
    s = _DROPPED.sub("", s.replace("\r\n", "\n")).replace("\r", "\n")
    out: list[str] = []
    seen: set[str] = set()
    for line in re.sub(r"[ \t]+", " ", s).splitlines():
        line = line.strip()
        if not line or _BOILERPLATE.match(line):
            line = ""
        key = re.sub(r"\s+", "", line).casefold()
        if len(key) >= LONG:
            if deduplicate and key in seen:
                continue
            seen.add(key)
        if line or out and out[-1]:
            out.append(line)
    return "\n".join(out).strip()


def cleaned(df: DataFrame, id_col: str, text: str, deduplicate: bool = True) -> DataFrame:
    """``(id, text)`` of every row; null and empty texts come out empty."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")))
    return arrow_map(rows, lambda c: {"id": c["id"], "text": [clean_text(t, deduplicate) for t in c["text"]]}, f"id {kind}, text string")
