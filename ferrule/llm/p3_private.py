"""Problem 3: personal information inside free text.

Method: a character-level bidirectional LSTM with CRF transitions, trained in numpy on made labelled
spans (p3_train), finds candidate spans; long texts are read in overlapping windows whose scores are
joined before one path is decoded through the whole text. An exact check of the form follows for the
kinds that have one: it drops spans without a valid form (an identity number needs a real date and
the right check character) and sets a span's borders to those of the form.
"""

from __future__ import annotations

import functools
import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.runtime import arrow_map, by_size, spread, table

from .p3_tagger import Tagger, folded
from .p3_train import DIGITS_ZH, SURNAMES, check_character

_AT = r"(?:\s?[\[(（]\s?(?:at|AT)\s?[\])）]\s?|\sAT\s|\sat\s)"
_DOT = r"(?:\.|\s?[\[(（]\s?(?:dot|DOT)\s?[\])）]\s?|\sDOT\s|\sdot\s)"
_USER, _HOST = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*", r"[A-Za-z0-9-]+"
_EMAIL = re.compile(rf"{_USER}\s?@\s?{_HOST}(?:{_DOT}{_HOST})*{_DOT}[A-Za-z]{{2,}}")
_SPOKEN = re.compile(rf"{_USER}{_AT}{_HOST}(?:{_DOT}{_HOST})*{_DOT}[A-Za-z]{{2,}}")  # without the sign
_S = r"[-. ]?"
_PHONE = re.compile(
    rf"(?<![\d*.])(?:(?:\+\s?86|0086|86){_S})?1[3-9]\d{_S}\d{{4}}{_S}\d{{4}}(?![\d*])"
    rf"|(?<![\d*])(?:(?:\+\s?86|0086){_S})?(?:\(0\d{{2,3}}\)\s?|0\d{{2,3}}[- ])\d{{7,8}}(?!\d)"
    rf"|(?<![\d*.-])(?:\+\s?1{_S})?(?:\(\d{{3}}\)\s?|\d{{3}}[-. ])\d{{3}}[-. ]\d{{4}}(?![\d*-])"
    rf"|\+\d{{1,3}}[- ]\d{{1,4}}(?:[- ]\d{{2,4}}){{2,4}}(?!\d)"
    rf"|(?<![{DIGITS_ZH}])一[三四五六七八九][{DIGITS_ZH}〇]{{9}}(?![{DIGITS_ZH}])")
_ID = re.compile(r"(?<![\dXx*])(?:\d{6}[- ]?\d{8}[- ]?\d{3}[\dXx]|\d{3}-\d{2}-\d{4})(?![\dXx*-])")
_ADDRESS = re.compile(r"(?=.*\d)(?:[㐀-鿿]{2,}.*?[路街道巷里同村镇].*?\d+\s*[号弄栋室]|\d{1,5}[A-Za-z]?,? (?:[A-Z][\w.'’-]*[ ,]+)*[A-Z][A-Za-z.]+)", re.S)
_TITLE = re.compile(r"(?:(?:Mr|Ms|Mrs|Miss|Dr|Prof|Sir|Madam)\b\.?|先生|女士|小姐)\s*", re.I)


def valid_id(s: str) -> bool:
    """3-2-4 digits, or 18 characters with a real birth date and the right check character."""
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", s):
        return True
    s = re.sub(r"[- ]", "", s).upper()
    if not re.fullmatch(r"\d{17}[\dX]", s):
        return False
    try:
        born = date(int(s[6:10]), int(s[10:12]), int(s[12:14]))
    except ValueError:
        return False
    return 1900 <= born.year <= 2100 and check_character(s) == s[17]


SLACK, REACH = 4, 12  # characters by which a span's start and end may be put right


def _fit(pattern: re.Pattern, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The span, if it has the form; else the form whose borders are nearest, if they are near enough."""
    best, least = None, 99
    for start in sorted(range(max(0, a - SLACK), min(len(text), a + SLACK + 1)), key=lambda i: abs(i - a)):
        m = pattern.match(text, start)
        if m and m.end() > a and abs(m.end() - b) <= REACH and (cost := abs(start - a) + abs(m.end() - b)) < least:
            best, least = m.span(), cost
    return best


def checked(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The span the tagger found, if its form is valid, else null. Blanks, marks, titles and labels at its
    borders are left out, and a border inside the form is moved to the form's. ``text`` is in ordinary width."""
    if kind == "email":
        return _fit(_EMAIL if "@" in text[a:b] else _SPOKEN, text, a, b)
    if kind == "phone":
        span = _fit(_PHONE, text, a, b)
        return span if span and not (_ID.match(text, span[0]) and valid_id(_ID.match(text, span[0]).group())) else None
    if kind == "id_number":
        span = _fit(_ID, text, a, b)
        return span if span and valid_id(text[slice(*span)]) else None
    while a < b and (text[a].isspace() or text[a] in "：:，,。.（(<《"):
        a += 1
    if kind == "name":
        while m := _TITLE.match(text, a, b):
            a = m.end()
        while b > a and not text[b - 1].isalnum():
            b -= 1
        # A word is a name as a whole.
        while a > 0 and text[a - 1].isascii() and text[a - 1].isalpha() and text[a].isascii():
            a -= 1
        s = text[a:b]
        if re.search(r"[㐀-鿿]", s):
            if a < b and text[a] not in SURNAMES:
                # The border is one off where a surname stands beside it.
                a = next((i for i in (a - 1, a + 1) if 0 <= i < b - 1 and text[i] in SURNAMES), a)
            if text[a] in SURNAMES:
                b = min(b, a + 3)
            s = text[a:b]
            return (a, b) if 2 <= len(s) <= 4 and not re.search(r"[A-Za-z\d]", s) else None
        return (a, b) if len(s) >= 3 and s[0].isupper() and not re.search(r"\d", s) else None
    # An address begins at a word's or number's start and holds a number.
    while a > 0 and text[a].isascii() and text[a].isalnum() and text[a - 1].isascii() and text[a - 1].isalnum():
        a -= 1
    return (a, b) if _ADDRESS.match(text, a, b) else None


@functools.cache
def _tagger() -> Tagger:
    return Tagger.load()


def mentions(texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Checked spans (start, end, kind) of each text, in order and without overlap; none for null."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    some = [i for i, t in enumerate(texts) if t]
    for i, spans in zip(some, _tagger().tag([texts[i] for i in some])):
        if not spans:
            continue
        text = folded(texts[i])
        done = sorted({(-score, *s, k) for a, b, k, score in spans if (s := checked(text, a, b, k))})
        kept: list[tuple[int, int, str]] = []
        for _, a, b, k in done:  # of overlapping ones the better scored
            if all(b <= x or a >= y for x, y, _ in kept):
                kept.append((a, b, k))
        out[i] = sorted(kept)
    return out


def masked(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with a placeholder for each span."""
    if not spans:
        return text
    parts, at = [], 0
    for a, b, k in spans:
        parts += (text[at:a], f"[{k.upper()}]")
        at = b
    return "".join(parts) + text[at:]


def private_mentions(df: DataFrame, id_col: str, text: str, field: str) -> DataFrame:
    """``(field, row_id, masked, kinds, starts)`` of each row: the masked text, and the kind and start of
    each mention. Null and empty texts come out as they are, with no mentions; repeated rows each count."""

    def find(c):
        rows: dict[str, list] = {k: [] for k in ("row_id", "masked", "kinds", "starts")}
        for part in by_size(c["text"], 1_000_000):
            texts = c["text"][part]
            for row_id, t, spans in zip(c["id"][part], texts, mentions(texts)):
                for k, v in zip(rows, (row_id, masked(t, spans), [s[2] for s in spans], [s[0] for s in spans])):
                    rows[k].append(v)
        return rows

    rows = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")))
    return arrow_map(rows, find, "row_id long, masked string, kinds array<string>, starts array<long>").select(F.lit(field).alias("field"), "*")


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its mentions masked."""
    return private_mentions(table(spark, sf_dir, "structured_chunks"), "chunk_id", "content", "content").unionByName(
        private_mentions(table(spark, sf_dir, "parsed_segments"), "segment_id", "text", "text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p3_masked(spark, sf_dir).select("field", "row_id", F.explode(F.arrays_zip("kinds", "starts")).alias("m"))
    return rows.select("field", "row_id", F.col("m.kinds").alias("kind"), F.col("m.starts").alias("start_pos")).distinct()


QUERIES = {"p3_found": p3_found, "p3_masked": p3_masked}
