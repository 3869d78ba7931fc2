"""Problem 4: visually identical text with different characters.

Method: a quick-check character class (NFKC quick check "no" or "maybe", a non-zero combining class,
invisible, a look-alike letter or a variant sign) isolates unstable segments; a segment is widened
to the starter before it and the marks behind it, only that slice is normalised, and the canonical
slice is spliced into the unchanged rest.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.runtime import arrow_map, spread, table, written

from .classes import EXPAND, expanded

# Letters of other scripts, and of rarer Latin ones, that look like a plain Latin letter. Small
# Cyrillic and Latin small capitals look like each other.
LOOKALIKE = dict(pair.split("=") for pair in """
А=A В=B Е=E К=K М=M Н=H О=O Р=P С=C Т=T У=Y Х=X Ѕ=S І=I Ј=J Ԛ=Q Ԝ=W Ԍ=G Ү=Y Ӏ=I Ғ=F Ѵ=V
а=a е=e о=o р=p с=c у=y х=x ѕ=s і=i ј=j һ=h ԁ=d ԛ=q ԝ=w к=k ѵ=v ӏ=l ᴋ=k ʙ=в ᴍ=м ᴛ=т ʜ=н
Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X Ϲ=C Ϳ=J
ο=o α=a ν=v ι=i υ=u ρ=p κ=k γ=y χ=x ϲ=c ϳ=j
Օ=O Տ=S Լ=L Ս=U օ=o հ=h ո=n ս=u ց=g զ=q յ=j
Ꭰ=D Ꭱ=R Ꭲ=T Ꭺ=A Ꭻ=J Ꭼ=E Ꮃ=W Ꮇ=M Ꮋ=H Ᏼ=B Ꮓ=Z Ꮐ=G Ꮮ=L Ꮯ=C Ꮲ=P Ꮶ=K Ꮩ=V Ꮪ=S Ꮍ=Y Ꮟ=b Ꭵ=i
Ⲁ=A Ⲃ=B Ⲉ=E Ⲏ=H Ⲓ=I Ⲕ=K Ⲙ=M Ⲛ=N Ⲟ=O Ⲣ=P Ⲥ=C Ⲧ=T Ⲭ=X Ⲍ=Z ⲟ=o ⲥ=c ⲣ=p
ꓐ=B ꓑ=P ꓓ=D ꓔ=T ꓖ=G ꓗ=K ꓙ=J ꓚ=C ꓜ=Z ꓝ=F ꓟ=M ꓠ=N ꓡ=L ꓢ=S ꓣ=R ꓦ=V ꓧ=H ꓪ=W ꓫ=X ꓬ=Y ꓮ=A ꓰ=E ꓲ=I ꓳ=O ꓴ=U
ı=i ɑ=a ɡ=g ɩ=i ǀ=l
""".split())
# Signs that differ only in kind.
SIGNS = {
    **dict.fromkeys("‐‑‒–−˗﹣", "-"), **dict.fromkeys("‘’‛ʼ", "'"), **dict.fromkeys("“”‟", '"'),
    " ": "\n", " ": "\n", "∕": "/", "⁄": "/", "․": ".",
}
SPELLINGS = 2_000  # ways of storing one reading up to which all their pairs are given; beyond it each one's pair with the first


@functools.cache
def _second() -> frozenset[str]:
    """Characters that may compose with the one before them (quick check "maybe"): the second half of a
    canonical decomposition that composes again, and the vowels and finals of Korean syllables."""
    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for cp in range(0xC0, 0x30000):
        d = unicodedata.decomposition(chr(cp)) if not 0xD800 <= cp < 0xE000 else ""
        if d and d[0] != "<" and len(parts := d.split()) == 2 and unicodedata.is_normalized("NFC", chr(cp)):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


def _kind(c: str) -> bool:
    """True if the character may change or vanish in the canonical form."""
    # Of a letter with marks its base counts: a look-alike stored precomposed is one too.
    if unicodedata.normalize("NFKD", c)[0] in LOOKALIKE or c in SIGNS or unicodedata.combining(c) or c in _second():
        return True
    cat = unicodedata.category(c)
    if cat in ("Cf", "Zs", "Zl", "Zp", "Nd", "Cc"):
        return not (c.isascii() and (c.isprintable() or c in "\n\t"))
    return not unicodedata.is_normalized("NFKC", c)


@functools.cache
def _unstable() -> re.Pattern:
    spans, start = [], None
    for cp in range(0x80, 0x30000):
        hit = not 0xD800 <= cp < 0xE000 and not 0x4E00 <= cp < 0xA000 and not 0xAC00 <= cp < 0xD7A4 and _kind(chr(cp))
        if hit and start is None:
            start = cp
        elif not hit and start is not None:
            spans.append(f"{chr(start)}-{chr(cp - 1)}")
            start = None
    if start is not None:
        spans.append(f"{chr(start)}-{chr(0x2FFFF)}")
    spans.append(f"{chr(0xE0000)}-{chr(0xE01EF)}")
    return re.compile("[\x00-\x08\x0b-\x1f\x7f" + "".join(spans) + "]+")


@functools.lru_cache(maxsize=65536)
def _segment(s: str) -> str:
    """Canonical form of one segment, which starts at a boundary. Look-alikes are mapped on the bases
    of decomposed letters; only then are these composed."""
    out = []
    for c in unicodedata.normalize("NFKD", s):
        cat = unicodedata.category(c)
        if cat == "Cf" or cat == "Cc" and c not in "\n\t" or "︀" <= c <= "️":
            continue
        if cat == "Zs":
            c = " "
        elif cat == "Nd":
            c = str(unicodedata.decimal(c))
        out.append(SIGNS.get(c) or LOOKALIKE.get(c, c))
    return unicodedata.normalize("NFC", "".join(out))


def canonical(text: str | None) -> str | None:
    """One form for all texts that look the same; null stays null, empty stays empty."""
    if text is None:
        return None
    if text.isascii() and "\r" not in text and text.isprintable():
        return text
    out, at = [], 0
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    for m in _unstable().finditer(text):
        a, b = m.span()
        # A mark or the second part of a syllable composes with the starter before it, also across
        # invisible characters.
        if a > at and any(unicodedata.combining(c) or c in _second() for c in text[a:b]):
            a -= 1
        out += (text[at:a], _segment(text[a:b]))
        at = b
    out.append(text[at:])
    return "".join(out)


PHONE_LETTERS = str.maketrans("OoQlI|", "000111")
_MOBILE = re.compile(r"(?:\+?86|0086)?(1[3-9]\d{9})")


def canonical_phone(value: str | None) -> str | None:
    """The 11-digit mobile number a value stands for, else null."""
    if value is None:
        return None
    s = re.sub(r"[^0-9+A-Za-z|]", "", canonical(value)).translate(PHONE_LETTERS)
    m = _MOBILE.fullmatch(s)
    return m and m.group(1)


UNUSABLE = {"none", "null", "nan", "n/a", "na", "nil", "-", "无", "test"}


def lookalike_forms(df: DataFrame, id_col: str, value: str, field: str, phone: bool = False) -> DataFrame:
    """``(field, id, value, form)`` for each row: ``form`` is the canonical form, null where the value
    is null, blank or unusable. Repeated rows stay; columns other than the two named are not read."""
    def forms(c):
        form = canonical_phone if phone else canonical
        return {"id": c["id"], "value": c["value"], "form": [form(v) for v in c["value"]]}

    rows = arrow_map(spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(value).alias("value"))), forms, "id long, value string, form string")
    bad = F.lower(F.trim("form")).isin(*sorted(UNUSABLE)) | (F.trim("form") == "")
    return rows.select(F.lit(field).alias("field"), "id", "value", F.when(~bad, F.col("form")).alias("form"))


def spellings(forms: DataFrame) -> DataFrame:
    """``(field, k, v, rep, copies)`` from ``lookalike_forms`` rows: each stored value ``v`` of each reading
    ``k`` (both hashed), with its smallest id and the number of its rows."""
    rows = forms.filter("form is not null").select("field", "id", F.unhex(F.md5("form")).alias("k"), F.unhex(F.md5("value")).alias("v"))
    return rows.groupBy("field", "k", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))


def readings(forms: DataFrame) -> DataFrame:
    """``(field, id, class_id, rep, copies, links)`` of each row with a form: the smallest id of the rows that
    read the same, the smallest of those stored the same and how many these are, and how many rows read the
    same but are stored differently. Linear in the rows, whatever the size of a class."""
    each = written(spellings(forms), "p4-spellings")
    whole = each.groupBy("field", "k").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("rows"))
    rows = forms.filter("form is not null").select("field", "id", F.unhex(F.md5("form")).alias("k"), F.unhex(F.md5("value")).alias("v"))
    return (rows.join(each, ["field", "k", "v"]).join(whole, ["field", "k"])
            .select("field", "id", "class_id", "rep", "copies", (F.col("rows") - F.col("copies")).alias("links")))


def equal_readings(forms: DataFrame, most: int = SPELLINGS, expand: int = EXPAND) -> DataFrame:
    """Pairs of rows with the same form and different stored values, from ``lookalike_forms`` rows.

    Stored values of one reading give all pairs of their representatives (smallest ids), which are expanded
    to pairs of rows as in ``classes.expanded``. A reading stored in more than ``most`` ways gives each
    value's pair with the first one; ``readings`` has every row's class and number of links then.
    """
    each = spellings(forms)
    groups = each.groupBy("field", "k").agg(F.count("*").alias("ways"), F.min("rep").alias("first")).filter("ways > 1")
    # Few readings are stored in several ways; only these go on.
    hit = written(each.join(groups, ["field", "k"]), "p4-hit")
    dense = F.col("ways") > most
    a, b = (hit.filter(~dense).select("field", "k", F.col("rep").alias(f"id_{x}")) for x in "ab")
    every = a.join(b, ["field", "k"]).filter("id_a < id_b").select("field", "id_a", "id_b")
    star = hit.filter(dense & (F.col("rep") != F.col("first"))).select("field", F.col("first").alias("id_a"), F.col("rep").alias("id_b"))
    rows = forms.filter("form is not null").select("field", "id", F.unhex(F.md5("form")).alias("k"), F.unhex(F.md5("value")).alias("v"))
    members = rows.join(hit.filter("copies > 1").select("field", "k", "v", "rep", "copies"), ["field", "k", "v"]).select("field", "id", "rep", "copies")
    return expanded(written(every.unionByName(star), "p4-pairs"), written(members, "p4-members"), inside=False, most=expand)


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form of every username, phone and text, with the stored value."""
    req, seg = table(spark, sf_dir, "register_requests"), table(spark, sf_dir, "parsed_segments")
    return lookalike_forms(req, "request_id", "username", "username").unionByName(
        lookalike_forms(req, "request_id", "phone", "phone", phone=True)).unionByName(
        lookalike_forms(seg, "segment_id", "text", "text"))


def _slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    # What is compared later fits in 32 bytes a row; the texts stay behind.
    return written(p4_forms(spark, sf_dir).filter("form is not null").select("field", "id", F.md5("form").alias("form"), F.md5("value").alias("value")), "p4")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_readings(_slim(spark, sf_dir))


def p4_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's class of equal readings and its number of links."""
    return readings(_slim(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_forms": p4_forms, "p4_readings": p4_readings}
