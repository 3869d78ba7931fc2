"""Parsing: files and markup to segments, records to tables. Segments are ``(section, text)``."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.clean import clean_text
from ferrule.runtime import arrow_map, spread
from ferrule.sources import office

DEFAULT_SECTION, WEB_SECTION, MAX_ROWS = "正文", "网页正文", 20_000
_DROPPED = {"script", "style", "noscript", "nav", "footer", "aside", "form"}


def markdown_sections(text: Column) -> Column:
    """Array of (section, body): a heading starts a section; what stands before the first one belongs to
    the default section; sections without a body are left out."""
    marked = F.regexp_replace(text, r"(?m)^[ \t]*#{1,6}[ \t]+(.+)$", "\u0001$1\u0002")
    parts = F.split(F.concat(F.lit(DEFAULT_SECTION + "\u0002"), marked), "\u0001")
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.split_part(p, F.lit("\u0002"), F.lit(1))).alias("section"), F.regexp_replace(F.split_part(p, F.lit("\u0002"), F.lit(2)), r"^\s+|\s+$", "").alias("body")))
    return F.filter(pairs, lambda x: x["body"] != "")


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.section, self.buffer, self.text = WEB_SECTION, [], []
        self.skip, self.mode, self.roots = 0, None, []

    def handle_starttag(self, tag, attrs):
        if tag in _DROPPED:
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "h4", "p", "li", "td", "th", "title"):
            self.end_block()
            self.mode = tag
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in _DROPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == self.mode:
            self.end_block()

    def handle_data(self, data):
        if not self.skip and self.mode:
            self.text.append(data)

    def end_block(self):
        s, mode = re.sub(r"\s+", " ", "".join(self.text)).strip(), self.mode
        self.text, self.mode = [], None
        if not s:
            return
        if mode == "title":
            self.section = s
        elif mode and mode[0] == "h" and mode[1:].isdigit():
            self.flush()
            self.section = s
        else:
            self.buffer.append(s)

    def flush(self):
        if self.buffer:
            self.out.append((self.section, "\n".join(self.buffer)))
        self.buffer = []


def html_sections(html: str | None) -> list[tuple[str, str]]:
    """Sections of a page's main part, article or body; scripts, navigation and forms are left out."""
    page = _Page()
    text = html or ""
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", text)
    for root in ("main", "article", "body"):
        m = re.search(rf"(?is)<{root}\b[^>]*>(.*)</{root}>", text)
        if m:
            text = (title.group() if title else "") + m.group(1)
            break
    page.feed(text)
    page.end_block()
    page.flush()
    return page.out


def markdown_table(rows: list[list], most: int = MAX_ROWS) -> str:
    """Rows, the first a head, as a markdown table; short rows are filled up."""
    rows = [[("" if c is None else str(c)).replace("\n", " ") for c in r] for r in rows[: most + 1]]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * width, *rows[1:]])


def records_markdown(records: list[dict], most: int = MAX_ROWS) -> str:
    keys = list(dict.fromkeys(k for r in records for k in r))
    return markdown_table([keys, *([r.get(k) for k in keys] for r in records)], most)


def csv_segment(raw: bytes, name: str) -> list[tuple[str, str]]:
    rows = list(csv.reader(io.StringIO(raw.decode("utf-8-sig", "replace"))))
    return [(name, markdown_table(rows))] if rows else []


def parse_bytes(path: str, raw: bytes) -> list[tuple[str, str]]:
    """Segments of one file by its suffix; formats whose library is absent raise ValueError."""
    name, suffix = re.sub(r".*/", "", path).rsplit(".", 1) if "." in path else (path, "")
    suffix = suffix.lower()
    text = raw.decode("utf-8", "replace")
    if suffix == "txt":
        return [(DEFAULT_SECTION, text)] if text.strip() else []
    if suffix in ("md", "markdown"):
        out, section, body = [], DEFAULT_SECTION, []
        for line in [*text.splitlines(), None]:
            h = re.match(r"#{1,6}\s+(.+)$", line.strip()) if line is not None else None
            if line is None or h:
                if "\n".join(body).strip():
                    out.append((section, "\n".join(body).strip()))
                section, body = (h.group(1).strip() if h else section), []
            else:
                body.append(line)
        return out
    if suffix in ("html", "htm"):
        return html_sections(text)
    if suffix == "csv":
        return csv_segment(raw, name)
    raise ValueError(f"unsupported suffix {suffix!r}")


def segments(path: str, raw: bytes) -> list[tuple[str, str, str]]:
    """``(section, text, content_type)`` of one file, cleaned; blank ones are left out."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if suffix == "docx":
        found = office.docx_segments(raw, DEFAULT_SECTION, markdown_table)
    elif suffix == "xlsx":
        found = office.xlsx_segments(raw, markdown_table, MAX_ROWS)
    else:
        found = [(section, text, "table" if suffix == "csv" else "text") for section, text in parse_bytes(path, raw)]
    return [(section, t, kind) for section, text, kind in found if (t := clean_text(text, deduplicate=kind == "text"))]


def read_files(spark: SparkSession, path: str, source_url: str | None = None) -> DataFrame:
    """``(path, seq, section, text, content_type, page, source_url, error)`` of all files under a path; a file that
    can't be parsed gives one row with its error, so that one bad file doesn't end the job. None of the formats
    read here has pages, so ``page`` is null."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(c):
        out = {k: [] for k in ("path", "seq", "section", "text", "content_type", "error")}
        for p, raw in zip(c["path"], c["content"]):
            try:
                rows, error = segments(p, raw), None
            except ValueError as e:
                rows, error = [(None, None, None)], str(e)
            for n, row in enumerate(rows):
                for k, v in zip(out, (p, n, *row, error)):
                    out[k].append(v)
        return out

    rows = arrow_map(spread(files), run, "path string, seq int, section string, text string, content_type string, error string")
    return rows.select("path", "seq", "section", "text", "content_type", F.lit(None).cast("int").alias("page"), F.lit(source_url).cast("string").alias("source_url"), "error")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are passed over, and a broken one is a row of nulls."""
    return spark.read.schema(schema).json(path)


def json_path(value, path: str):
    """A dotted path through dicts and lists; a missing key is null, an index out of range an error."""
    for step in filter(None, path.split(".")):
        if isinstance(value, dict):
            value = value.get(step)
        elif isinstance(value, list):
            value = value[int(step)]
        else:
            raise ValueError(f"no {step!r} in a scalar")
    return value


def read_query(spark: SparkSession, sql: str, most: int = 10_000) -> DataFrame:
    """Rows of a single read-only SELECT over registered views. The statement is parsed first and refused if
    any node of its plan writes or is a command; nothing of it runs before."""
    sql = sql.strip().rstrip(";")
    if ";" in sql or not re.match(r"(?is)(select|with)\b", sql) or any(_writes(n) for n in _plan_nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))):
        raise ValueError("only one SELECT statement is allowed")
    return spark.sql(sql).limit(most)


def _plan_nodes(plan) -> Iterator:
    """A parsed plan's nodes, those of common table expressions too."""
    yield plan
    for group in (plan.children(), plan.innerChildren()):
        for i in range(group.size()):
            if ".plans.logical." in group.apply(i).getClass().getName() or ".catalyst.analysis." in group.apply(i).getClass().getName():
                yield from _plan_nodes(group.apply(i))


def _writes(node) -> bool:
    names, cls = [], node.getClass()
    while cls is not None:
        names += [cls.getSimpleName(), *(x.getSimpleName() for x in cls.getInterfaces())]
        cls = cls.getSuperclass()
    return any(re.search(r"Command$|^Insert|^ParsedStatement$|^Write|^MergeInto|^DeleteFrom|^UpdateTable", n) for n in names)


def write_jsonl(df: DataFrame, path: str, order: list[Column]) -> None:
    """One JSON object a line, in order; nulls last is the caller's order."""
    df.orderBy(*order).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
