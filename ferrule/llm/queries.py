"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import p1_scans, p2_split, p3_private, p4_lookalikes, p5_pairs, p6_similar, p7_leaks, p8_mixture, p9_reading

QUERIES = {}
for _m in (p1_scans, p2_split, p3_private, p4_lookalikes, p5_pairs, p6_similar, p7_leaks, p8_mixture, p9_reading):
    QUERIES.update(_m.QUERIES)

_BREAK = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}。！？；.!?;"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")


def _over(field: str, key: str, table: str, limit: int) -> str:
    run = f"list_max(list_transform(regexp_extract_all({field}, '[^{_BREAK}]+'), lambda r: length(r)))"
    return f"SELECT '{field}' AS field, {key} AS row_id, CASE WHEN {run} > {limit} THEN 'unbroken' ELSE 'natural' END AS kind FROM {table} WHERE length({field}) > {limit}"


def _plain(x: str) -> str:
    return f"regexp_replace(lower(translate({x}, '{_WIDE}', '{_ASCII}')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


SQL: dict[str, str] = {
    "p2_found": " UNION ALL ".join([_over("content", "chunk_id", "structured_chunks", 512), _over("parent_content", "chunk_id", "structured_chunks", 2000), _over("text", "segment_id", "parsed_segments", 2000)]),
    "p7_found": f"""WITH d AS (SELECT doc_id, {_plain('text')} AS t FROM documents), i AS (SELECT item_id, {_plain('passage')} AS t FROM eval_items),
 g AS (SELECT item_id, unnest(list_transform(range(1, greatest(length(t) - 38, 1)), lambda k: substring(t, k, 40))) AS run FROM i), w AS (SELECT doc_id, unnest(list_transform(range(1, greatest(length(t) - 38, 1)), lambda k: substring(t, k, 40))) AS run FROM d)
 SELECT DISTINCT doc_id, item_id FROM w JOIN g USING (run)""",
}
