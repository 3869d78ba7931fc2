"""Problem 7: evaluation texts leaking into training text.

Method: windows of both sides get a 64-bit SimHash of their character shingles. Every item has windows of
WINDOW characters, for passages that were taken over in part, and windows of the largest size of SIZES that
it holds, for those taken over with edits. Documents are cut at every fourth of a size, items at every
position, so a shared run of MIN_RUN characters always holds a whole small window of both. Four 16-bit
blocks index the items' fingerprints. Of fingerprints within the radius one block differs in at most a
quarter of it, so looking up each block with so many bits turned finds them all. Candidates are verified
exactly, by idf-weighted shingle similarity and by the length of the common run.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.runtime import arrow_map, built, spread, table

MIN_RUN, WINDOW, SHINGLE = 40, 32, 5
SIZES = (64, 128, 256)  # windows sized by item
RADIUS = {32: 3, 64: 11, 128: 11, 256: 11}  # of fingerprints; edits move those of longer texts by 8 to 11 bits
assert MIN_RUN - WINDOW >= WINDOW // 4 - 1
MIN_SIMILARITY = 0.8
BLOCK_CHARS = 4_000_000  # characters of items sent to the executors at once; more items take more passes

_DROP = re.compile(r"[\W_]+")
_FLIPS = {k: np.array([0, *(1 << i for i in range(16) if k), *((1 << i) | (1 << j) for i in range(16) for j in range(i) if k > 1)], np.uint64) for k in (0, 1, 2)}
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(SHINGLE)], dtype=np.uint64)


def letters(text: str | None) -> str:
    """Lower-case letters and digits in compatibility form; null gives the empty string."""
    return _DROP.sub("", unicodedata.normalize("NFKC", text).lower()) if text else ""


def shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each run of SHINGLE characters."""
    n = len(codes) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    wide = codes.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for i, p in enumerate(_POWERS):
        h += wide[i : i + n] * p
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def fingerprints(hashes: np.ndarray, stride: int, window: int = WINDOW) -> np.ndarray:
    """SimHash of the windows at positions 0, stride, ...; each holds window - SHINGLE + 1 shingles."""
    groups = window - SHINGLE + 1
    step = 4  # shingles summed first; divides the strides of documents and the shingles of a window
    n = (len(hashes) - groups) // stride + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if stride % step:
        sums = np.cumsum(np.vstack([np.zeros((1, 64), np.int32), np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)]), axis=0, dtype=np.int32)
        ones = sums[groups::stride][:n] - sums[: len(sums) - groups : stride][:n]
    else:
        cut = len(hashes) // step * step
        bits = np.unpackbits(hashes[:cut].view(np.uint8).reshape(-1, 8), axis=1).reshape(-1, step, 64)
        part = bits[:, 0] + bits[:, 1] + bits[:, 2] + bits[:, 3]
        every = stride // step
        if window == WINDOW:
            ones = part[0 : (n - 1) * every + 1 : every].copy()
            for k in range(1, groups // step):
                ones += part[k : k + (n - 1) * every + 1 : every]
        else:
            sums = np.cumsum(np.vstack([np.zeros((1, 64), np.int32), part]), axis=0, dtype=np.int32)
            at = np.arange(n) * every
            ones = sums[at + groups // step] - sums[at]
    return np.packbits(ones * 2 > groups, axis=1).view(np.uint64).ravel()


assert all((w - SHINGLE + 1) % 4 == 0 and w // 4 % 4 == 0 for w in (WINDOW, *SIZES))


def own_size(length: int) -> int | None:
    """The largest window of an item whose every place meets a document's windows."""
    return max((w for w in SIZES if length >= w + w // 4 - 1), default=None)


class ItemIndex:
    """Fingerprints of one block of items in one size of window, with a table for each 16-bit block."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.window = window
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        prints, owner, place = [], [], []
        weights: Counter = Counter()
        for k, t in enumerate(self.texts):
            weights.update({t[i : i + SHINGLE] for i in range(len(t) - SHINGLE + 1)})
            if window != WINDOW and own_size(len(t)) != window:
                continue
            f = fingerprints(shingle_hashes(np.frombuffer(t.encode("utf-32-le"), np.uint32)), 1, window)
            prints.append(f)
            owner.append(np.full(len(f), k, np.int32))
            place.append(np.arange(len(f), dtype=np.int32))
        self.prints = np.concatenate(prints) if prints else np.empty(0, np.uint64)
        self.owner = np.concatenate(owner) if owner else np.empty(0, np.int32)
        self.place = np.concatenate(place) if place else np.empty(0, np.int32)
        self.idf = {s: math.log(1 + len(items) / n) for s, n in weights.items()}
        self.rare = math.log(1 + len(items))
        self.tables = []
        for b in range(4):
            key = ((self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            self.tables.append((order, np.searchsorted(key[order], np.arange(0x10001))))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item window) whose fingerprints are at most the radius apart."""
        radius = RADIUS[self.window]
        left, right = [], []
        for b, (order, start) in enumerate(self.tables):
            for turned in _FLIPS[radius // 4]:
                key = (((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)) ^ turned).astype(np.int64)
                n = start[key + 1] - start[key]
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                n = n[some]
                doc = np.repeat(some, n)
                offset = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                item = order[np.repeat(start[key[some]], n) + offset]
                near = np.bitwise_count(prints[doc] ^ self.prints[item]) <= radius
                left.append(doc[near])
                right.append(item[near])
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        return pairs[0], pairs[1]

    def similarity(self, a: str, b: str) -> float:
        """Weighted Jaccard of the two windows' shingles."""
        x, y = (Counter(s[i : i + SHINGLE] for i in range(len(s) - SHINGLE + 1)) for s in (a, b))
        w = lambda s: self.idf.get(s, self.rare)
        low = sum(w(s) * min(n, y[s]) for s, n in x.items() if s in y)
        high = sum(w(s) * max(x[s], y[s]) for s in x.keys() | y.keys())
        return low / high if high else 0.0


def common_run(a: str, i: int, b: str, j: int) -> int:
    """Length of the run shared at a[i] and b[j], widened to both sides."""
    n = len(a)
    lo = 0
    while i - lo > 0 and j - lo > 0 and a[i - lo - 1] == b[j - lo - 1]:
        lo += 1
    hi = 0
    while i + hi < n and j + hi < len(b) and a[i + hi] == b[j + hi]:
        hi += 1
    return lo + hi if hi else 0


def _scan(indexes: list[ItemIndex], ids: list[int], texts: list[str | None], part: int = 400_000):
    plain = [letters(t) for t in texts]
    pad = max(i.window for i in indexes) // 4
    at = 0
    while at < len(plain):
        to, size = at, 0
        while to < len(plain) and (to == at or size + len(plain[to]) <= part):
            size += len(plain[to]) + pad
            to += 1
        # Each document starts at a multiple of every stride.
        pads = [t + "\0" * (-len(t) % pad) for t in plain[at:to]]
        starts = np.cumsum([0, *map(len, pads)])
        hashes = shingle_hashes(np.frombuffer("".join(pads).encode("utf-32-le"), np.uint32))
        best: dict[tuple[int, int], list[float]] = {}
        for index in indexes:
            window, stride = index.window, index.window // 4
            whole: set[tuple[int, int]] = set()
            for w, k in zip(*(x.tolist() for x in index.within(fingerprints(hashes, stride, window)))):
                pos = w * stride
                d = int(np.searchsorted(starts, pos, side="right")) - 1
                text, i = plain[at + d], pos - int(starts[d])
                item, j = index.texts[index.owner[k]], int(index.place[k])
                key = (at + d, int(index.owner[k]))
                if i >= len(text) or key in whole:  # a window that begins behind the text
                    continue
                run, same = common_run(text, i, item, j), 1.0
                if run < WINDOW:
                    run, same = 0, index.similarity(text[i : i + window], item[j : j + window])
                    if same < MIN_SIMILARITY:
                        continue
                elif run == len(item):
                    whole.add(key)  # nothing more can be found of it
                old = best.setdefault(key, [0, 0.0])
                best[key] = [max(old[0], run), max(old[1], same)]
        for (d, k), (run, same) in best.items():
            yield ids[d], indexes[0].ids[k], int(run), same
        at = to


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """``(doc_id, item_id, run, similarity)``: the longest common run found through a window (0 where
    only similar windows were found) and the best weighted-shingle similarity of two windows.

    ``sizes`` are the windows sized by item; without any, runs are found all the same, edited passages only
    where WINDOW characters are next to unchanged. Items go to the executors in blocks of at most about BLOCK_CHARS characters; each block reads the
    documents once. Null or short texts match nothing; repeated documents each count.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).filter(F.length("t") >= WINDOW)
    items = items.select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("p")).filter("p is not null")
    total = items.agg(F.sum(F.length("p"))).first()[0] or 0
    blocks, out = max(1, math.ceil(total / BLOCK_CHARS)), None
    docs = spread(docs)
    for b in range(blocks):
        held = [(r.i, letters(r.p)) for r in items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).toLocalIterator()]
        sent = spark.sparkContext.broadcast(held)

        def scan(c, sent=sent):
            indexes = built(sent, lambda items: [ItemIndex(items, w) for w in (WINDOW, *sizes)])
            rows = list(_scan(indexes, c["d"], c["t"]))
            return dict(zip(("doc_id", "item_id", "run", "similarity"), map(list, zip(*rows)))) if rows else {k: [] for k in ("doc_id", "item_id", "run", "similarity")}

        part = arrow_map(docs, scan, "doc_id long, item_id long, run int, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A run of MIN_RUN letters holds a small window, so the others could add no row.
    runs = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), sizes=())
    return runs.filter(F.col("run") >= MIN_RUN).select("doc_id", "item_id").distinct()


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks}
