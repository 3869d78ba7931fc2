"""Problem 6: near-duplicate records with small edits.

Method: universe partition and pigeonhole. A text is its set of character trigrams. Sets are put into
size bands; in a band the trigrams are hashed into segments. Two sets of similarity SIMILARITY differ
in at most H trigrams, so few segments can differ: if there are H + 1 segments one is equal, if there
are (H + 1) / 2 one differs in at most one trigram. Signatures are therefore the segments' subsets and,
where the plan of the band says so, their one-deletion neighbourhoods. The plan is the cheapest of
those that either satisfy the pigeonhole in full or leave out the small (common, hence costly) segments
and take as many further segments as keep the chance, over the hashes, that a pair at the threshold
shares no signature at MISS (more similar pairs: far less). Pairs with a common signature are verified exactly.

Where the pigeonhole is satisfied in full, segments that hold next to nothing in both sets would be common
to unrelated texts. Sets that have such a segment are therefore cut up anew by another partition, under that
segment's number, and must agree in a segment of it as well; by the same pigeonhole they do.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.runtime import arrow_map, by_size, spread, table, written

from .classes import components, expanded

SIMILARITY = 0.8
RATIO = 1.25  # a band's sizes; a partner of at least 0.8 of the size is in the same or the next band
MISS = 1e-5
HITS = 2  # signatures a pair must share where the plan isn't exact
SURE_BELOW = 75  # trigrams below which the pigeonhole is satisfied in full
PAIR_COST, TEXT_COST = 5e3, 1e5  # cost in entries if all unrelated texts shared one signature, and two
SMALL = 500_000  # ids (8 bytes each) that may be broadcast
LIGHT, LEVELS = 2, 4  # trigrams of a segment up to which its sets are cut up anew, and how often
HOT = 256  # texts with one signature that are paired at once; more are paired block by block, in tasks of their own
BLOCK = 2_048

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _K[1]
    h = (h ^ (h >> np.uint64(27))) * _K[2]
    return h ^ (h >> np.uint64(33))


def band_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / math.log(RATIO) + 1e-9).astype(np.int64)


def most_different(a: float, b: float) -> int:
    """The largest symmetric difference of sets of sizes a and b that are similar enough."""
    return math.floor((a + b) * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9)


def _tail(mean: float, least: int) -> float:
    """P(Poisson(mean) >= least)."""
    return 1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(max(0, least)))


def background(n: float) -> float:
    """The similarity of unrelated texts with about n trigrams that the plans reckon with."""
    return min(0.45, 0.2 * math.sqrt(n / 250))


@functools.cache
def plan(band: int, sure_below: float = SURE_BELOW) -> tuple[int, int, int, int]:
    """(segments of a partition, segments used in all, smallest segment used, smallest segment whose
    deletions are used) of a band. Segments beyond one partition's come from further partitions of the
    universe by other hashes."""
    lo, hi = RATIO**band, math.ceil(RATIO ** (band + 1))
    h = most_different(hi, hi)
    half = (h + 2) // 2
    # One of so many segments differs in one trigram at most (in none, if there is no difference): nothing is missed.
    full = (half, half, 0, 1 if h else 99)
    if hi < sure_below:
        return full
    n = (lo + hi) / 2
    j = background(n)
    common, other = 2 * n * j / (1 + j), 2 * n * (1 - j) / (1 + j)
    wanted = 1.0
    while math.exp(-wanted) * (1 + wanted) > MISS:
        wanted += 0.1
    cases = [(hi, hi, h), (lo, lo, most_different(lo, lo)), (lo / RATIO, lo, most_different(lo / RATIO, lo))]
    best, least = full, math.inf
    for m in sorted({max(2, round(hi / x)) for x in (4, 5, 6, 7, 8, 9, 10, 12)}):
        for small in range(2, 10):
            for cut in (*range(small + 2, 15, 2), 99):
                gain = 1.0
                for a, b, d in cases:
                    shared = (a + b - d) / 2 / m
                    gain = min(gain, (1 - 1 / m) ** d * (_tail(shared, small) + d / (m - 1) * _tail(shared, max(small, cut - 1)) * (cut < 99)))
                used = math.ceil(wanted / gain) if gain > 1e-3 else 10_000
                entries = used * _tail(n / m, small) + (n * used / m * _tail(n / m, cut - 1) if cut < 99 else 0)
                chance = used * math.exp(-other / m) * (_tail(common / m, small) + other / m * _tail(common / m, cut - 1) * (cut < 99))
                cost = entries + PAIR_COST * chance + TEXT_COST * chance * chance / 2
                if used <= 600 and cost < least:
                    best, least = (m, used, small, cut), cost
    return best


def trigram_sets(norms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of hashed trigrams of all texts, one after the other, with each set's size."""
    codes = np.frombuffer("".join(norms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in norms])
    owner = np.repeat(np.arange(len(norms)), lengths)
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(len(norms), np.int64)
    h = _mix(codes[:-2] * _K[0] + codes[1:-1] * _K[1] + codes[2:] * _K[2])
    inside = owner[:-2] == owner[2:]
    keys = np.sort((owner[:-2][inside].astype(np.uint64) << np.uint64(44)) | (h[inside] >> np.uint64(20)))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    own = (keys >> np.uint64(44)).astype(np.int64)
    return own, _mix(keys & np.uint64((1 << 44) - 1)), np.bincount(own, minlength=len(norms))


def _segments(own: np.ndarray, t: np.ndarray, n: int, k: int, m: int, some: int, part: int, tag: np.ndarray | None):
    """Of ``n`` sets, given as tokens ``t`` with their owners: each token's segment of partition ``part`` of
    band ``k`` (of which the first ``some`` of ``m`` are used), its value in it, and by segment the number of
    tokens and their sum; what is hashed of a segment is told apart by its number and the set's tag."""
    value = _mix(t + np.uint64(k))
    place = ((t * (_K[part % 3] + np.uint64(2 * part)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    if some < m:
        keep = np.flatnonzero(place < some)
        own, place, value = own[keep], place[keep], value[keep]
    seg = own * some + place
    cells = n * some
    count = np.bincount(seg, minlength=cells)
    total = np.zeros(cells, np.uint64)
    np.add.at(total, seg, value)
    number = _mix(np.arange(cells, dtype=np.uint64) % np.uint64(some) + np.uint64(part * m + (k << 16)))
    if tag is not None:
        number ^= np.repeat(tag, some)
    total += number + count.astype(np.uint64) * _K[2]
    return seg, value, count, total, number


def _sure(own: np.ndarray, t: np.ndarray, n: int, k: int, m: int, cut: int):
    """``(signature, set, is a deletion)`` of a plan without misses. A segment of more than LIGHT tokens in one
    of two sets that differ in one of them at most is met as it is and by its deletions; sets with a lighter
    one go on to the next partition under its number."""
    ids, tag = np.arange(n), None
    for level in range(LEVELS):
        last = level == LEVELS - 1 or m == 1
        seg, value, count, total, number = _segments(own, t, len(ids), k, m, m, 10 * level, tag)
        least = 0 if last else LIGHT
        hit = np.flatnonzero(count >= least)
        yield total[hit], ids[hit // m], 0
        if cut < 99:
            at = np.flatnonzero(count[seg] > least)
            yield total[seg[at]] - value[at] - _K[2], ids[seg[at] // m], 1
        light = np.flatnonzero(count <= LIGHT)
        if last or not len(light):
            return
        # Each light segment of a set makes a set of the next level, with all its tokens.
        start = np.searchsorted(own, np.arange(len(ids) + 1))
        owner = light // m
        sizes = start[owner + 1] - start[owner]
        own_next = np.repeat(np.arange(len(light)), sizes)
        t = t[np.repeat(start[owner], sizes) + np.arange(len(own_next)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        tag = _mix(number[light] + _K[1])
        own, ids = own_next, ids[owner]


def signatures(own: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, sure_below: float = SURE_BELOW) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) of all sets. The signature's three lowest bits are its kind, bit 0: a deletion,
    bit 1: the set is of the band below, bit 2: the plan is exact."""
    sig, who = [], []
    bands = band_of(sizes)
    band_own = bands[own]

    def add(s: np.ndarray, w: np.ndarray, kind: int) -> None:
        sig.append(_mix(s) & np.uint64(0xFFFFFFFFFFF80000) | np.uint64(kind << 16))
        who.append(w)

    for band in np.unique(bands[sizes > 0]).tolist():
        take = np.flatnonzero(band_own == band)
        mine = own[take]  # in order
        new = np.concatenate([[True], mine[1:] != mine[:-1]])
        sets, local = mine[new], np.cumsum(new) - 1
        t = tokens[take]
        for lower in (0, 1):
            k = band + lower
            m, used, small, cut = plan(k, sure_below)
            if not small:
                for s, w, kind in _sure(local, t, len(sets), k, m, cut):
                    add(s, sets[w], 4 + 2 * lower + kind)
                continue
            for part in range(-(-used // m)):
                some = min(m, used - part * m)  # the last partition gives only its first segments
                seg, value, count, total, _ = _segments(local, t, len(sets), k, m, some, part, None)
                hit = np.flatnonzero(count >= small)
                add(total[hit], sets[hit // some], 2 * lower)
                if cut < 99:
                    at = np.flatnonzero((count[seg] >= cut) & (count[seg] > small))
                    add(total[seg[at]] - value[at] - _K[2], sets[seg[at] // some], 2 * lower + 1)
    if not sig:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(sig) >> np.uint64(16), np.concatenate(who)


def _merged(left: list[np.ndarray], right: list[np.ndarray], hits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and the sums of their hits."""
    if not left or not sum(map(len, left)):
        return tuple(np.empty(0, np.int64) for _ in range(3))
    a, b, n = np.concatenate(left), np.concatenate(right), np.concatenate(hits)
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.add.reduceat(n, first).astype(np.int64)


def _worth(kind_a: np.ndarray, kind_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> np.ndarray:
    """Which of the pairs count: not both by deletion nor both of the band below."""
    return (kind_a & kind_b & np.uint64(3) == 0) & (ids_a != ids_b)


def shared_signatures(sig: np.ndarray, ids: np.ndarray, hot: int = HOT) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """Distinct pairs of ids with common signatures and how many they have (one of an exact plan counts as
    HITS); and the ``(kinds, ids)`` of each signature that more than ``hot`` entries have."""
    order = np.argsort(sig, kind="stable")
    key, ids, kind = sig[order] >> np.uint64(3), ids[order], sig[order] & np.uint64(7)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    size = np.diff(edge)
    dense = [(kind[a : a + n], ids[a : a + n]) for a, n in zip(edge[:-1][size > hot].tolist(), size[size > hot].tolist())]
    at = np.flatnonzero(np.repeat(size <= hot, size))
    left, right, hits = [], [], []
    step = 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        ok = at[_worth(kind[at], kind[at + step], ids[at], ids[at + step])]
        left.append(np.minimum(ids[ok], ids[ok + step]))
        right.append(np.maximum(ids[ok], ids[ok + step]))
        hits.append(np.where(kind[ok] >= 4, HITS, 1))
    return _merged(left, right, hits), dense


def block_pairs(kind_a: np.ndarray, ids_a: np.ndarray, kind_b: np.ndarray, ids_b: np.ndarray, same: bool, rows: int = 256):
    """Pairs of two blocks of one signature's entries, or of one block (``same``), some of its rows at a time."""
    for k in range(0, len(ids_a), rows):
        i, j = np.meshgrid(np.arange(k, min(k + rows, len(ids_a))), np.arange(len(ids_b)), indexing="ij")
        i, j = i.ravel(), j.ravel()
        ok = _worth(kind_a[i], kind_b[j], ids_a[i], ids_b[j]) & ((i < j) | (not same))
        i, j = i[ok], j[ok]
        yield _merged([np.minimum(ids_a[i], ids_b[j])], [np.maximum(ids_a[i], ids_b[j])], [np.where(kind_a[i] >= 4, HITS, 1)])


def _pack(sig: np.ndarray, ids: np.ndarray) -> tuple[bytes, bytes]:
    """Six bytes a signature; four an id where all fit."""
    ids = ids.astype(np.uint32) if len(ids) and 0 <= ids.min() and ids.max() < 1 << 32 else ids.astype(np.int64)
    return sig.view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), ids.tobytes()


def _unpack(sig: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(sig) // 6
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(sig, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel(), np.frombuffer(ids, np.uint32 if len(ids) == 4 * n else np.int64).astype(np.int64)


def jaccard(a: str, b: str) -> float:
    x, y = ({s[i : i + 3] for i in range(len(s) - 2)} for s in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def few(ids: DataFrame, label: str) -> DataFrame:
    """``ids``, written, and to be broadcast if there are at most SMALL; joined by a shuffle otherwise."""
    ids = written(ids, label)
    return F.broadcast(ids) if ids.count() <= SMALL else ids


def similar_pairs(texts: DataFrame, sure_below: float = SURE_BELOW) -> DataFrame:
    """``(id_a, id_b, similarity)`` of all distinct texts ``(id, norm)`` that are similar enough. With
    ``sure_below`` infinite the pigeonhole is satisfied in full for sets of every size, at a higher cost."""
    rows = texts.count()
    buckets = 1 << max(4, math.ceil(math.log2(max(1, rows / 1500))))
    bits = int(math.log2(buckets))

    def sign(batches):
        schema = pa.schema([("bucket", pa.int32()), ("sig", pa.binary()), ("who", pa.binary())])
        for b in batches:
            norms, ids = b.column(1).to_pylist(), b.column(0).to_numpy(zero_copy_only=False)
            parts = [(signatures(*trigram_sets(norms[s]), sure_below), s.start) for s in by_size(norms, 3_000_000)]
            sig = np.concatenate([np.empty(0, np.uint64), *(p[0] for p, _ in parts)])
            who = np.concatenate([np.empty(0, np.int64), *(p[1] + at for p, at in parts)])
            order = np.argsort(sig)
            sig, who = sig[order], ids[who[order]]
            edges = np.searchsorted((sig >> np.uint64(48 - bits)).astype(np.int64), np.arange(buckets + 1))
            some = [k for k in range(buckets) if edges[k] < edges[k + 1]]
            blobs = [_pack(sig[edges[k] : edges[k + 1]], who[edges[k] : edges[k + 1]]) for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([x[i] for x in blobs], pa.binary()) for i in (0, 1))], schema=schema)

    def meet(group: pa.Table) -> pa.Table:
        parts = [_unpack(s, w) for s, w in zip(group.column("sig").to_pylist(), group.column("who").to_pylist())]
        (a, b, n), dense = shared_signatures(np.concatenate([s for s, _ in parts]), np.concatenate([w for _, w in parts]))
        cut = [[(k[i : i + BLOCK].astype(np.uint8).tobytes(), w[i : i + BLOCK].tobytes()) for i in range(0, len(w), BLOCK)] for k, w in dense]
        pairs = [(x, y) for blocks in cut for i, x in enumerate(blocks) for y in blocks[i:]]
        ids, none = [pa.array(x, pa.int64()) for x in (a, b, n)], pa.nulls(len(pairs), pa.int64())
        columns = {name: pa.concat_arrays([x, none]) for name, x in zip(("id_a", "id_b", "n"), ids)}
        for side in (0, 1):
            for part, name in enumerate(("kind", "ids")):
                columns[f"{name}_{'ab'[side]}"] = pa.concat_arrays([pa.nulls(len(a), pa.binary()), pa.array([p[side][part] for p in pairs], pa.binary())])
        return pa.table(columns)

    def unfold(batches):
        schema = pa.schema([("id_a", pa.int64()), ("id_b", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            for r in batch.to_pylist():
                sides = [(np.frombuffer(r[f"kind_{x}"], np.uint8).astype(np.uint64), np.frombuffer(r[f"ids_{x}"], np.int64)) for x in "ab"]
                for found in block_pairs(*sides[0], *sides[1], r["ids_a"] == r["ids_b"] and r["kind_a"] == r["kind_b"]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=schema)

    packed = spread(texts).select("id", "norm").mapInArrow(sign, "bucket int, sig binary, who binary")
    blocks = "kind_a binary, ids_a binary, kind_b binary, ids_b binary"
    met = written(packed.groupBy("bucket").applyInArrow(meet, f"id_a long, id_b long, n long, {blocks}"), "p6-met")
    dense = met.filter("id_a is null").select("kind_a", "ids_a", "kind_b", "ids_b")
    cores = texts.sparkSession.sparkContext.defaultParallelism
    dense = dense.repartition(4 * cores, F.xxhash64("ids_a", "ids_b")).mapInArrow(unfold, "id_a long, id_b long, n long")
    met = met.filter("id_a is not null").select("id_a", "id_b", "n").unionByName(dense)
    candidates = written(met.groupBy("id_a", "id_b").agg(F.sum("n").alias("n")).filter(F.col("n") >= HITS).select("id_a", "id_b"), "p6-candidates")
    held = texts.join(few(candidates.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), "p6-ids"), "id", "left_semi")
    both = candidates.join(held.select(F.col("id").alias("id_a"), F.col("norm").alias("norm_a")), "id_a").join(held.select(F.col("id").alias("id_b"), F.col("norm").alias("norm_b")), "id_b")

    def verify(c):
        return {"id_a": c["id_a"], "id_b": c["id_b"], "similarity": [jaccard(a, b) for a, b in zip(c["norm_a"], c["norm_b"])]}

    return arrow_map(both, verify, "id_a long, id_b long, similarity double").filter(F.col("similarity") >= SIMILARITY - 1e-12)


def normal(text: str):
    return F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", "")


def near_duplicates(df: DataFrame, id_col: str, text: str, field: str, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """The pairs ``(id_a, id_b, similarity)`` of representatives of exact copies (their smallest ids),
    and the membership ``(id, rep, copies)`` of every row with at least three letters or digits.
    Null and shorter texts belong to no group; rows stored twice are copies of each other. ``exact`` takes
    the plans that miss nothing for texts of every size."""
    base = df.select(F.col(id_col).cast("long").alias("id"), normal(text).alias("norm")).filter(F.length("norm") >= 3)
    keys = written(base.select("id", F.md5("norm").alias("k")), f"p6-keys-{field}")
    reps = keys.groupBy("k").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members = written(keys.join(reps, "k").select("id", "rep", "copies"), f"p6-members-{field}")
    copies = few(members.filter("id != rep").select("id"), f"p6-copies-{field}")
    return similar_pairs(written(base.join(copies, "id", "left_anti"), f"p6-texts-{field}"), math.inf if exact else SURE_BELOW), members


def _fields(spark: SparkSession, sf_dir: str):
    return (("content", table(spark, sf_dir, "structured_chunks"), "chunk_id", "content"), ("text", table(spark, sf_dir, "parsed_segments"), "segment_id", "text"))


def _pairs_and_members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs, members = [], []
    for field, df, id_col, text in _fields(spark, sf_dir):
        p, m = near_duplicates(df, id_col, text, field)
        pairs.append(written(p, "p6-pairs").select(F.lit(field).alias("field"), "id_a", "id_b"))
        members.append(m.select(F.lit(field).alias("field"), "id", "rep", "copies"))
    return pairs[0].unionByName(pairs[1]), members[0].unionByName(members[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded(*_pairs_and_members(spark, sf_dir), inside=True)


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(field, id, rep, copies, links, group_id)`` of every row with three letters or digits: the first row
    with the same text and how many there are, the number of other texts that are similar to it, and the
    smallest id of the texts it is linked to over any number of steps."""
    pairs, members = _pairs_and_members(spark, sf_dir)
    ends = pairs.select("field", F.explode(F.array("id_a", "id_b")).alias("rep"))
    links = ends.groupBy("field", "rep").agg(F.count("*").alias("links"))
    whole = components(pairs).select("field", F.col("id").alias("rep"), "group_id")
    rows = members.join(links.join(whole, ["field", "rep"]), ["field", "rep"], "left")
    return rows.select("field", "id", "rep", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("group_id", "rep").alias("group_id"))


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
