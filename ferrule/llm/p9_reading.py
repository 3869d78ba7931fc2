"""Problem 9: reading level of each document.

Method: L2-regularised ordinal (proportional odds) regression over length, lexical diversity, word
rarity, connective and clause-depth features, fitted to the rated documents, whose grades calibrate it.
Words and Chinese character pairs are the lexical units; how often each occurs is counted over all
documents in a hashed table of 2**BITS cells, so the table has one size whatever the corpus.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.runtime import arrow_map, by_size, spread, table, written

BITS = 17
GRADES = 14
MAX_RATED = 20_000  # rated documents used for the fit, those with the smallest hash
L2 = 1e-3

# Words that join clauses.
CONNECTIVES_EN = "because although though whereas while unless since therefore hence thus moreover furthermore however nevertheless notwithstanding provided insofar thereby wherein which whose whether if when until consequently accordingly".split()
CONNECTIVES_ZH = "因为 所以 虽然 但是 然而 因此 从而 并且 而且 不仅 除非 即便 尽管 鉴于 倘若 若干 以及 抑或 进而 故而 如果 由于 根据 按照 为了 考虑 此类 其中 纵使 之间".split()

_K1, _K2, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0x2545F4914F6CDD1D
HAN, LETTER, DIGIT, END, CLAUSE, SPACE = 1, 2, 3, 4, 5, 6


@functools.cache
def _classes() -> np.ndarray:
    out = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        c = chr(cp)
        cat = unicodedata.category(c)
        if 0x4E00 <= cp < 0xA000 or 0x3400 <= cp < 0x4DC0:
            out[cp] = HAN
        elif cat[0] in "LM":
            out[cp] = LETTER
        elif cat == "Nd":
            out[cp] = DIGIT
        elif c.isspace():
            out[cp] = SPACE
    for c in "。！？!?；;\n.":
        out[ord(c)] = END
    for c in "，、,：:（(—":
        out[ord(c)] = CLAUSE
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _K2
    return h ^ (h >> np.uint64(29))


class Tokens:
    """Units of a batch of texts as arrays: the text each belongs to, its hash, and its kind."""

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower() for t in texts]
        self.n = len(low)
        codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) + 1 for t in low])
        self.doc = np.repeat(np.arange(self.n), lengths)
        cls = _classes()[np.minimum(codes, 0xFFFF)]
        cls[codes > 0xFFFF] = HAN
        dot = np.flatnonzero(codes == ord("."))
        after = np.minimum(dot + 1, len(codes) - 1)
        cls[dot[(cls[after] != SPACE) & (codes[after] != 10)]] = 0  # a decimal point or part of a name
        self.cls, self.codes = cls, codes
        han = cls == HAN
        wide = codes.astype(np.uint64)
        pair = np.flatnonzero(han[:-1] & han[1:])
        pair_hash = _mix(wide[pair] * _K1 + wide[pair + 1] * _K2)
        letter = cls == LETTER
        edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
        self.start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.width = end - self.start
        # A polynomial hash of each word in one pass: a prefix sum, shifted back by the inverse power.
        powers = np.cumprod(np.full(len(codes), _B, np.uint64))
        back = np.cumprod(np.full(len(codes), pow(_B, -1, 1 << 64), np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * letter * powers)])
        word_hash = _mix((total[end] - total[self.start]) * back[self.start]) if len(self.start) else np.empty(0, np.uint64)
        self.pair, self.pair_hash, self.word_hash = pair, pair_hash, word_hash
        self.owner = np.concatenate([self.doc[pair], self.doc[self.start]])
        self.hash = np.concatenate([pair_hash, word_hash])
        self.cell = (self.hash >> np.uint64(64 - BITS)).astype(np.int64)


@functools.cache
def _connectives() -> np.ndarray:
    t = Tokens(CONNECTIVES_EN + CONNECTIVES_ZH)
    return np.unique(t.hash)


NAMES = ("tokens", "han", "sentence", "weighted", "clauses", "clause", "word", "long", "longer", "rare_word", "rare_pair", "distinct", "connective", "digit", "exclaim", "over12", "over25", "over45", "over70")


def features(texts: list[str | None], counts: np.ndarray) -> np.ndarray:
    """One row of features a text; an empty text's are all 0."""
    t, total = Tokens(texts), max(1.0, float(counts.sum()))
    n, doc = t.n, t.doc
    by = lambda d, w=None: np.bincount(d, weights=w, minlength=n).astype(np.float64)
    safe = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    han = t.cls == HAN
    han_n, word_n = by(doc[han]), by(t.doc[t.start])
    units = han_n / 1.7 + word_n
    # Sentences: units between end marks; those without units don't count.
    ends = np.flatnonzero(t.cls == END)
    weight = np.zeros(len(t.cls))
    weight[han] = 1 / 1.7
    weight[t.start] += 1
    cum = np.concatenate([[0.0], np.cumsum(weight)])
    size = np.diff(np.concatenate([[0.0], cum[ends + 1]]))
    real = size > 0.9
    s_doc, size = doc[ends[real]], size[real]
    sentences = by(s_doc)
    marks = by(doc[t.cls == CLAUSE])
    words = t.doc[t.start]
    rare = -np.log2((counts[t.cell] + 1.0) / total)
    split = len(t.pair)
    keys = np.sort((t.owner.astype(np.uint64) << np.uint64(40)) | (t.hash >> np.uint64(24)))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    distinct = by((keys >> np.uint64(40)).astype(np.int64))
    tokens = by(t.owner)
    out = np.stack([
        np.log1p(tokens), safe(han_n, han_n + word_n * 5), np.log1p(safe(units, sentences)), np.log1p(safe(by(s_doc, size * size), by(s_doc, size))),
        np.log1p(safe(marks, sentences)), np.log1p(safe(units, sentences + marks)), safe(by(words, t.width), word_n), safe(by(words, t.width >= 9), word_n), safe(by(words, t.width >= 12), word_n),
        safe(by(t.owner[split:], rare[split:]), word_n), safe(by(t.owner[:split], rare[:split]), by(t.owner[:split])), safe(distinct, np.maximum(tokens, 1) ** 0.85),
        safe(by(t.owner, np.isin(t.hash, _connectives())), sentences), safe(by(doc[t.cls == DIGIT]), units), safe(by(doc[(t.codes == 33) | (t.codes == 0xFF01)]), sentences),
        *(safe(by(s_doc, size * (size > k)), by(s_doc, size)) for k in (12, 25, 45, 70)),
    ], axis=1)
    return np.concatenate([out, out * out[:, 1:2]], axis=1)


class OrdinalModel:
    """P(grade > k) = sigmoid(w.x - theta_k), theta increasing."""

    def __init__(self, mean, scale, w, theta):
        self.mean, self.scale, self.w, self.theta = mean, scale, w, theta

    @classmethod
    def fit(cls, x: np.ndarray, grade: np.ndarray, steps: int = 600) -> OrdinalModel:
        mean, scale = x.mean(0), x.std(0) + 1e-6
        z = np.clip((x - mean) / scale, -5, 5)
        above = grade[:, None] > np.arange(1, GRADES)[None, :]
        share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
        p = np.concatenate([np.zeros(z.shape[1]), np.log((1 - share) / share)])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, steps + 1):  # Adam on the sum of the cumulative log losses
            s = z @ p[: z.shape[1]]
            prob = 1 / (1 + np.exp(-np.clip(s[:, None] - p[None, z.shape[1] :], -30, 30)))
            err = (prob - above) / len(z)
            g = np.concatenate([z.T @ err.sum(1) + L2 * p[: z.shape[1]], -err.sum(0)])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        return cls(mean, scale, p[: z.shape[1]], np.sort(p[z.shape[1] :]))

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 1 .. GRADES - 1."""
        s = np.clip((x - self.mean) / self.scale, -5, 5) @ self.w
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.theta[None, :], -30, 30)))

    def grade(self, x: np.ndarray) -> np.ndarray:
        return 1 + self.above(x).sum(1)


def unit_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Hashed counts of all units of all documents."""

    def count(batches):
        held = np.zeros(1 << BITS, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for part in by_size(texts, 2_000_000):
                held += np.bincount(Tokens(texts[part]).cell, minlength=1 << BITS)
        cells = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(held[cells])], names=["cell", "n"])

    rows = docs.select(text).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << BITS, np.int64)
    counts[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def reading_grades(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, grade, p_above)``: the expected grade, and P(grade >= 10).

    Null, empty and letterless texts have null grades, as have all if no document is rated. A document
    rated several times weighs each rating; rows stored twice are graded each.
    """
    docs = spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    sent = docs.sparkSession.sparkContext.broadcast(unit_counts(docs, "text"))

    def measure(c):
        x = np.concatenate([features(c["text"][part], sent.value) for part in by_size(c["text"], 2_000_000)])
        return {"doc_id": c["doc_id"], "x": [row if row[0] > 0 else None for row in x.astype(np.float32)]}

    measured = written(arrow_map(docs, measure, "doc_id long, x array<float>"), "p9-features")
    rated = ratings.filter(f"grade between 1 and {GRADES}").groupBy("doc_id").agg(F.collect_list("grade").alias("grades"))
    sample = measured.filter("x is not null").join(rated, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_RATED).select("x", "grades").toPandas()
    empty = F.lit(None).cast("double")
    if sample.empty:
        return measured.select("doc_id", empty.alias("grade"), empty.alias("p_above"))
    x = np.repeat(np.stack(sample["x"].to_numpy()).astype(np.float64), [len(g) for g in sample["grades"]], axis=0)
    model = OrdinalModel.fit(x, np.concatenate([np.asarray(g) for g in sample["grades"]]))

    def grade(c):
        ok = [v is not None for v in c["x"]]
        at = np.array([v for v in c["x"] if v is not None], np.float64).reshape(sum(ok), -1)
        g, p = (iter(model.grade(at)), iter(model.above(at)[:, 8])) if sum(ok) else (iter(()), iter(()))
        return {"doc_id": c["doc_id"], "grade": [next(g) if o else None for o in ok], "p_above": [next(p) if o else None for o in ok]}

    return arrow_map(measured, grade, "doc_id long, grade double, p_above double")


def p9_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_grades(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_grades(spark, sf_dir).filter("p_above >= 0.5").select("doc_id").distinct()


QUERIES = {"p9_found": p9_found, "p9_grades": p9_grades}
