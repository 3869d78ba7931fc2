"""Problem 5: broken prompt and response pairs.

Method: a multi-label linear (logistic) classifier over hashed n-grams of the response and features of
the pair. It is fitted to pairs of a table, taken as sound, and to defects made from them: responses cut
short, replaced by the question, swapped for other languages, refused or emptied. Pairs the first fit
finds defective leave the sound set before the second fit. A threshold for each label is calibrated on
pairs that were held out before any defect was made. ``python -m ferrule.llm.p5_pairs TABLES`` fits the
model of ``p5_model.npz`` to the golden set of a folder; ``broken_pairs(fit=True)`` fits one to its table.
"""

from __future__ import annotations

import functools
import io
import random
import re
import sys
import unicodedata
import zlib
from collections import Counter
from importlib.resources import files
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.runtime import arrow_map, spread, table

LABELS = ("empty", "truncated", "refusal", "copy", "language")
BITS = 17
MAX_FIT = 3_000  # pairs the fit is made from, those with the smallest hash of their id
FIT_PAIRS = 3_000  # sound pairs the made ones are drawn from, counted with repetition
EPOCHS = 4
FOLDS = 4
COMMON = 0.015
HELD = 0.15  # share of the pairs that only calibrate
MODEL = Path(__file__).with_name("p5_model.npz")

# Responses that decline, for the making of refusals. {} is a name.
REFUSALS_ZH = """抱歉，我无法回答这个问题。|对不起，我不能提供这方面的信息。|很抱歉，我帮不了您。|不好意思，这个问题我回答不了。|该问题超出了我的能力范围。|我没有权限查看这些内容。|根据规定，恕不提供此类内容。|我无法协助处理这个请求。|无可奉告。|暂时不能为您解答，请谅解。|很遗憾，这件事我帮不上忙，请咨询相关部门。|请换一个问题。|这个问题不便回答。|作为助手，我不能谈论{}。|恕我不能透露。|我不被允许讨论这个话题。|抱歉，无法提供帮助。|此类请求我不能处理。|我拒绝回答这个问题。|关于{}，我不方便多说。|您的请求无法完成，请谅解。|这方面的内容我不予置评。|请咨询其他人员，我无从回答。|对不起，这不在我的服务范围内。""".split("|")
REFUSALS_EN = """I'm sorry, but I can't help with that.|I cannot answer this question.|Sorry, I am not able to assist with this request.|I must decline to answer.|No comment.|As an assistant I am not able to discuss {}.|My guidelines do not allow me to talk about {}.|I'd rather not comment on {}.|Unfortunately this request cannot be fulfilled.|Please try asking something else.|I am unable to provide that information.|That is outside of what I can help with.|I won't be able to answer that.|I apologise, but I cannot share details about {}.|I do not have permission to answer questions about {}.|It would not be appropriate for me to answer.|I refuse to answer.|This is beyond my abilities, sorry.|I can't discuss {}.|We are not allowed to disclose this.|Please ask someone else about {}.|I have to pass on this one.|Regrettably, I can't assist you here.|I'm afraid I can't do that.""".split("|")
# Sentences in languages neither side uses, for the making of swapped responses.
FOREIGN = """Die Frist endet nach {} Tagen, danach entscheidet die Leitung.|Das Konto wird von der Verwaltung innerhalb von {} Stunden freigeschaltet.|Bitte wenden Sie sich an die zuständige Abteilung.|Der Antrag muss bis zum {} eingereicht werden und ist nicht übertragbar.|Ja, das ist mit Zustimmung des Leiters möglich.|Le dossier doit être rendu sous {} jours, sauf accord du chef.|La demande est traitée par le service des finances.|Il faut remplir le formulaire et le remettre avant le {}.|Non, seuls les administrateurs peuvent le supprimer.|Les journaux sont conservés pendant {} jours puis effacés.|El equipo revisa la solicitud en {} días hábiles.|La garantía dura {} meses desde la compra.|No, solo el responsable puede borrar los archivos.|Hay que presentar el formulario antes del día {} de cada mes.|Il modulo va consegnato entro {} giorni al responsabile.|La garanzia dura {} mesi dalla data di acquisto.|O pedido é analisado pela equipe em {} dias úteis.|A conta é aberta pelo administrador do sistema.|De aanvraag wordt binnen {} dagen door de afdeling behandeld.|Wniosek należy złożyć w ciągu {} dni.|Заявка рассматривается отделом в течение {} дней.|Гарантия действует {} месяцев с даты покупки.|申請は{}日以内に担当部署で処理されます。|保証期間は購入日から{}か月です。|신청서는 {}일 이내에 담당 부서에서 처리됩니다.|보증 기간은 구입일로부터 {}개월입니다.""".split("|")
FILLERS = ["", " ", "\n", "​", "　", ".", "。", "...", "…", "-", "--", "——", "?", "N/A", "n/a", "TBD", "tbd", "null", "NULL", "None", "nil", "TODO", "todo", "xxx", "待补充", "待定", "无", "略", "暂无", "（空）", "to be added", "pending", "empty", "占位", "稍后补充"]
TAILS_ZH = ["，其中", "，由于该", "，以及", "，但不超过", "；若", "，因为", "，并且", "，由", "（", "：", "的", "，应当", "，直到", "，须在", "，", "、", "和", "或", "，如果", "，而"]
TAILS_EN = [" and", " the", " of the", " because the", " such as", ", which", " whi", " to bec", " (", ":", "; how", ",", " at the", " with", " or", " in order to", " if the", " that", "...", " for"]
LEADS_COPY = ["", "", "", "", "The question is: ", "You asked: ", "Q: ", "您问的是：", "问题是：", "问：", "您想知道"]

# Short answers that are complete, for the making of sound pairs. {} is a number.
SHORT_ZH = """区域负责人|财务经理|人事部|三个工作日|{}天|是的|不可以|可以|每月{}号|总务科|部门主管|客服中心|电子邮件|第{}会议室|星期一|每年一次|不需要|需要|一年|{}小时内|法务顾问|仓库管理员|项目经理|线上申请|{}元|{}%|王经理|信息安全岗|上午九点|由申请人自己""".split("|")
SHORT_EN = """The regional lead|The finance manager|Two weeks|{} days|Yes|No|Within {} hours|On the first of the month|The front desk|Once a year|By e-mail|Room {}|Monday morning|Not at all|Only the owner|Human resources|About {} percent|The site office|Ten euros|{} euros|Every quarter|At nine|The team lead|Their supervisor|In the archive|Legal counsel|A signed form|The warehouse keeper|Up to {}|The applicant""".split("|")

_SENTENCE_END = re.compile(r"[。．.！!？?”\"'）)》」]\s*$")
_VISIBLE = re.compile(r"[\w]")
_HAN = re.compile(r"[㐀-鿿]")
_EN_WORDS = set("the a an of to in is are and or for with by it this that be can within on at from as not no only must may will if days who which when how what does do has have was".split())


def _plain(s: str) -> str:
    s = unicodedata.normalize("NFKC", s).lower()
    return re.sub(r"[^\w]|_", "", s)


def _shape(s: str) -> str:
    """Lower case, digits as 9, invented names as x."""
    s = unicodedata.normalize("NFKC", s)
    s = re.sub(r"(?<![.!?] )(?<!^)\b[A-Z][a-z]{2,}\b", "Xx", s)
    return re.sub(r"\d+", "9", s.lower())


def pair_features(question: str | None, answer: str | None, answerable: bool | None) -> tuple[list[int], list[float]]:
    """Cells and values of the sparse feature vector."""
    q, a = question or "", answer or ""
    cells: dict[int, float] = {}

    def add(name: str, value: float = 1.0) -> None:
        cells[zlib.crc32(name.encode()) >> (32 - BITS)] = value

    add("bias")
    can = answerable is not False
    pa, pq = _plain(a), _plain(q)
    shape = _shape(a).strip()
    words = re.findall(r"[^\W\d_㐀-鿿]+|[㐀-鿿]|9", shape)
    flag = "can" if can else "cannot"
    grams = {f"w{w}" for w in words} | {f"w{x} {y}" for x, y in zip(words, words[1:])} | {f"w{x} {y} {z}" for x, y, z in zip(words, words[1:], words[2:])}
    scale = 1 / max(1.0, len(grams)) ** 0.5
    for g in grams:
        add(g, scale)
        add(f"{flag}{g}", scale)
    first = words[:6]
    for n in range(1, len(first) + 1):
        add(f"{flag}S{' '.join(first[:n])}", 0.5)
    for n in range(1, 7):
        add(f"E{shape[-n:]}", 0.5)
    last = words[-3:]
    for n in range(1, len(last) + 1):
        add(f"T{' '.join(last[-n:])}", 0.5)
    ended = bool(_SENTENCE_END.search(shape)) and not shape.endswith(("...", "…"))
    size = len(words)
    add(f"end{ended}")
    add(f"end{ended}size{min(size, 12) if size < 12 else 12 + min(size // 8, 6)}")
    add(f"dots{shape.endswith(('...', '…'))}size{size > 3}")
    add(f"mark{shape[-1:] if shape and not shape[-1].isalnum() else 'w'}", 2.0)
    # The pair: how much of each side the other holds.
    qa, aa = ({p[i : i + 2] for i in range(len(p) - 1)} for p in (pq, pa))
    cover = len(aa & qa) / len(aa) if aa else 0.0
    back = len(aa & qa) / len(qa) if qa else 0.0
    new = len(aa - qa)
    add(f"cover{round(cover * 10)}", 2.0)
    add(f"back{round(back * 10)}", 2.0)
    add(f"new{min(new, 8)}back{back > 0.85}", 3.0)
    add(f"same{bool(pa) and pa == pq}", 3.0)
    add(f"inside{bool(pq) and pq in pa}more{min(8, max(0, len(pa) - len(pq)))}lead{pa.startswith(pq)}", 2.0)
    # Languages of both sides and whether the question asks for another one.
    def tongue(s: str) -> str:
        letters = [c for c in s if c.isalpha()]
        if not letters:
            return "none"
        han = len(_HAN.findall(s)) / len(letters)
        if any("぀" <= c < "ㇰ" or "가" <= c < "힤" or "Ѐ" <= c < "԰" or "؀" <= c < "܀" for c in letters):
            return "script"
        if han > 0.25:
            return "zh"
        low = re.findall(r"[^\W\d_]+", s.lower())
        if len(low) < 3:
            return "few"
        hits = sum(w in _EN_WORDS for w in low) / len(low)
        return "en" if hits >= 0.2 else "en?" if hits > 0 and s.isascii() else "latin"

    tq, ta = tongue(q), tongue(a)
    asks = bool(re.search(r"英文|英语|中文|汉语|日文|翻译|怎么(?:写|说)|\b(?:chinese|english|french|german|spanish|japanese|translat\w*|word for)\b", q.lower()))
    add(f"{tq}>{ta}asks{asks}", 3.0)
    add(f"{tq}>{ta}", 1.0)
    # Nothing visible, or a filler.
    visible = len(_VISIBLE.findall(a))
    add(f"{flag}null{answer is None}", 3.0)
    add(f"{flag}visible{min(visible, 3)}", 3.0)
    if len(shape) <= 14:
        add(f"{flag}W{shape}", 2.0)
        add(f"{flag}P{pa}", 2.0)
    return list(cells), list(cells.values())


def _made(pairs: list[tuple], rng: random.Random) -> list[tuple[tuple, int]]:
    """Defective pairs made from sound ones, with the index of their label."""
    out = []
    good = [p for p in pairs if p[1] and _VISIBLE.search(p[1]) and p[2] is not False]
    zh = [p for p in good if _HAN.search(p[1])]
    en = [p for p in good if not _HAN.search(p[1]) and len(p[1].split()) >= 3]
    asks = re.compile(r"英文|英语|中文|汉语|翻译|\b(?:Chinese|English|word for)\b")
    for q, a, _ in good:
        han = bool(_HAN.search(a))
        if rng.random() < 0.6:
            out.append(((q, rng.choice(FILLERS) if rng.random() < 0.7 else None, True), 0))
        for _ in range(2):
            base = a.rstrip()
            if rng.random() < 0.4 and good:  # a second sentence, cut in the middle
                more = rng.choice(zh if han and zh else en if en and not han else good)[1]
                base = base.rstrip("。.") + rng.choice(["。", "，"] if han else [". ", ", and "]) + more
            if len(base) > (6 if han else 14):
                cut = base[: rng.randint(max(2, len(base) // 3), len(base) - 2)].rstrip()
                if rng.random() < 0.65:
                    cut = cut.rstrip("，,。.；; ") + rng.choice(TAILS_ZH if han else TAILS_EN)
                elif not han and rng.random() < 0.5:
                    cut = cut.rsplit(" ", 1)[0] if " " in cut else cut
                cut = cut.rstrip("。.") if not cut.endswith("...") else cut
                if cut and not re.search(r"[。！!？?]$", cut) and cut != base.rstrip("。."):
                    out.append(((q, cut, True), 1))
        if rng.random() < 0.8:
            name = next(iter(re.findall(r"[A-Z][a-z]+", q)), "it")
            text = rng.choice(REFUSALS_ZH if _HAN.search(q) else REFUSALS_EN).format(name)
            if rng.random() < 0.25:
                more = rng.choice(zh if _HAN.search(q) and zh else en or good)[1]
                text = text + ("" if _HAN.search(text) else " ") + more
            out.append(((q, text, True), 2))
        if rng.random() < 0.8:
            text = rng.choice(LEADS_COPY) + q
            if rng.random() < 0.15:
                text = f"{q} {q}"
            if rng.random() < 0.7:
                text = re.sub(r"[？?]\s*$", rng.choice(["", "", "", "?", "？", "。", ".", "!"]), text)
            if rng.random() < 0.2:
                text = text.replace(" ", "") if _HAN.search(q) else text.lower()
            out.append(((q, text, rng.random() < 0.75), 3))
        if not asks.search(q):
            other = en if _HAN.search(q) else zh
            if other and rng.random() < 0.5:
                out.append(((q, rng.choice(other)[1], True), 4))
            if rng.random() < 0.6:
                out.append(((q, rng.choice(FOREIGN).format(rng.randint(2, 90)), True), 4))
    return out


def _sound(pairs: list[tuple], rng: random.Random) -> list[tuple]:
    """Further sound pairs: no full stop, the question first, a further sentence."""
    out = []
    good = [p for p in pairs if p[1] and _VISIBLE.search(p[1]) and p[2] is not False]
    for q, a, can in good:
        han = bool(_HAN.search(a))
        if rng.random() < 0.3:
            out.append((q, a.rstrip().rstrip("。."), can))
        if rng.random() < 0.25:
            out.append((q, re.sub(r"[？?]\s*$", "：" if han else ": ", q) + a, can))
        if rng.random() < 0.3:
            more = rng.choice(good)[1]
            if bool(_HAN.search(more)) == han and more.rstrip().endswith(("。", ".")):
                out.append((q, a.rstrip().rstrip("。.") + ("。" if han else ". ") + more, can))
        if rng.random() < 0.35:
            short = rng.choice(SHORT_ZH if _HAN.search(q) else SHORT_EN).format(rng.randint(2, 90))
            out.append((q, short + rng.choice(["", "", "。" if _HAN.search(q) else "."]), True))
        if can and rng.random() < 0.1:
            out.append((q, None, False))
            out.append((q, rng.choice(["资料中没有相关说明。", "没有找到有关内容，无法回答。"] if _HAN.search(q) else ["The files say nothing about this.", "There is no record of it, so it cannot be answered."]), False))
    return out


class PairModel:
    """Five logistic models over one hashed feature space, and their thresholds."""

    def __init__(self):
        self.w = np.zeros((len(LABELS), 1 << BITS), np.float32)
        self.cut = np.full(len(LABELS), 0.5)

    @staticmethod
    def matrix(pairs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, cells, values = [], [], []
        for i, p in enumerate(pairs):
            c, v = pair_features(*p)
            rows += [i] * len(c)
            cells += c
            values += v
        return np.array(rows), np.array(cells), np.array(values, np.float32)

    def score(self, pairs: list[tuple]) -> np.ndarray:
        rows, cells, values = self.matrix(pairs)
        s = np.stack([np.bincount(rows, weights=w[cells] * values, minlength=len(pairs)) for w in self.w], axis=1)
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))

    def fit(self, pairs: list[tuple], y: np.ndarray, rng: np.random.Generator) -> PairModel:
        rows, cells, values = self.matrix(pairs)
        start = np.searchsorted(rows, np.arange(len(pairs) + 1))
        squares = np.full_like(self.w, 1e-4)
        for _ in range(EPOCHS):
            order = rng.permutation(len(pairs))
            for k in range(0, len(order), 64):
                take = order[k : k + 64]
                at = np.concatenate([np.arange(start[i], start[i + 1]) for i in take])
                local = np.repeat(np.arange(len(take)), start[take + 1] - start[take])
                c, v = cells[at], values[at]
                unique, inverse = np.unique(c, return_inverse=True)
                for label in range(len(LABELS)):
                    w = self.w[label]
                    s = np.bincount(local, weights=w[c] * v, minlength=len(take))
                    err = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[take, label]
                    g = np.bincount(inverse, weights=err[local] * v, minlength=len(unique)).astype(np.float32)
                    squares[label, unique] += g * g
                    w[unique] -= 0.15 * g / np.sqrt(squares[label, unique])
        return self

    def calibrate(self, pairs: list[tuple], y: np.ndarray) -> PairModel:
        """For each label the threshold with the best F1 on held-out pairs; the middle of the best run."""
        p = self.score(pairs)
        grid = np.linspace(0.2, 0.9, 29)
        for label in range(len(LABELS)):
            f = []
            for cut in grid:
                hit = p[:, label] >= cut
                true = (hit & (y[:, label] > 0)).sum()
                f.append(2 * true / max(1, hit.sum() + (y[:, label] > 0).sum()))
            best = np.flatnonzero(np.array(f) >= max(f) - 1e-9)
            self.cut[label] = grid[best[len(best) // 2]]
        return self

    def save(self, path: Path = MODEL) -> None:
        cells = np.flatnonzero(np.abs(self.w).max(0) > 0.01)
        np.savez_compressed(path, cells=cells.astype(np.int32), w=self.w[:, cells].astype(np.float16), cut=self.cut)

    @classmethod
    def load(cls, path: Path | None = None) -> PairModel:
        """The fitted model beside this module, also where the package is read from an archive."""
        held = path.read_bytes() if path else (files(__package__) / MODEL.name).read_bytes()
        model = cls()
        with np.load(io.BytesIO(held)) as z:
            model.w[:, z["cells"]] = z["w"]
            model.cut = z["cut"]
        return model

    def figures(self, pairs: list[tuple], y: np.ndarray) -> dict[str, float]:
        """F1 of each label."""
        p = self.score(pairs) >= self.cut
        return {name: round(float(2 * (p[:, k] & (y[:, k] > 0)).sum() / max(1, p[:, k].sum() + (y[:, k] > 0).sum())), 4) for k, name in enumerate(LABELS)}

    def decide(self, pairs: list[tuple]) -> list[str | None]:
        """The label furthest over its threshold, if any is."""
        if not pairs:
            return []
        over = self.score(pairs) - self.cut
        return [LABELS[k] if over[i, k] >= 0 else None for i, k in enumerate(over.argmax(1))]


def _training(sound: list[tuple], rng: random.Random) -> tuple[list[tuple], np.ndarray]:
    """Sound and made pairs with their labels; small tables are gone over several times."""
    x, y = list(sound), [-1] * len(sound)
    for _ in range(max(1, FIT_PAIRS // max(1, len(sound)))):
        for p, label in [(p, -1) for p in _sound(sound, rng)] + _made(sound, rng):
            x.append(p)
            y.append(label)
    return x, (np.array(y)[:, None] == np.arange(len(LABELS))).astype(np.float32)


def fit_pairs(pairs: list[tuple], seed: int = 5) -> PairModel:
    """Score each fold of the pairs by a fit to the others, drop what looks defective, fit to the rest.

    Responses of one shape are in one fold, so a defect that recurs isn't learned as sound; answers to
    answerable and to unanswerable questions are shapes of their own. A shape that makes up COMMON of
    all pairs is judged as one: it stays or goes as most of its pairs do.
    """
    rng, nrng = random.Random(seed), np.random.default_rng(seed)
    pairs = [p for p in pairs if p[0]]
    rng.shuffle(pairs)
    shapes = [(_shape(p[1] or ""), p[2] is not False) for p in pairs]
    often = {s for s, n in Counter(shapes).items() if n >= max(COMMON * len(pairs), 4)}
    fold = [zlib.crc32(repr(s).encode()) % FOLDS for s in shapes]
    sound = []
    for k in range(FOLDS):
        test = [(p, s) for p, f, s in zip(pairs, fold, shapes) if f == k]
        train = [p for p, f in zip(pairs, fold) if f != k]
        if test and train:
            bad = (PairModel().fit(*_training(train, rng), nrng).score([p for p, _ in test]) >= 0.5).any(1)
            votes = Counter()
            for (_, s), b in zip(test, bad):
                votes[s] += 1 if b else -1
            sound += [p for (p, s), b in zip(test, bad) if not (votes[s] > 0 if s in often else b)]
    sound = sound or pairs
    # Pairs of one question are on one side, and what is made from a pair is on its side.
    apart = [zlib.crc32(repr(p[0]).encode()) % 1000 < 1000 * HELD for p in sound]
    model = PairModel().fit(*_training([p for p, h in zip(sound, apart) if not h] or sound, rng), nrng)
    held = [p for p, h in zip(sound, apart) if h]
    return model.calibrate(*_training(held, rng)) if held else model


@functools.cache
def _model() -> PairModel:
    return PairModel.load()


def broken_pairs(golden: DataFrame, id_col: str = "id", question: str = "question", answer: str = "reference_answer", answerable: str = "answerable", fit: bool = False) -> DataFrame:
    """``(id, defect)`` of each defective pair. A null ``answerable`` counts as true; a null question
    is an empty one. Repeated pairs are judged each; an empty table has no defects. With ``fit`` the model
    is fitted to at most MAX_FIT of the table's own pairs first."""
    rows = golden.select(F.col(id_col).cast("string").alias("id"), F.col(question).alias("q"), F.col(answer).alias("a"), F.col(answerable).alias("can"))
    sent = None
    if fit:
        sample = rows.filter("q is not null").orderBy(F.xxhash64("id"), "id").limit(MAX_FIT).select("q", "a", "can").collect()
        sent = golden.sparkSession.sparkContext.broadcast(fit_pairs([(r.q, r.a, r.can) for r in sample]) if sample else PairModel())

    def judge(c):
        model = _model() if sent is None else sent.value
        return {"id": c["id"], "defect": model.decide(list(zip(c["q"], c["a"], c["can"])))}

    return arrow_map(spread(rows), judge, "id string, defect string").filter("defect is not null")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(table(spark, sf_dir, "golden_set"))


QUERIES = {"p5_found": p5_found}


def main(folder: str) -> None:
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{folder}/golden_set.parquet", columns=["id", "question", "reference_answer", "answerable"]).to_pylist()
    rows = sorted((r for r in rows if r["question"]), key=lambda r: zlib.crc32(r["id"].encode()))[: 2 * MAX_FIT]
    pairs = [(r["question"], r["reference_answer"], r["answerable"]) for r in rows]
    model = fit_pairs(pairs)
    model.save()
    print(model.cut)


if __name__ == "__main__":
    main(sys.argv[1])
