"""Problem 1: noise in text from scanned pages.

Method: a vocabulary of words, word pairs and Chinese bigrams and trigrams is counted over all pages and
kept as a trie. Candidates for a suspicious unit come from intersecting the trie with a weighted
Levenshtein automaton: any insertion, deletion, replacement and swap, with misreadings of the table as
cheaper edits, and all entries within the cost are met. They are ranked by frequency, by the words or
characters around, and by cost. Then page numbers and running titles are removed, and lines are joined
into paragraphs, words broken over lines and pages too.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.runtime import arrow_map, built, spread, table, written

MIN_COUNT = 3  # what occurs less often may be a misreading itself
MAX_SENT = 500_000  # entries of the vocabulary sent to every executor, the most frequent; the rest comes with the pages that need it
TITLE_PAGES = 3
RATIO = 8  # how many times more often than what was read the candidate must occur
LONG_WORD = 8  # letters from which two free edits are undone
FREE_COUNT = 10  # occurrences of a word that a free edit may lead to
FREE_HAN = 5  # the same of a Chinese window
COST_WEIGHT = 1.5  # what a misreading more weighs against a word's frequency, in logarithms
HAN_NUMERALS = set("零〇一二三四五六七八九十百千万亿两")

# Misread -> meant.
LATIN = {
    "1": ("l", "i"), "0": ("o", "O"), "c": ("e",), "l": ("i", "I"), "rn": ("m",), "ii": ("u",), "li": ("h",), "vv": ("w",), "cl": ("d",),
    "O": ("0",), "I": ("l",), "Q": ("O",), "m": ("rn",), "5": ("s",), "8": ("B",),
}
HAN = {
    "冋": "同", "淸": "清", "宙": "审", "夭": "天", "尸": "户", "酋": "首", "己": "已", "曰": "日", "十": "千", "宇": "字",
    "冂": "门", "エ": "工", "扳": "报", "怍": "作", "埋": "理", "人": "入", "反": "及", "帐": "账", "末": "未", "士": "土",
    "侍": "待", "巳": "已", "干": "千", "千": "干", "大": "太", "目": "日", "白": "自", "日": "曰", "土": "士", "未": "末",
    "入": "人", "力": "刀", "间": "问", "问": "间", "贝": "见", "见": "贝", "申": "甲", "甲": "申", "住": "往", "往": "住", "情": "清",
    "密": "审", "审": "宙", "二": "工", "口": "日", "门": "冂", "卜": "上", "卞": "下", "丄": "上", "丅": "下", "牛": "生", "主": "王", "心": "必",
}
HYPHENS = "-­‐¬"
LABEL = re.compile(r"(?:合计|总计|小计|共计|[Tt][o0]ta[l1I]|[Ss]ubt[o0]ta[l1I]|Sum)")
_N = r"(?:[0-9OoQlI|]{1,5}|[零〇一二三四五六七八九十百千]{1,5})"
_NUMBER_LINE = re.compile(
    rf"\s*(?:[-–—~·\[(（【<]+\s*{_N}\s*[-–—~·\])）】>]+|{_N}\s*/\s*{_N}|第\s*{_N}\s*[页贞](?:\s*[,，/]?\s*共\s*{_N}\s*[页贞])?"
    rf"|[Pp]ag[ec]\s*{_N}(?:\s*of\s*{_N})?|[Pp]\.?\s*{_N}(?:\s*/\s*{_N})?)\s*")
_MARKED_LINE = re.compile(
    rf"\s*(?:[-–—~·]+\s*{_N}\s*[-–—~·]+|第\s*{_N}\s*[页贞](?:\s*[,，/]?\s*共\s*{_N}\s*[页贞])?|[Pp]ag[ec]\s*{_N}(?:\s*of\s*{_N})?)\s*")
_BARE = re.compile(r"\s*(?=[0-9OoQlI]*[0-9])[0-9OoQlI]{1,4}\s*")
_ROMAN = re.compile(r"\s*(?=[ivxlc])(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})\s*")
_HAN = re.compile(r"[㐀-鿿]")
_WORD = re.compile(r"[A-Za-z0-9]+")
FOLDED = (("m", "rn"), ("d", "cl"), ("w", "vv"), ("u", "ii"), ("h", "li"))
_HAN_RUN = re.compile(r"[㐀-鿿エ]{2,}")
_COUNTER = re.compile(r"(?<![A-Za-z])[0-9OoQlI]*[0-9][0-9OoQlI]*(?![A-Za-z])")
_END = "。．.！？!?；;：:”’」』）)】"


@functools.lru_cache(maxsize=65536)
def fold(line: str) -> str:
    """A title line up to counters and misreadings."""
    s = _COUNTER.sub("#", unicodedata.normalize("NFKC", line))
    s = re.sub(r"[^\w#]|_", "", s).lower()
    for a, b in (("m", "rn"), ("w", "vv"), ("d", "cl"), ("e", "c"), ("i", "l"), ("1", "l"), ("u", "ll"), ("h", "ll"), ("0", "o"), ("q", "o")):
        s = s.replace(a, b)
    return "".join(HAN.get(c, c) if HAN.get(HAN.get(c, c), "") != c else min(c, HAN[c]) for c in s)


def page_numbers(lines: list[str]) -> set[int]:
    """Indexes of the lines that hold only a page number: a marked one anywhere, a fraction or bare number
    (elsewhere a table's cell) among the first and last two lines."""
    n, out = len(lines), set()
    near = {i for i in (0, 1, n - 2, n - 1) if 0 <= i < n}
    for i in range(n):
        line = lines[i]
        if i not in near:
            if len(line) < 40 and _MARKED_LINE.fullmatch(line):
                out.add(i)
            continue
        edge = i in (0, n - 1) or i == 1 and not _BARE.fullmatch(lines[0]) or i == n - 2 and not _BARE.fullmatch(lines[-1])
        if _NUMBER_LINE.fullmatch(line):
            out.add(i)
        elif _BARE.fullmatch(line) and edge:
            before = lines[i - 1] if i else ""
            cell = LABEL.fullmatch(before.strip()) or _BARE.fullmatch(before) and not (i >= 2 and LABEL.fullmatch(lines[i - 2].strip()))
            follows = i + 1 < n and i > 1 and _BARE.fullmatch(lines[i + 1])
            if not cell and not follows:
                out.add(i)
        elif _ROMAN.fullmatch(line) and line.strip():
            out.add(i)
    return out


def edges(lines: list[str], numbers: set[int]) -> tuple[int | None, int | None]:
    """The first and the last line that is no page number."""
    rest = [i for i in range(len(lines)) if i not in numbers and lines[i].strip()]
    return (rest[0], rest[-1]) if rest else (None, None)


def may_be_title(line: str) -> bool:
    s = line.strip()
    return len(s) >= 2 and s[-1] not in _END + ",，、" + HYPHENS and not re.search(r"[，。；;!?！？]|[.,]\s", s) and not _BARE.fullmatch(s) and not LABEL.fullmatch(s)


def body_lines(text: str, top: bool, bottom: bool) -> list[str]:
    """Lines without page furniture; ``top`` and ``bottom`` say whether the edge line is a title."""
    lines = text.split("\n")
    numbers = page_numbers(lines)
    first, last = edges(lines, numbers)
    drop = numbers | ({first} if top else set()) | ({last} if bottom else set())
    return [x for i, x in enumerate(lines) if i not in drop]


def is_han(text: str) -> bool:
    return len(_HAN.findall(text)) * 5 > len(text)


class Trie:
    """A trie kept as a sorted list: a node is the range of the words with one prefix, and its depth.
    A node's children come from bisection when first met, so that only what is visited takes room."""

    def __init__(self, words: Iterable[str]):
        self.held = frozenset(words)
        self.words = sorted(self.held)
        self.root = (0, len(self.words), 0)
        self.met: dict[tuple[int, int, int], dict] = {}

    def children(self, node: tuple[int, int, int]) -> dict[str, tuple[int, int, int]]:
        known = self.met.get(node)
        if known is not None:
            return known
        lo, hi, depth = node
        out = {}
        at = lo + self.ends(node)
        while at < hi:
            c = self.words[at][depth]
            to = bisect.bisect_left(self.words, self.words[at][:depth] + chr(ord(c) + 1), at, hi)
            out[c] = (at, to, depth + 1)
            at = to
        if len(self.met) >= 1_000_000:
            self.met.clear()
        self.met[node] = out
        return out

    def ends(self, node: tuple[int, int, int]) -> bool:
        """Whether a word ends at the node."""
        return node[0] < node[1] and len(self.words[node[0]]) == node[2]

    def under(self, prefix: str) -> tuple[int, int, int]:
        lo = bisect.bisect_left(self.words, prefix)
        return lo, bisect.bisect_left(self.words, prefix + "\U0010ffff", lo), len(prefix)


def edit_cost(word: str, read: str, other: int = 2) -> int:
    """The least cost of reading ``word`` as ``read``: 1 for a misreading of the table, ``other`` for any
    other character put in, left out or replaced and for two neighbours in the wrong order."""
    rows = [[other * j for j in range(len(read) + 1)]]
    for i, c in enumerate(word, 1):
        row = [other * i]
        for j, r in enumerate(read, 1):
            best = min(rows[i - 1][j - 1] + (0 if r == c else 1 if c in LATIN.get(r, ()) else other), rows[i - 1][j] + other, row[j - 1] + other)
            if j > 1 and c in LATIN.get(read[j - 2 : j], ()):
                best = min(best, rows[i - 1][j - 2] + 1)
            if i > 1 and word[i - 2 : i] in LATIN.get(r, ()):
                best = min(best, rows[i - 2][j - 1] + 1)
            if i > 1 and j > 1 and r == word[i - 2] and read[j - 2] == c:
                best = min(best, rows[i - 2][j - 2] + other)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def automaton(trie: Trie, read: str, budget: int, other: int = 2) -> list[str]:
    """Every word of the trie whose ``edit_cost`` to ``read`` is at most ``budget``.

    A state of the Levenshtein automaton (characters of ``read`` taken, cost so far) is carried along the
    trie's branches by matches, misreadings and free edits. Where one more free edit would use up the
    budget, what follows it must be the rest of ``read``, which one look at the words tells.
    """
    n = len(read)
    one = [LATIN.get(read[j], ()) for j in range(n)]
    two = [LATIN.get(read[j : j + 2], ()) for j in range(n - 1)] + [()]
    found: set[str] = set()
    least: dict[tuple, int] = {}
    stack = [(trie.root, 0, 0)]
    while stack:
        node, j, cost = stack.pop()
        if least.get((node, j), budget + 1) <= cost:
            continue
        least[node, j] = cost
        if j == n and trie.ends(node):
            found.add(trie.words[node[0]])
        kids = trie.children(node)
        if j < n:
            if (child := kids.get(read[j])) is not None:
                stack.append((child, j + 1, cost))
            if cost < budget:
                for meant, taken in ((one[j], 1), (two[j], 2)):
                    for m in meant:
                        child = kids.get(m[0])
                        if child is not None and len(m) == 2:
                            child = trie.children(child).get(m[1])
                        if child is not None:
                            stack.append((child, j + taken, cost + 1))
        left = budget - cost - other
        if left < 0:
            continue
        swapped = j + 1 < n and read[j] != read[j + 1]
        if left == 0:
            made, rest = trie.words[node[0]][: node[2]], read[j:]
            held = trie.held
            found.update([w for c in kids if (w := made + c + rest) in held])
            if j < n:
                shorter = rest[1:]
                found.update([w for c in kids if (w := made + c + shorter) in held])
                if made + shorter in held:
                    found.add(made + shorter)
                if swapped and (w := made + rest[1] + rest[0] + rest[2:]) in held:
                    found.add(w)
            continue
        v = cost + other
        stack += [(child, j, v) for child in kids.values()]
        if j < n:
            stack += [(child, j + 1, v) for child in kids.values()]
            stack.append((node, j + 1, v))
            if swapped and (child := kids.get(read[j + 1])) is not None and (child := trie.children(child).get(read[j])) is not None:
                stack.append((child, j + 2, v))
    return sorted(found)


class Vocabulary:
    """Counts of words (lower case, or as written if capitalised), of pairs of neighbouring words,
    hyphenated forms and Chinese characters, bigrams and trigrams, with tries for the automaton.

    ``parts`` are counts of the letter trigrams of capitalised words.
    """

    def __init__(self, counts: dict[str, int], parts: dict[str, int] | None = None):
        self.counts = counts
        self.missing: set[str] = set()
        self.words = Trie(u for u in counts if len(u) > 1 and u.isascii() and u.isalpha())
        han = [u for u in counts if len(u) > 1 and u[0] > "\u2e80"]
        self.forward, self.backward = Trie(han), Trie(u[::-1] for u in han)  # from the end for a first character in doubt
        self.met: dict[tuple[str, int], list[str]] = {}
        self.seen: dict[tuple[str, bool], list[tuple[str, int, int]]] = {}
        # Names are open-ended; of a name not in the vocabulary its letter trigrams can be.
        self.parts: Counter = Counter(parts or {})
        if parts is None:
            for unit, n in counts.items():
                if unit[0].isupper() and " " not in unit:
                    for x in letter_trigrams(unit):
                        self.parts[x] += n
        self.common_part = max(5, sum(self.parts.values()) / 50_000)
        single = {c: n for c, n in counts.items() if len(c) == 1}
        common = max(1, sum(single.values())) / 20_000
        self.rare = {c for c, n in single.items() if n < common}
        self.known_han = set(single)
        self.clear = clear_misreadings(counts)

    def count(self, unit: str) -> int:
        return self.counts.get(unit, 0)

    def nearby(self, key: str) -> list[str]:
        """The entries near ``key`` that aren't in the tries."""
        return []

    def within(self, read: str, budget: int, other: int = 2) -> list[str]:
        """Every entry, those that came with the pages too, whose cost to be read so is in the budget."""
        more = [u for u in self.nearby(read) if u not in self.counts and edit_cost(u, read, other) <= budget]
        return [u for u in automaton(self.words, read, budget, other) if u != read] + more

    def within_han(self, window: str, at: int) -> list[str]:
        """The other characters that make ``window`` an entry when put at ``at``."""
        known = self.met.get((window, at))
        if known is not None:
            return known
        if at == 0:
            out = [c for c, child in self.backward.children(self.backward.under(window[:0:-1])).items() if self.backward.ends(child)]
        else:
            rest = window[at + 1 :]
            out = [c for c, child in self.forward.children(self.forward.under(window[:at])).items() if (self.forward.ends(child) if not rest else window[:at] + c + rest in self.counts)]
        gap = f"{window[:at]}?{window[at + 1 :]}"
        more = [u[at] for u in self.nearby(gap) if u not in self.counts]
        out = [c for c in (sorted({*out, *more}) if more else out) if c != window[at]]
        if len(self.met) >= 200_000:
            self.met.clear()
        if gap not in self.missing:
            self.met[window, at] = out
        return out

    def candidates(self, key: str, free: bool) -> list[tuple[str, int, int]]:
        """``(entry, count, cost)`` of what may have been read as ``key``: by at most two misreadings of the
        table, or, if ``free``, by any edit too (two in words of LONG_WORD letters and more)."""
        known = self.seen.get((key, free))
        if known is None:
            other = 2 if free else 9
            budget = 4 if free and len(key) >= LONG_WORD else 2
            known = [(u, self.count(u), edit_cost(u, key, other)) for u in self.within(key, budget, other)]
            if len(self.seen) >= 500_000:
                self.seen.clear()
            if key not in self.missing:
                self.seen[key, free] = known
        return known

    def context(self, entry: str, before: str, after: str) -> int:
        """How often the entry stood beside its neighbours."""
        e = entry.lower()
        return (self.count(f"{before.lower()} {e}") if before else 0) + (self.count(f"{e} {after.lower()}") if after else 0)

    def ranked(self, found: list[tuple[str, int, int]], before: str, after: str) -> list[tuple[float, str, int, int, int]]:
        """Best first: often, and beside these neighbours, and by few and likely misreadings."""
        rows = []
        for u, n, cost in found:
            near = self.context(u, before, after)
            rows.append((math.log(n) + 2 * math.log1p(near) - COST_WEIGHT * (cost - 1), u, n, cost, near))
        return sorted(rows, reverse=True)

    def word(self, w: str, before: str = "", after: str = "") -> str | None:
        """The word that was misread as ``w`` between its neighbours, or null."""
        key = w if w[0].isupper() and not w.isupper() else w.lower()
        own = self.count(key)
        best = None
        for _, u, n, *_ in self.ranked([x for x in self.candidates(key, False) if x[1] >= RATIO * max(own, 0.5)], before, after)[:1]:
            best = u
        # A capital within a sentence makes a name.
        if best is None and not own and w.isalpha() and len(w) >= 4 and not (w[0].isupper() and (before and not w.isupper() or self.count(w.lower()))):
            best = self.freely(w, before, after)
        if best is not None and w[0].isupper():
            best = best.capitalize() if not w.isupper() else best.upper()
        if best is None and own == 0 and w[0].isupper() and not w.isupper() and not self.count(w.lower()):
            best = self.name(w)
        return best

    def freely(self, w: str, before: str, after: str) -> str | None:
        """The known word from which an unknown one comes by any edit, if its neighbours or its frequency
        and length speak for it and no other word is as likely."""
        rows = self.ranked([x for x in self.candidates(w.lower(), True) if x[0].islower() and x[1] >= FREE_COUNT], before, after)
        if not rows or len(rows) > 1 and rows[1][0] > rows[0][0] - 0.7:
            return None
        _, u, n, cost, near = rows[0]
        if w[0].isupper():
            return u if near >= 2 and len(w) >= 5 else None
        return u if near and n * min(near, 3) >= 3 * FREE_COUNT or len(w) >= 6 and n >= 5 * FREE_COUNT or len(w) >= LONG_WORD and n >= 2 * FREE_COUNT else None

    def least_part(self, w: str) -> int:
        return min(self.parts[x] for x in letter_trigrams(w))

    def name(self, w: str) -> str | None:
        """The name that was misread as ``w``: one or two misreadings undone so that an unknown letter
        trigram becomes one that is common in names. Null if ``w`` has none, or if several fit alike."""
        if len(w) < 4 or self.least_part(w) > self.common_part / 10:
            return None
        forms = {w}
        for _ in range(2):
            made = {f[:i] + meant + f[i + width :] for f in forms for i in range(len(f)) for width in (1, 2) for meant in LATIN.get(f[i : i + width], ()) if meant.islower() and (i or meant != "i")}
            good = sorted({(self.least_part(f), f) for f in made if f.isalpha() and self.least_part(f) >= self.common_part}, reverse=True)
            if good:
                return good[0][1] if len(good) == 1 or good[0][0] > 2 * good[1][0] else None
            forms = made
        return None

    def evidence(self, text: str, i: int, sizes: tuple[int, ...] = (3, 2)) -> tuple[int, dict[str, list[int]]]:
        """How often the windows of three around text[i] occur, at most, and for each other character the
        counts of the windows that it would make; other clear misreadings in a window are read as meant."""
        own, score = 0, {}
        for size in sizes:
            for a in range(max(0, i - size + 1), i + 1):
                w = text[a : a + size]
                if len(w) < size:
                    break
                at = i - a
                own = max(own, self.count(w) if size == 3 else 0)
                w = "".join(x if k == at else self.clear.get(x, x) for k, x in enumerate(w))
                for meant in self.within_han(w, at):
                    score.setdefault(meant, []).append(self.count(w[:at] + meant + w[at + 1 :]))
        return own, score

    def han(self, text: str, i: int) -> str | None:
        """The character that was misread at text[i], judged by the windows of two and three characters
        around it."""
        c = text[i]
        own, windows = self.evidence(text, i)
        score = Counter({m: max(ns) for m, ns in windows.items()})
        meant = HAN.get(c)
        if meant in score:
            n, m = self.count(c), self.count(meant)
            if score[meant] >= (3 if 4 * n < m else RATIO) * max(own, 1):
                return meant
        if c in self.rare or c not in self.known_han:
            for meant, n in score.most_common(1):
                if n >= RATIO * max(own, 1) and self.count(meant) >= 20 * self.count(c):
                    return meant
        return None

    def unseen(self, text: str) -> list[int]:
        """Places in Chinese runs all of whose windows of three are unknown."""
        out = []
        for m in _HAN_RUN.finditer(text):
            run, a = m.group(), m.start()
            if len(run) < 4:
                continue
            known = [self.count(run[k : k + 3]) > 0 for k in range(len(run) - 2)]
            if all(known):
                continue
            out += [a + k for k in range(len(run)) if not any(known[max(0, k - 2) : k + 1])]
        return out

    def han_freely(self, text: str, i: int) -> str | None:
        """Any character that was misread at text[i], where no window of three around it is known: the one
        that makes at least two of the windows common, and that no other comes near."""
        if text[i] in HAN_NUMERALS:
            return None
        own, windows = self.evidence(text, i, (3,))
        rows = sorted(((len(ns), sum(ns), m) for m, ns in windows.items() if len(ns) >= 2 and min(ns) >= FREE_HAN and m not in HAN_NUMERALS), reverse=True)
        if own or not rows or len(rows) > 1 and (rows[1][0] == rows[0][0] and 4 * rows[1][1] > rows[0][1]):
            return None
        return rows[0][2]

    @functools.cached_property
    def suspects(self) -> re.Pattern:
        chars = "".join(sorted(set(HAN) | self.rare))
        return re.compile(f"[{re.escape(chars)}]")


class PagedVocabulary(Vocabulary):
    """A vocabulary of which what a page needs beyond the broadcast entries comes with the page (``learn``):
    ``asked`` are the units that it came for, ``missing`` those looked up besides, without which the page isn't done."""

    def __init__(self, counts: dict[str, int], parts: dict[str, int] | None = None):
        super().__init__(counts, parts)
        self.extra: dict[str, int] = {}  # counts of entries met with the pages
        self.near: dict[str, list[str]] = {}  # of those the ones near a word, and the characters that fill a window's gap
        self.asked: set[str] = set()

    def learn(self, entries: list | None, asked: set[str]) -> None:
        """Take in ``(unit, n, near)`` of a page, all that is known of the units ``asked``: a unit's count, and
        entries near it with theirs."""
        self.asked, self.missing = asked, set()
        if len(self.extra) + len(self.near) > 500_000:
            self.extra.clear()
            self.near.clear()
            self.met.clear()
            self.seen.clear()
        for unit, n, near in ((e["unit"], e["n"], e["near"]) for e in entries or ()):
            if n:
                self.extra[unit] = n
            if near:
                self.near[unit] = [x["unit"] for x in near]
                self.extra.update((x["unit"], x["n"]) for x in near)

    def count(self, unit: str) -> int:
        n = self.counts.get(unit) or self.extra.get(unit, 0)
        if not n and unit not in self.asked:
            self.missing.add(unit)
        return n

    def nearby(self, key: str) -> list[str]:
        """Of the entries not sent to all those near ``key``. A word that was sent is more frequent than all of
        them, so that none can stand for it."""
        found = self.near.get(key)
        if found is None and key not in self.counts and key not in self.asked:
            self.missing.add(key)
        return found or []


def clear_misreadings(counts: dict[str, int]) -> dict[str, str]:
    """Characters that stand for others far more often than for themselves."""
    return {c: m for c, m in HAN.items() if 4 * counts.get(c, 0) < counts.get(m, 0)}


def letter_trigrams(w: str) -> list[str]:
    s = f"^{w.lower()}$"
    return [s[i : i + 3] for i in range(len(s) - 2)]


_DIGITS = re.compile(r"(?=.*[0-9])[0-9OoQIl]+")
_CODE_TAIL = re.compile(r"[A-Z]{1,4}")


def misread_word(w: str, vocab: Vocabulary, before: str = "", after: str = "") -> str | None:
    """The right form of a misread run of letters and digits between its neighbours, or null if nothing
    is wrong. Numbers are an open class: their trie is a loop over the digits, in which a misread letter
    has a single branch."""
    if w.isdigit():
        return None
    if _DIGITS.fullmatch(w):
        return w.translate(str.maketrans("OoQIl", "00011"))
    has_digit = any(c.isdigit() for c in w)
    if has_digit:
        letters = sum(c.islower() for c in w)
        if letters >= 2 and all(c.isalpha() or c in "015" for c in w) and re.search(r"[A-Za-z][015]+[a-z]|[a-z][015]+$|^[015]+[a-z]{2}", w) and not re.fullmatch(r"[a-z]{1,2}\d+", w):
            return vocab.word(w, before, after) or re.sub("5", "s", w.replace("1", "l").replace("0", "o"))
        if re.fullmatch(r"[A-Z]+[015][A-Z]+|[A-Z]{3,}[015]|[015][A-Z]{3,}", w) and len(w) >= 5:
            best = vocab.ranked([x for x in vocab.candidates(w.lower(), False) if x[0].islower()], before, after)
            return best[0][1].upper() if best else None
        return None
    if len(w) < 2 or w.isupper() and (len(w) < 5 or vocab.count(w.lower()) or vocab.count(w.capitalize())):
        return None
    known = vocab.count(w if w[0].isupper() and not w.isupper() else w.lower())
    if known and not re.search(r"c|l|m|rn|ii|vv", w):
        return None
    return vocab.word(w, before, after)


def join_lines(lines: list[str], vocab: Vocabulary, head: str | None, tail: str | None) -> tuple[list[str], bool]:
    """Paragraphs of a page's body and whether a word of it is broken with a mark. ``head`` is the
    next page's first word, ``tail`` the previous page's last one if it ends with a mark."""
    lines = [x.rstrip() for x in lines]
    while lines and not lines[-1]:
        lines.pop()
    han = is_han("".join(lines))
    width = max(map(len, lines), default=0)
    hyphen, paragraphs, current = False, [], ""
    if tail and lines and not han and broken(tail, first_word(lines[0]), vocab):
        lines[0] = lines[0].lstrip()[len(first_word(lines[0])) :].lstrip()
    for k, line in enumerate(lines):
        s = line.strip()
        following = lines[k + 1].strip() if k + 1 < len(lines) else None
        alone = not s or _BARE.fullmatch(s) is not None and not (han and current and current[-1].isalnum() and k and len(lines[k - 1]) >= width - 2)
        if alone:
            if current:
                paragraphs.append(current)
            if s:
                paragraphs.append(s)
            current = ""
            continue
        glue = " " if current and not current.endswith("\1") else ""
        if current and (han or _HAN.match(s) and _HAN.match(current[-1])):
            glue = ""
        current = current.rstrip("\1") + glue + s
        start = first_word(following) if following is not None else head or ""
        if current[-1] in HYPHENS:
            last = re.search(r"[A-Za-z]+.?$", current)
            if last and current[-1] == "-" and han and re.fullmatch(r"[A-Z]{1,4}-", last.group()):
                current += "\1"
            elif last and broken(last.group(), start, vocab, following is None):
                hyphen = True
                current = current[:-1] + ("\1" if following is not None else start)
            elif current[-1] == "-" and (start[:1].isdigit() or last and vocab.count(f"{last.group().lower()}{start.lower()}")):
                current += "\1"
        elif following is not None and s[-1] in _END and len(line) < 0.7 * width:
            paragraphs.append(current)
            current = ""
    if current:
        paragraphs.append(current.rstrip("\1"))
    return paragraphs, hyphen


def first_word(line: str | None) -> str:
    m = re.match(r"\s*([A-Za-z0-9]+)", line or "")
    return m.group(1) if m else ""


def broken(part: str, rest: str, vocab: Vocabulary, open_end: bool = False) -> bool:
    """Whether ``part``, which ends with a mark, is the first part of a word that ``rest`` goes on."""
    stem = part[:-1]
    if not stem:
        return False
    if part[-1] != "-":
        return rest[:1].islower() or not rest and open_end
    if rest and not rest[0].islower():
        return False
    if stem.isupper() and len(stem) > 1:
        return False
    suspended = vocab.count(stem.lower() + "-")
    if not rest:
        return open_end and not suspended
    whole = (stem + rest).lower()
    if rest in ("and", "or", "to") and (suspended or not vocab.count(whole)):
        return False
    joined = max(vocab.count(whole), vocab.count(stem + rest))
    hyphened = vocab.count(f"{stem}-{rest}".lower())
    if joined or hyphened:
        return joined >= hyphened
    fixed = vocab.word(whole)
    return fixed is not None or not suspended


def repair(text: str | None, top: bool, bottom: bool, head: str | None, tail: str | None, vocab: Vocabulary) -> tuple[list[str], str]:
    """Kinds of damage, and the body as paragraphs. Null and empty texts have neither."""
    if not text:
        return [], ""
    lines = text.split("\n")
    damage = []
    paragraphs, hyphen = join_lines(body_lines(text, top, bottom), vocab, head, tail)
    if hyphen:
        damage.append("hyphen")
    if top or bottom:
        damage.append("header")
    if page_numbers(lines):
        damage.append("page_number")
    wrong = False
    out = []
    for k, p in enumerate(paragraphs):
        fixed, at = [], 0
        words = list(_WORD.finditer(p))
        for j, m in enumerate(words):
            # A word that goes on over the border of a Chinese page has no mark and may be a part of one.
            if m.group().isalpha() and (k == 0 and m.start() == 0 and m.group()[0].islower() or k == len(paragraphs) - 1 and m.end() == len(p)) and _HAN.search(p):
                continue
            before = words[j - 1].group() if j and p[words[j - 1].end() : m.start()] == " " else ""
            after = words[j + 1].group() if j + 1 < len(words) and p[m.end() : words[j + 1].start()] == " " else ""
            right = misread_word(m.group(), vocab, before, after)
            if right is not None and right != m.group():
                wrong = True
                fixed += (p[at : m.start()], right)
                at = m.end()
        p = "".join(fixed) + p[at:]
        if _HAN.search(p):
            chars = None
            for places, judge in ((lambda t: (m.start() for m in vocab.suspects.finditer(t)), vocab.han), (vocab.unseen, vocab.han_freely)):
                for i in places(p):
                    right = judge(p if chars is None else "".join(chars), i)
                    if right:
                        wrong = True
                        chars = chars or list(p)
                        chars[i] = right
                if chars:
                    p = "".join(chars)
        out.append(p)
    if wrong:
        damage.append("glyph")
    return damage, "\n\n".join(out)


def _units(text: str, counter: Counter) -> None:
    """Count a page's units. Edge lines are in; a title is one unit among thousands."""
    lines = text.split("\n")
    numbers = page_numbers(lines)
    kept = [x for i, x in enumerate(lines) if i not in numbers]
    if is_han(text):
        joined = "".join(kept)
        for run in _HAN_RUN.findall(joined):
            counter.update(run[i : i + 3] for i in range(len(run) - 2))
            counter.update(run[i : i + 2] for i in range(len(run) - 1))
        counter.update(c for c in joined if "㐀" <= c <= "鿿" or c == "エ")
        counter.update(w for w in _WORD.findall(joined) if len(w) > 1 and w.isalpha() and not w.isupper())
        return
    for line in kept:
        words = line.split()
        last = ""
        for k, w in enumerate(words):
            if k == len(words) - 1 and w[-1] in HYPHENS or k == 0:
                last = w.lower() if k == 0 and w.isalpha() else ""
                continue
            bare = w.strip(".,;:!?()\"'")
            if len(bare) > 1 and bare.replace("-", "").isalpha() and not bare.isupper():
                counter[bare if bare[0].isupper() else bare.lower()] += 1
            if bare.isalpha() and last:
                counter[f"{last} {bare.lower()}"] += 1
            last = w.lower() if w.isalpha() else ""
        if words and words[0].isalpha() and len(words[0]) > 1:
            counter[words[0] if words[0][0].isupper() else words[0].lower()] += 1


def count_units(pages: DataFrame) -> DataFrame:
    """``(unit, n)`` of all pages, counted batch by batch before the shuffle."""

    def count(c):
        counter: Counter = Counter()
        for t in c["text"]:
            if t:
                _units(t, counter)
        return {"unit": list(counter), "n": list(counter.values())}

    return arrow_map(pages.select("text"), count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def name_parts(units: DataFrame) -> dict[str, int]:
    """How often each letter trigram stands in capitalised words; at most as many as there are trigrams of letters."""
    capital = units.filter(F.col("unit").rlike("^[A-Z][A-Za-z]+$") & (F.col("n") >= MIN_COUNT)).select(F.concat(F.lit("^"), F.lower("unit"), F.lit("$")).alias("w"), "n")
    each = capital.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring("w", i, F.lit(3)))).alias("part"), "n")
    return {r.part: r.n for r in each.groupBy("part").agg(F.sum("n").alias("n")).toLocalIterator()}


def split_units(units: DataFrame, most: int) -> tuple[dict[str, int], DataFrame | None]:
    """The at most ``most`` most frequent entries of the vocabulary (single characters always), and the
    other entries, which stay distributed; null if there are none."""
    kept = units.filter(F.col("n") >= MIN_COUNT)
    by_count = sorted(((r.k, r.c) for r in kept.groupBy(F.least("n", F.lit(10_000)).alias("k")).agg(F.count("*").alias("c")).toLocalIterator()), reverse=True)
    cut, held = MIN_COUNT, 0
    for k, c in by_count:
        held += c
        if held > most:
            cut = k + 1
            break
    sent = (F.col("n") >= cut) | (F.length("unit") == 1)
    return {r.unit: r.n for r in kept.filter(sent).toLocalIterator()}, None if cut == MIN_COUNT else kept.filter(~sent)


@functools.cache
def skeleton() -> dict[int, str]:
    """Of each small letter and digit what it and all that it is misread as or for have in common."""
    same = {c: c for c in "abcdefghijklmnopqrstuvwxyz0123456789"}
    for read, meant in LATIN.items():
        for m in meant:
            if len(read) == len(m) == 1:
                a, b = same[read.lower()], same[m.lower()]
                same = {c: min(a, b) if x in (a, b) else x for c, x in same.items()}
    wide = dict(FOLDED)
    return {ord(c): "".join(same[x] for x in wide.get(c, c)) for c in same}


def deletions(w: str, two: bool = False) -> set[str]:
    """Keys shared by any two words of which one is read as the other by misreadings and one free edit, or
    ``two``: each of these edits leaves out at most one letter on either side, and the rest has one skeleton."""
    rest = {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}
    if two:
        rest |= {x[:i] + x[i + 1 :] for x in rest if len(x) < len(w) for i in range(len(x))}
    return {x.translate(skeleton()) for x in rest}


def gaps(window: str) -> list[str]:
    return [f"{window[:i]}?{window[i + 1 :]}" for i in range(len(window))]


def wanted(text: str | None, counts: dict[str, int]) -> set[str]:
    """The units of a page, as far as its text tells them, that aren't among the entries sent to all."""
    units: set[str] = set()
    lines = (text or "").split("\n")
    words = [w.group() for w in _WORD.finditer(text or "") if len(w.group()) > 1 and not w.group().isdigit()]
    units.update(words)
    units.update(w.lower() for w in words)
    words = [w.group() for w in _WORD.finditer(text or "")]
    units.update(f"{a} {b}".lower() for a, b in zip(words, words[1:]))
    units.update(w.lower() for w in re.findall(r"[A-Za-z]+-[A-Za-z]+", text or ""))
    for line, following in zip(lines, [*lines[1:], ""]):
        if (line := line.rstrip()) and line[-1] in HYPHENS and (last := re.search(r"[A-Za-z]+.?$", line)):
            stem, rest = last.group()[:-1], first_word(following)
            units.update((f"{stem}-".lower(), f"{stem}{rest}".lower(), stem + rest, f"{stem}-{rest}".lower()))
    for run in _HAN_RUN.findall("".join(lines)):
        for n in (3, 2):
            for w in {run[i : i + n] for i in range(len(run) - n + 1)}:
                # Its other characters may have been put right before.
                forms = {w, *map("".join, itertools.product(*({c, HAN.get(c, c)} for c in w)))}
                units.update(forms)
                units.update(g for f in forms for g in gaps(f))
    return {u for u in units if u not in counts}


def page_entries(pages: DataFrame, core: Broadcast, rest: DataFrame) -> DataFrame:
    """``(segment_id, entries)``: what a page must know beyond the entries sent to all. For each of its units
    that isn't among these, and of those ``more`` that it missed: its count, and the entries of ``rest`` near it.

    Words meet by their skeletons with letters left out, Chinese windows by the window with a gap, so that no group
    is larger than the words near a key, or the characters that fill a gap."""
    def asking(c):
        out = {"segment_id": [], "unit": []}
        for sid, t, more in zip(c["segment_id"], c["text"], c["more"]):
            units = wanted(t, core.value[0]) | set(more)
            out["segment_id"] += [sid] * len(units)
            out["unit"] += units
        return out

    asked = written(arrow_map(pages.select("segment_id", "text", "more"), asking, "segment_id long, unit string"), "p1-asked")

    def keyed(least):
        def keys(c):
            out = {"unit": [], "n": [], "key": []}
            for u, n in zip(c["unit"], c["n"]):
                for k in deletions(u.lower(), len(u) >= least) if u.isascii() else gaps(u):
                    for name, x in zip(out, (u, n, k)):
                        out[name].append(x)
            return out

        return keys

    form = "unit string, n long, key string"
    held = arrow_map(rest.filter(F.col("unit").rlike("^[A-Za-z]+$|^[㐀-鿿エ]{2,3}$")), keyed(LONG_WORD - 2), form).distinct()
    distinct = asked.select("unit").distinct()
    by_word = arrow_map(distinct.filter(F.col("unit").rlike("^[A-Za-z0-9]+$")).withColumn("n", F.lit(0).cast("long")), keyed(LONG_WORD), form).select(F.col("unit").alias("asked"), "key")
    by_gap = distinct.filter(F.contains("unit", F.lit("?"))).select(F.col("unit").alias("asked"), F.col("unit").alias("key"))
    near = by_word.unionByName(by_gap).join(held, "key").filter("asked != unit").select("asked", "unit", "n").distinct()
    near = near.groupBy("asked").agg(F.collect_list(F.struct("unit", "n")).alias("near"))
    known = distinct.join(rest, "unit", "left").join(near.withColumnRenamed("asked", "unit"), "unit", "left").filter("n is not null or near is not null")
    return asked.join(known, "unit").groupBy("segment_id").agg(F.collect_list(F.struct("unit", "n", "near")).alias("entries"))


def page_damage(segments: DataFrame, most: int = MAX_SENT) -> DataFrame:
    """``(segment_id, damage array<string>, body string)`` of each row with content_type page.

    Empty and null texts give no damage and an empty body. Of rows stored twice under one
    (document_id, seq) each is judged on its own; a title counts each seq once. ``most`` bounds the
    entries of the vocabulary that are sent to all executors, not the vocabulary: the others come with
    the pages that need them, and the results are the same.
    """
    pages = spread(segments.filter("content_type = 'page'").select("segment_id", "document_id", "seq", "text"))
    units = written(count_units(pages), "p1-units")
    counts, rest = split_units(units, most)
    sent = pages.sparkSession.sparkContext.broadcast((counts, name_parts(units)))

    def outline(c):
        keys = ("segment_id", "document_id", "seq", "top", "bottom", "head0", "head1", "tail0", "tail1")
        out = {k: [] for k in keys}
        for sid, doc, seq, text in zip(c["segment_id"], c["document_id"], c["seq"], c["text"]):
            lines = (text or "").split("\n")
            first, last = edges(lines, numbers := page_numbers(lines))
            body = [x for i, x in enumerate(lines) if i not in numbers and x.strip()]
            ends = [x.split()[-1] if x.strip() and x.strip()[-1] in HYPHENS else None for x in (body[-1:] + body[-2:-1] + ["", ""])[:2]]
            top = fold(lines[first]) if first is not None and may_be_title(lines[first]) else None
            bottom = fold(lines[last]) if last is not None and last != first and may_be_title(lines[last]) else None
            row = (sid, doc, seq, top or None, bottom or None, first_word((body + ["", ""])[0]), first_word((body + ["", ""])[1]), ends[0], ends[1])
            for k, v in zip(keys, row):
                out[k].append(v)
        return out

    small = written(arrow_map(pages, outline, "segment_id long, document_id string, seq int, top string, bottom string, head0 string, head1 string, tail0 string, tail1 string"), "p1-outline")
    keys = (small.select("document_id", "seq", F.explode(F.array("top", "bottom")).alias("key")).filter("key is not null")
            .groupBy("document_id", "key").agg(F.count_distinct("seq").alias("n")))
    keys = written(keys, "p1-keys")
    # Keys one misreading apart agree in their first or their second half.
    half = F.least(F.lit(4), (F.length("key") / 2).cast("int"))  # short keys have short halves
    halves = keys.filter(F.length("key") >= 2).select("document_id", "key", "n", F.explode(F.array(
        F.concat(F.lit("<"), F.left("key", half)), F.concat(F.lit(">"), F.right("key", half)))).alias("half"))
    a, b = halves.select("document_id", "half", "key", "n"), halves.select("document_id", "half", F.col("key").alias("other"), F.col("n").alias("m"))
    near = (a.join(b, ["document_id", "half"]).filter("key != other").filter(F.levenshtein("key", "other", 2) >= 0).filter((F.length("key") >= 4) | (F.length("key") == F.length("other")) & (F.levenshtein("key", "other") == 1))
            .select("document_id", "key", "other", "m").distinct().groupBy("document_id", "key").agg(F.sum("m").alias("more")))
    titles = keys.join(near, ["document_id", "key"], "left").filter(F.col("n") + F.coalesce("more", F.lit(0)) >= TITLE_PAGES).select("document_id", "key")
    hit = small.select("segment_id", "document_id", F.posexplode(F.array("top", "bottom")).alias("pos", "key")).filter("key is not null").join(titles, ["document_id", "key"])
    flags = hit.groupBy("segment_id").agg(F.max(F.col("pos") == 0).alias("is_top"), F.max(F.col("pos") == 1).alias("is_bottom"))
    known = small.join(flags, "segment_id", "left").select(
        "segment_id", "document_id", "seq", F.coalesce("is_top", F.lit(False)).alias("is_top"), F.coalesce("is_bottom", F.lit(False)).alias("is_bottom"),
        F.when(F.col("is_top"), F.col("head1")).otherwise(F.col("head0")).alias("head"), F.when(F.col("is_bottom"), F.col("tail1")).otherwise(F.col("tail0")).alias("tail"))
    known = written(known, "p1-known")
    heads = known.groupBy("document_id", (F.col("seq") - 1).alias("seq")).agg(F.min("head").alias("next_head"))
    tails = known.groupBy("document_id", (F.col("seq") + 1).alias("seq")).agg(F.min("tail").alias("prev_tail"))
    around = known.join(heads, ["document_id", "seq"], "left").join(tails, ["document_id", "seq"], "left").select("segment_id", "is_top", "is_bottom", "next_head", "prev_tail")
    more = rest is not None

    def mend(c):
        vocab = built(sent, lambda v: (PagedVocabulary if more else Vocabulary)(*v))
        out = {"segment_id": c["segment_id"], "damage": [], "body": []} | ({"missing": []} if more else {})
        for i, t in enumerate(c["text"]):
            if more:
                vocab.learn(c["entries"][i], wanted(t, vocab.counts) | set(c["more"][i]))
            damage, body = repair(t, c["is_top"][i], c["is_bottom"][i], c["next_head"][i], c["prev_tail"][i], vocab)
            out["damage"].append(damage)
            out["body"].append(body)
            if more:
                out["missing"].append(sorted(vocab.missing))
        return out

    form = "segment_id long, damage array<string>, body string"
    joined = pages.select("segment_id", "text").join(around, "segment_id")
    if not more:
        return arrow_map(joined, mend, form)
    # What a page looks up follows from what it found before (the neighbours of a candidate, the characters around one that
    # was put right), so pages are done anew with what they missed, until none misses anything.
    joined, results = joined.withColumn("more", F.array().cast("array<string>")), []
    while True:
        rows = joined.join(page_entries(joined, sent, rest), "segment_id", "left")
        done = written(arrow_map(rows, mend, f"{form}, missing array<string>"), "p1-mended")
        results.append(done.filter(F.size("missing") == 0).drop("missing"))
        left = done.filter(F.size("missing") > 0).select("segment_id", "missing")
        if left.isEmpty():
            return functools.reduce(DataFrame.unionByName, results)
        joined = written(joined.join(left, "segment_id").withColumn("more", F.array_union("more", "missing")).drop("missing"), "p1-left")


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage and repaired body of every page."""
    return page_damage(table(spark, sf_dir, "parsed_segments"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_repaired(spark, sf_dir).select("segment_id", F.explode("damage").alias("damage"))


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired}
