"""A character-level bidirectional LSTM with CRF transitions, in numpy: decoding and training."""

from __future__ import annotations

import functools
import io
import unicodedata
from importlib.resources import files
from pathlib import Path

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
HIDDEN = 24
WINDOW, MARGIN = 384, 48  # characters of a window, and how far neighbours overlap
MODEL = Path(__file__).with_name("p3_model.npz")
PAD, OTHER, HAN, LETTER = 0, 1, 2, 3


@functools.cache
def folding() -> np.ndarray:
    """Each code point below 0x10000 to the single character its compatibility form is, else itself."""
    out = np.arange(0x10000, dtype=np.uint32)
    for cp in (*range(0x2000, 0x2100), *range(0x3000, 0x3040), *range(0xFE30, 0x10000)):
        n = unicodedata.normalize("NFKC", chr(cp))
        if len(n) == 1:
            out[cp] = ord(n)
    out[0xA0] = 32
    return out


def folded_codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return folding()[np.minimum(codes, 0xFFFF)]


def folded(text: str) -> str:
    """The text in ordinary width, character by character, so that positions stay."""
    return folded_codes(text).tobytes().decode("utf-32-le", "surrogatepass")


def sigmoid_of_minus(z: np.ndarray) -> None:
    """1 / (1 + exp(z)) in place; numpy's exp takes half the time of its tanh."""
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1
    np.divide(np.float32(1), z, out=z)


class Tagger:
    """Gates are in the order input, forget, output, candidate; input weights are rows by character."""

    def __init__(self, alphabet: str, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.alphabet = alphabet
        v, h = 4 + len(alphabet), HIDDEN
        normal = lambda *s, k=0.3: (rng.normal(size=s) * k).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = normal(v, 4 * h)
            self.p[f"x{d}"][:, h : 2 * h] += 0.5
            self.p[f"h{d}"] = normal(h, 4 * h, k=0.2)
            self.p[f"e{d}"] = normal(h, TAGS, k=0.2)
        self.p["bias"] = np.zeros(TAGS, np.float32)
        self.p["trans"] = np.zeros((TAGS, TAGS), np.float32)

    def save(self, path: Path = MODEL) -> None:
        np.savez_compressed(path, alphabet=np.array([self.alphabet]), **{k: v.astype(np.float16) for k, v in self.p.items()})

    @classmethod
    def load(cls, path: Path | None = None) -> Tagger:
        """The trained model beside this module, also where the package is read from an archive."""
        held = path.read_bytes() if path else (files(__package__) / MODEL.name).read_bytes()
        with np.load(io.BytesIO(held)) as z:
            t = cls(str(z["alphabet"][0]))
            t.p = {k: z[k].astype(np.float32) for k in t.p}
        return t

    @functools.cached_property
    def ids(self) -> np.ndarray:
        out = np.full(0x10000, OTHER, np.int32)
        out[0x4E00:0xA000] = HAN
        for cp in (*range(0xC0, 0x250), *range(0x370, 0x530)):
            out[cp] = LETTER
        for i, c in enumerate(self.alphabet):
            out[ord(c)] = 4 + i
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.ids[folded_codes(text)]

    def emissions(self, windows: list[np.ndarray]) -> list[np.ndarray]:
        """Tag scores of each position of each window; all windows advance together, longest first,
        so that none is padded."""
        order = np.argsort([-len(w) for w in windows], kind="stable")
        lengths = np.array([len(windows[k]) for k in order])
        longest = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # windows longer than t
        at = np.zeros((longest, len(windows)), np.int32)
        back = np.zeros_like(at)
        for col, k in enumerate(order):
            w = windows[k]
            at[: len(w), col] = w
            back[: len(w), col] = w[::-1]
        # Gates lie one after the other, so that each is one stretch of memory. All are 1 / (1 + exp(-x)), with the signs
        # in the weights; tanh is twice that of twice its input, less 1. An exp too large gives the 0 that it should.
        sign = np.array([-1, -1, -1, -2], np.float32)[:, None, None]
        by_gate = lambda w: np.ascontiguousarray(w.reshape(len(w), 4, HIDDEN).transpose(1, 0, 2)) * sign
        out = []
        for ids, d in ((at, "f"), (back, "b")):
            wx, wh, we = by_gate(self.p[f"x{d}"]), by_gate(self.p[f"h{d}"]), self.p[f"e{d}"]
            h = np.zeros((len(windows), HIDDEN), np.float32)
            c = np.zeros_like(h)
            e = np.empty((longest, len(windows), TAGS), np.float32)
            room, more = (np.empty(4 * h.size, np.float32) for _ in range(2))
            for t in range(longest):
                n = active[t]
                z, x = (r[: 4 * n * HIDDEN].reshape(4, n, HIDDEN) for r in (room, more))
                np.matmul(h[:n], wh, out=z)
                for k in range(4):
                    np.take(wx[k], ids[t, :n], axis=0, out=x[k], mode="clip")
                z += x
                sigmoid_of_minus(z)
                z[3] *= 2
                z[3] -= 1
                c = c[:n]
                c *= z[1]
                z[0] *= z[3]
                c += z[0]
                h = h[:n]
                np.multiply(c, -2, out=h)
                sigmoid_of_minus(h)
                h *= 2
                h -= 1
                h *= z[2]
                np.matmul(h, we, out=e[t, :n])
            out.append(e)
        result: list = [None] * len(windows)
        for col, k in enumerate(order):
            n = lengths[col]
            result[k] = out[0][:n, col] + out[1][:n, col][::-1] + self.p["bias"]
        return result

    def doubtful(self, e: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of the scores ``e`` that may hold a span; it is certain that the best path is
        outside everywhere else.

        A run of other tags gains at most: at its first position the best other score with the transition
        from outside, at further ones the best with a transition within a run, and once the best way out,
        each less the outside one. Sums over a run come from prefix sums, and the earliest start with which a
        run that ends at a position can gain from a running maximum, so no run that could is left out.
        """
        trans = self.p["trans"].astype(np.float64)
        rest = trans[0, 0]
        column = e[:, 1].astype(np.float64)
        first, total = column + (trans[0, 1] - rest), column + (trans[1:, 1].max() - rest)
        for k in range(2, TAGS):  # column by column: far quicker than along short rows
            column = e[:, k].astype(np.float64)
            np.maximum(first, column + (trans[0, k] - rest), out=first)
            np.maximum(total, column + (trans[1:, k].max() - rest), out=total)
        first -= e[:, 0]
        total -= e[:, 0]
        np.cumsum(total, out=total)
        lead = np.maximum.accumulate(first - total)
        least = -(total + trans[1:, 0].max() - rest)
        ends = np.flatnonzero(lead > least)
        if not len(ends):
            return []
        starts = np.searchsorted(lead, least[ends], side="right")
        out: list[list[int]] = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            if out and a <= out[-1][1] + 3:
                out[-1][1] = max(out[-1][1], b + 1)
            else:
                out.append([a, b + 1])
        return [(a, b) for a, b in out]

    def viterbi(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """The best path through each of the score matrices; all advance together, longest first."""
        trans = self.p["trans"]
        order = np.argsort([-len(x) for x in parts], kind="stable")
        lengths = np.array([len(parts[k]) for k in order])
        steps = int(lengths[0]) if len(lengths) else 0
        e = np.zeros((steps, len(parts), TAGS), np.float32)
        for col, k in enumerate(order):
            e[: len(parts[k]), col] = parts[k]
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")
        back = np.zeros((steps, len(parts), TAGS), np.int8)
        final = np.zeros((len(parts), TAGS), np.float32)
        s = e[0].copy() if steps else final
        for t in range(1, steps):
            n = active[t]
            final[n : len(s)] = s[n:]
            m = s[:n, :, None] + trans
            back[t, :n] = m.argmax(1)
            s = m.max(1) + e[t, :n]
        final[: len(s)] = s
        paths: list = [None] * len(parts)
        tag = final.argmax(1)
        whole = np.zeros((steps, len(parts)), np.int8)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            whole[t, :n] = tag[:n]
            if t:
                tag[:n] = back[t, np.arange(n), tag[:n]]
        for col, k in enumerate(order):
            paths[k] = whole[: lengths[col], col]
        return paths

    def paths(self, parts: list[np.ndarray], most: int = 300_000) -> list[np.ndarray]:
        """``viterbi`` of parts of like length together, so that one long part isn't the measure of all:
        ``most`` padded positions at once, or a single part."""
        order = sorted(range(len(parts)), key=lambda k: -len(parts[k]))
        out: list = [None] * len(parts)
        at = 0
        while at < len(order):
            some = order[at : at + max(1, most // max(1, len(parts[order[at]])))]
            for k, path in zip(some, self.viterbi([parts[k] for k in some])):
                out[k] = path
            at += len(some)
        return out

    def tag(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """Spans (start, end, kind, mean score above outside) of each text. Windows overlap; each position's scores come from the
        window in which it is further from a border, and one path is decoded through the whole text."""
        windows, cuts = [], []
        for t in texts:
            codes = self.encode(t)
            starts = list(range(0, max(1, len(codes) - MARGIN), WINDOW - MARGIN))
            cuts.append((len(windows), starts, len(codes)))
            windows += [codes[s : s + WINDOW] for s in starts]
        scores = [e for k in range(0, len(windows), 3_000) for e in self.emissions(windows[k : k + 3_000])]
        wall = np.full((1, TAGS), -1e4, np.float32)  # between two texts
        wall[0, 0] = 0
        parts, at, place = [wall], [], 1
        for first, starts, n in cuts:
            at.append(place)
            for k in range(len(starts)):
                e = scores[first + k]
                lo = MARGIN // 2 if k else 0
                parts.append(e[lo : len(e) - (MARGIN - MARGIN // 2) if k + 1 < len(starts) else len(e)])
            parts.append(wall)
            place += n + 1
        e = np.concatenate(parts)
        pieces = [(max(0, a - 2), min(len(e), b + 2)) for a, b in self.doubtful(e)]
        spans: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        for (a, _), path in zip(pieces, self.paths([e[a:b] for a, b in pieces])):
            if not path.any():
                continue
            start, kind = None, None
            for i, tag in enumerate([*path.tolist(), 0]):
                k = (tag - 1) // 2 if tag else None
                if start is not None and (k is None or tag % 2 == 1 or k != kind):
                    owner = int(np.searchsorted(at, a + start, side="right")) - 1
                    rows = np.arange(a + start, a + i)
                    spans[owner].append((a + start - at[owner], a + i - at[owner], KINDS[kind], round(float((e[rows, path[start:i]] - e[rows, 0]).mean()), 4)))
                    start = None
                if tag and start is None:
                    start, kind = i, k
        return spans

    # Training

    def loss_and_gradient(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """CRF negative log likelihood and its gradient; ids and gold are (time, batch)."""
        steps, n = ids.shape
        h_ = HIDDEN
        sig = lambda x: 1 / (1 + np.exp(-x))
        kept = {}
        e = np.broadcast_to(self.p["bias"], (steps, n, TAGS)).copy()
        for d in "fb":
            seq = ids if d == "f" else ids[::-1]
            wx, wh = self.p[f"x{d}"], self.p[f"h{d}"]
            h, c = np.zeros((n, h_), np.float32), np.zeros((n, h_), np.float32)
            gates, cells, hs = [], [c], [h]
            for t in range(steps):
                z = wx[seq[t]] + h @ wh
                z[:, : 3 * h_] = sig(z[:, : 3 * h_])
                z[:, 3 * h_ :] = np.tanh(z[:, 3 * h_ :])
                c = z[:, h_ : 2 * h_] * c + z[:, :h_] * z[:, 3 * h_ :]
                h = z[:, 2 * h_ : 3 * h_] * np.tanh(c)
                gates.append(z)
                cells.append(c)
                hs.append(h)
            kept[d] = (seq, gates, cells, hs)
            part = np.stack(hs[1:]) @ self.p[f"e{d}"]
            e += part if d == "f" else part[::-1]
        trans = self.p["trans"].astype(np.float64)
        e64 = e.astype(np.float64)
        alpha = np.empty((steps, n, TAGS))
        alpha[0] = e64[0]
        for t in range(1, steps):
            m = alpha[t - 1][:, :, None] + trans
            top = m.max(1)
            alpha[t] = top + np.log(np.exp(m - top[:, None, :]).sum(1)) + e64[t]
        top = alpha[-1].max(1, keepdims=True)
        log_z = (top + np.log(np.exp(alpha[-1] - top).sum(1, keepdims=True)))[:, 0]
        rows = np.arange(n)
        score = e64[np.arange(steps)[:, None], rows, gold].sum(0) + trans[gold[:-1], gold[1:]].sum(0)
        de = np.empty((steps, n, TAGS), np.float32)
        dt = np.zeros((TAGS, TAGS))
        beta = np.zeros((n, TAGS))
        for t in range(steps - 1, -1, -1):
            de[t] = np.exp(alpha[t] + beta - log_z[:, None])
            if t:
                nxt = e64[t] + beta
                dt += np.exp(alpha[t - 1][:, :, None] + trans + nxt[:, None, :] - log_z[:, None, None]).sum(0)
                m = trans[None] + nxt[:, None, :]
                top = m.max(2)
                beta = top + np.log(np.exp(m - top[:, :, None]).sum(2))
        de[np.arange(steps)[:, None], rows, gold] -= 1
        np.add.at(dt, (gold[:-1], gold[1:]), -1)
        g = {"trans": (dt / n).astype(np.float32), "bias": de.sum((0, 1)) / n}
        for d in "fb":
            seq, gates, cells, hs = kept[d]
            wh, we = self.p[f"h{d}"], self.p[f"e{d}"]
            ded = de if d == "f" else de[::-1]
            g[f"e{d}"] = np.tensordot(np.stack(hs[1:]), ded, axes=((0, 1), (0, 1))) / n
            gx, gh = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(wh)
            dh, dc = np.zeros((n, h_), np.float32), np.zeros((n, h_), np.float32)
            dz_all = np.empty((steps, n, 4 * h_), np.float32)
            for t in range(steps - 1, -1, -1):
                z, c, tc = gates[t], cells[t], np.tanh(cells[t + 1])
                i, f, o, a = z[:, :h_], z[:, h_ : 2 * h_], z[:, 2 * h_ : 3 * h_], z[:, 3 * h_ :]
                dh = dh + ded[t] @ we.T
                dc = dc + dh * o * (1 - tc * tc)
                dz = dz_all[t]
                dz[:, :h_] = dc * a * i * (1 - i)
                dz[:, h_ : 2 * h_] = dc * c * f * (1 - f)
                dz[:, 2 * h_ : 3 * h_] = dh * tc * o * (1 - o)
                dz[:, 3 * h_ :] = dc * i * (1 - a * a)
                gh += hs[t].T @ dz
                dc = dc * f
                dh = dz @ wh.T
            np.add.at(gx, seq.ravel(), dz_all.reshape(-1, 4 * h_))
            g[f"x{d}"], g[f"h{d}"] = gx / n, gh / n
        return float((log_z - score).mean()), g
