"""A bidirectional LSTM over characters with CRF transitions, in numpy: trained on windows, decoded over whole texts.

A text is covered by overlapping windows whose places depend on the text alone. Each character takes its scores from the
window in which it lies deepest; one Viterbi search then goes through the whole text. Where no stretch of other tags can
gain on "outside", that is on the best path for certain, so the search need only visit the stretches between such
characters; the result is that of a search through every character.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tag 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k.
TAGS = 1 + 2 * len(KINDS)
#: Characters of a window, and how many of them the next one repeats.
WINDOW, OVERLAP = 256, 64
_MARKS = " \n\t.@+-()_%:/#,;|=!?\"'*&<>[]{}"
# Marks in other scripts or widths, and the ASCII ones that they stand for.
_ALIKE = {"\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2212": "-", "\uff0d": "-", "\uff20": "@", "\ufe6b": "@", "\uff0b": "+", "\uff0e": ".", "\u2024": ".", "\u3002": "."}
N_CLASSES = 5 + 26 + len(_MARKS)


@functools.cache
def _classes() -> np.ndarray:
    """Classes of the code points below 65536: 0 beyond the text, digits of any script, capitals, other letters, the rest, each small letter, each mark."""
    table = np.full(1 << 16, 4, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if unicodedata.decimal(c, None) is not None:
            table[i] = 1
        elif c.isalpha():
            table[i] = 3
    table[ord("A") : ord("Z") + 1] = 2
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" + _MARKS):
        table[ord(c)] = 5 + i
    for c, alike in _ALIKE.items():
        table[ord(c)] = table[ord(alike)]
    return table


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _classes()[np.where(points < 1 << 16, points, 0xFFFD)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _field(number: int, value: int | bytes) -> bytes:
    """A field of a protocol buffer, number, value and length being small."""
    return bytes([number << 3, value]) if isinstance(value, int) else bytes([number << 3 | 2, len(value)]) + value


@functools.cache
def _tanh_session() -> tuple | None:
    """ONNX Runtime with a model of one node, tanh over two dimensions, in this thread; None where it is not installed."""
    try:
        import onnxruntime
    except ModuleNotFoundError:
        return None
    kind = _field(1, _field(1, 1) + _field(2, _field(1, b"") * 2))  # 32-bit floats in two dimensions of any size
    value = lambda name: _field(1, name) + _field(2, kind)
    graph = _field(1, _field(1, b"x") + _field(2, b"y") + _field(4, b"Tanh")) + _field(2, b"tanh") + _field(11, value(b"x")) + _field(12, value(b"y"))
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    return onnxruntime, onnxruntime.InferenceSession(_field(1, 8) + _field(7, graph) + _field(8, _field(1, b"") + _field(2, 14)), options, providers=["CPUExecutionProvider"])


def tanh_of(x: np.ndarray, out: np.ndarray) -> Callable[[], object]:
    """What writes the tanh of x to out (which may be x), whenever called. numpy's takes some ten times as long on CPUs without AVX-512."""
    found = _tanh_session()
    if not found:
        return lambda: np.tanh(x, out=out)
    assert all(a.dtype == np.float32 and a.flags.c_contiguous for a in (x, out))
    bound = found[1].io_binding()
    bound.bind_input("x", "cpu", 0, np.float32, x.shape, x.ctypes.data)
    bound.bind_output("y", "cpu", 0, np.float32, out.shape, out.ctypes.data)
    return lambda: found[1].run_with_iobinding(bound)


class Tagger:
    def __init__(self, embed: int = 8, hidden: int = 14, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {
            "embed": r.normal(0, 0.3, (N_CLASSES, embed)),
            "out": r.normal(0, 0.2, (2 * hidden, TAGS)),
            "out_b": np.zeros(TAGS),
            "trans": np.zeros((TAGS, TAGS)),
        }
        for side in "fb":
            self.p[f"w{side}"] = r.normal(0, 1 / np.sqrt(embed + hidden), (embed + hidden, 4 * hidden))
            self.p[f"b{side}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _lstm(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """x: time, window, feature. The states for each time, and what the way back needs."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32)
        c, states, saved = h, np.empty((*x.shape[:2], n), np.float32), []
        for t in range(len(x)):
            joined = np.concatenate([x[t], h], 1)
            z = joined @ self.p[f"w{side}"] + self.p[f"b{side}"]
            gates = _sigmoid(z[:, : 3 * n])
            i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(z[:, 3 * n :])
            before, c = c, f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            states[t] = h
            saved.append((joined, i, f, o, g, before, squashed))
        return states, saved

    def _lstm_back(self, d: np.ndarray, saved: list, side: str, grads: dict) -> np.ndarray:
        n, w = self.hidden, self.p[f"w{side}"]
        dx = np.empty((*d.shape[:2], w.shape[0] - n), np.float32)
        dh, dc = np.zeros_like(d[0]), np.zeros_like(d[0])
        for t in range(len(d) - 1, -1, -1):
            joined, i, f, o, g, before, squashed = saved[t]
            dh = dh + d[t]
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], 1)
            grads[f"w{side}"] += joined.T @ dz
            grads[f"b{side}"] += dz.sum(0)
            back = dz @ w.T
            dx[t], dh, dc = back[:, :-n], back[:, -n:], dc * f
        return dx

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """x: window, time. Scores of the tags: time, window, tag."""
        e = self.p["embed"][x.T]
        forward, saved_f = self._lstm(e, "f")
        backward, saved_b = self._lstm(e[::-1], "b")
        both = np.concatenate([forward, backward[::-1]], 2)
        return both @ self.p["out"] + self.p["out_b"], (both, saved_f, saved_b)

    def loss_and_grads(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        scores, (both, saved_f, saved_b) = self.emissions(x)
        time, n = scores.shape[:2]
        yt = y.T
        top = scores.max(2, keepdims=True)
        here, step = np.exp((scores - top).astype(np.float64)), np.exp(self.p["trans"].astype(np.float64))
        # Forward and backward sums, each place scaled to a sum of 1; what is before and after a window counts as outside.
        ahead, scale, behind = np.empty_like(here), np.empty((time, n, 1)), np.empty_like(here)
        now = step[0] * here[0]
        for t in range(time):
            if t:
                now = (now @ step) * here[t]
            scale[t] = now.sum(1, keepdims=True)
            now = ahead[t] = now / scale[t]
        behind[-1] = step[:, 0]
        for t in range(time - 2, -1, -1):
            behind[t] = (behind[t + 1] * here[t + 1] / scale[t + 1]) @ step.T
        total = (ahead[-1] @ step[:, 0])[:, None]
        whole = (np.log(scale) + top).sum(0)[:, 0] + np.log(total[:, 0])
        d = ahead * behind / total
        pairs = step * np.tensordot(ahead[:-1] / total, here[1:] * behind[1:] / scale[1:], ((0, 1), (0, 1)))
        pairs[0] += d[0].sum(0)
        pairs[:, 0] += d[-1].sum(0)
        padded = np.concatenate([np.zeros((1, n), yt.dtype), yt, np.zeros((1, n), yt.dtype)])
        np.add.at(pairs, (padded[:-1].ravel(), padded[1:].ravel()), -1)
        gold = np.take_along_axis(scores, yt[:, :, None], 2)[:, :, 0].sum(0) + self.p["trans"][padded[:-1], padded[1:]].sum(0)
        np.put_along_axis(d, yt[:, :, None], np.take_along_axis(d, yt[:, :, None], 2) - 1, 2)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["trans"] = pairs.astype(np.float32)
        d = (d / n).astype(np.float32)
        grads["trans"] /= n
        grads["out"] = np.tensordot(both, d, ((0, 1), (0, 1)))
        grads["out_b"] = d.sum((0, 1))
        states = d @ self.p["out"].T
        dx = self._lstm_back(states[:, :, : self.hidden], saved_f, "f", grads)
        dx += self._lstm_back(states[::-1, :, self.hidden :], saved_b, "b", grads)[::-1]
        np.add.at(grads["embed"], x.T, dx)
        return float((whole - gold).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 9, batch: int = 128, rate: float = 0.03, seed: int = 5, bound: float = 2.5) -> Tagger:
        r, m, step = np.random.default_rng(seed), {k: [0.0, 0.0] for k in self.p}, 0
        total = epochs * ((len(x) + batch - 1) // batch)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                rows, step = order[at : at + batch], step + 1
                _, grads = self.loss_and_grads(x[rows], y[rows])
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5 / max(norm, 1e-9))
                    m[k] = [0.9 * m[k][0] + 0.1 * g, 0.99 * m[k][1] + 0.01 * g * g]
                    now = rate * (1 - 0.9 * step / total) * min(1, step / 10)
                    # Bounded transitions: a lead that is decisive is within reach of the scores.
                    self.p[k] = (self.p[k] - now * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
                self.p["trans"] = np.clip(self.p["trans"], -bound, bound)
        return self

    # --- decoding ---

    def _side(self, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For decoding: embeddings, weights of gates by embedding, a constant and state, output weights by the constant and state; gates are halved where a sigmoid is made from a tanh."""
        n, embed = self.hidden, self.p["embed"]
        half = np.ones(4 * n, np.float32)
        half[: 3 * n] = 0.5
        w = np.concatenate([self.p[f"w{side}"][: embed.shape[1]], self.p[f"b{side}"][None], self.p[f"w{side}"][embed.shape[1] :]]) * half
        out = np.concatenate([self.p["out_b"][None], self.p["out"][:n]] if side == "f" else [np.zeros((1, TAGS), np.float32), self.p["out"][n:]])
        return np.ascontiguousarray(embed.T), np.ascontiguousarray(w.T), np.ascontiguousarray(out.T)

    def _pass(self, x: np.ndarray, steps: list[tuple[int, int]], side: str, scores: np.ndarray) -> None:
        """Adds one direction's part to scores: time, tag, window. x: time, window; steps: times in turn, and how many of the first windows are read at each."""
        embed, weights, out = self._side(side)
        n, e, k = self.hidden, len(embed), -1
        whole, cells = np.zeros((e + 1 + n, x.shape[1]), np.float32), np.zeros((n, x.shape[1]), np.float32)
        c = cells[:, :0]
        whole[e] = 1
        for t, now in steps:
            if now != k:
                cells[:, : c.shape[1]] = c
                k = now
                joined, c, z, squashed = whole[:, :k], cells[:, :k].copy(), np.empty((4 * n, k), np.float32), np.empty((n, k), np.float32)
                squash, squash_cells = tanh_of(z, z), tanh_of(c, squashed)
                seen, known, h = joined[:e], joined[e:], joined[e + 1 :]
                gates, i, f, o, g = z[: 3 * n], z[:n], z[n : 2 * n], z[2 * n : 3 * n], z[3 * n :]
            embed.take(x[t, :k], axis=1, out=seen, mode="clip")
            np.matmul(weights, joined, out=z)
            squash()
            np.multiply(gates, 0.5, out=gates)
            np.add(gates, 0.5, out=gates)
            np.multiply(c, f, out=c)
            np.multiply(i, g, out=i)
            np.add(c, i, out=c)
            squash_cells()
            np.multiply(squashed, o, out=h)
            scores[t, :, :k] += out @ known

    def window_scores(self, x: np.ndarray, length: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Scores of the tags for the characters from first to last of windows: time, tag, window. x: time, window; no window is longer than the one before.

        Each direction ends where no window has characters of its own any more: what follows would not be used.
        """
        scores = np.zeros((len(x), TAGS, x.shape[1]), np.float32)
        latest, soonest = np.maximum.accumulate(last[::-1])[::-1], np.minimum.accumulate(first[::-1])[::-1]  # of a window and those behind it
        times = np.arange(len(x))
        ahead = np.searchsorted(-latest, -times, side="left")
        back = np.minimum(np.searchsorted(-length, -times, side="left"), np.searchsorted(soonest, times, side="right"))
        self._pass(x, [(t, k) for t, k in enumerate(ahead.tolist()) if k], "f", scores)
        self._pass(x, [(t, k) for t, k in reversed(list(enumerate(back.tolist()))) if k], "b", scores)
        return scores

    def undecided(self, lead: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which characters of texts (lead: of the best other tag over tag 0, for each character; ends: behind each text) may have another tag than 0 on the best path.

        A stretch of other tags gains, against tag 0 throughout, at most what entering and leaving it gain and, for each
        character, its best tag's lead over tag 0 and the best transition's. A character is decided if no stretch around
        it can gain; the best stretch that ends or begins at a character comes from running sums and their extremes.
        """
        t = self.p["trans"].astype(np.float64) - float(self.p["trans"][0, 0])
        inner, edges = float(t[1:, 1:].max()), float(t[0, 1:].max() + t[1:, 0].max())
        sums = np.zeros(len(lead) + 1)
        np.cumsum(lead + inner, out=sums[1:])
        most = np.empty(len(lead))
        for s, e in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
            before = np.minimum.accumulate(sums[s:e])  # the least sum before each character, itself excluded
            behind = np.maximum.accumulate(sums[s + 1 : e + 1][::-1])[::-1]
            most[s:e] = behind - before
        return most + edges - inner > -1e-3  # a stretch has one inner transition less than characters

    def tags(self, texts: list[str], at_once: int = 720) -> list[list[tuple[int, np.ndarray]]]:
        """For each text the stretches (start, tags) that hold all tags other than 0 on its best path.

        at_once windows are read together; where their number is a power of two, the rows of the arrays share cache lines and all is slower.
        """
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        if not sizes.sum():
            return out
        stride = WINDOW - OVERLAP
        n = np.where(sizes > 0, np.maximum(1, -((OVERLAP - sizes) // stride)), 0)  # windows of each text
        text, before = np.repeat(np.arange(len(texts)), n), np.cumsum(n) - n
        start = (np.arange(len(text)) - before[text]) * stride
        length = np.minimum(sizes[text] - start, WINDOW)
        # The first and last character of a window that is its own.
        first, last = np.where(start > 0, OVERLAP // 2, 0), np.where(start + length < sizes[text], length - OVERLAP // 2, length)
        start += (ends - sizes)[text]
        order = np.lexsort((first, -last, -length))
        codes, lead, kept = np.concatenate([classes_of(t) for t in texts]), np.empty(int(ends[-1])), []
        for at in range(0, len(order), at_once):
            some = order[at : at + at_once]
            x = np.take(codes, start[some] + np.arange(length[some[0]])[:, None], mode="clip").astype(np.intp)
            scores = self.window_scores(x, length[some], first[some], last[some])
            kept.append(scores)
            leads = np.ascontiguousarray((scores[:, 1:].max(1) - scores[:, 0]).T)
            for own, s, a, b in zip(leads, start[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True):
                lead[s + a : s + b] = own[a:b]
        place = np.flatnonzero(self.undecided(lead, ends))
        if not len(place):
            return out
        owner = np.searchsorted(ends, place, side="right")
        cuts = np.flatnonzero((np.diff(owner) != 0) | (np.diff(place) != 1)) + 1
        begin, end = np.concatenate([[0], cuts]).astype(int), np.concatenate([cuts, [len(place)]]).astype(int)
        # Of each such character the window whose own it is, and the window's place among those kept.
        inside = place - (ends - sizes)[owner]
        window = before[owner] + np.clip((inside - OVERLAP // 2) // stride, 0, n[owner] - 1)
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        group, column = np.divmod(ranks[window], at_once)
        merged = np.empty((len(place), TAGS), np.float32)
        for k in np.unique(group):
            own = np.flatnonzero(group == k)
            merged[own] = kept[k][place[own] - start[window[own]], :, column[own]]
        for s, tags in zip(begin, self._viterbi(merged, begin, end), strict=True):
            i = owner[s]
            out[i].append((int(inside[s]), tags))
        return out

    def _viterbi(self, score: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The best tags of each stretch, tag 0 being before and after it."""
        order = np.argsort(starts - ends, kind="stable")
        begin, length = starts[order], (ends - starts)[order]
        trans = self.p["trans"].astype(np.float64)
        best, backs, k = score[begin] + trans[0], [], len(begin)
        final = np.zeros(len(begin), np.int64)
        for t in range(int(length[0])):
            still = int(np.searchsorted(-length, -t, side="left"))
            if t:
                through = best[:still, :, None] + trans
                backs.append(through.argmax(1).astype(np.int8))
                best = through.max(1) + score[begin[:still] + t]
            done = int(np.searchsorted(-length, -(t + 1), side="left"))
            final[done:still] = (best[done:still] + trans[:, 0]).argmax(1)
        tags = [np.empty(n, np.int8) for n in length]
        for i, n in enumerate(length):
            tag = final[i]
            tags[i][n - 1] = tag
            for t in range(n - 1, 0, -1):
                tag = backs[t - 1][i, tag]
                tags[i][t - 1] = tag
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(order)
        for i, at in enumerate(order):
            out[at] = tags[i]
        return out
