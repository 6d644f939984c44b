"""A small character convolutional network in numpy, trained by Adam."""

from __future__ import annotations

import numpy as np

LEFT, MIDDLE, RIGHT = 24, 48, 24
WIDTH = LEFT + MIDDLE + RIGHT
#: Classes: digits, small letters, capitals, common marks, white space, others, and the padding 0.
MARKS = "\"'=:;,.+-/_()[]{}<>$%&*#@!?|\\`~^"
SYMBOLS = {c: k + 1 for k, c in enumerate("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + MARKS)}
SPACE_CLASS = len(SYMBOLS) + 1
OTHER_CLASS = len(SYMBOLS) + 2
CLASSES = len(SYMBOLS) + 3


def _classes(text: str) -> list[int]:
    return [SYMBOLS.get(c, SPACE_CLASS if c.isspace() else OTHER_CLASS) for c in text]


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Places of MIDDLE characters at most that cover a candidate, a quarter of MIDDLE apart, so that any 36 are whole in one."""
    return [(a, min(a + MIDDLE, end)) for a in [*range(start, end - MIDDLE, MIDDLE // 4), max(start, end - MIDDLE)]]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Classes of a place of MIDDLE characters at most with its context: what precedes it, what follows."""
    token = text[start:end]
    out = np.zeros(WIDTH, dtype=np.uint8)
    before, after = _classes(text[max(0, start - LEFT) : start]), _classes(text[end : end + RIGHT])
    out[LEFT - len(before) : LEFT] = before
    out[LEFT : LEFT + len(token)] = _classes(token)
    out[LEFT + MIDDLE : LEFT + MIDDLE + len(after)] = after
    return out


class Network:
    """Embedding, one convolution, maxima over candidate and context and the candidate's mean, one output."""

    def __init__(self, embed: int = 8, kernel: int = 5, filters: int = 24, seed: int = 7):
        r = np.random.default_rng(seed)
        self.kernel, self.embed, self.filters = kernel, embed, filters
        self.w = {
            "e": r.normal(0, 0.5, (CLASSES, embed)), "k": r.normal(0, (2 / (kernel * embed)) ** 0.5, (kernel * embed, filters)), "b": np.zeros(filters),
            "o": r.normal(0, 0.1, 3 * filters), "c": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _forward(self, x: np.ndarray):
        n, steps = len(x), WIDTH - self.kernel + 1
        e = self.w["e"][x]
        cols = np.lib.stride_tricks.sliding_window_view(e, self.kernel, axis=1).transpose(0, 1, 3, 2).reshape(n * steps, -1)
        h = np.maximum(cols @ self.w["k"] + self.w["b"], 0).reshape(n, steps, self.filters)
        inside = h[:, LEFT : LEFT + MIDDLE - self.kernel + 1]
        outside = np.concatenate((h[:, :LEFT], h[:, LEFT + MIDDLE - self.kernel + 1 :]), axis=1)
        a, b = inside.argmax(axis=1), outside.argmax(axis=1)
        pooled = np.concatenate((inside.max(axis=1), outside.max(axis=1), inside.mean(axis=1)), axis=1)
        return cols, h, a, b, pooled, pooled @ self.w["o"] + self.w["c"]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = [self._forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict:
        cols, h, a, b, pooled, margin = self._forward(x)
        n, steps, f = h.shape
        g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / n
        gp = g[:, None] * self.w["o"]
        gh = np.zeros_like(h)
        rows, each = np.arange(n)[:, None], np.arange(f)[None]
        gh[:, LEFT : LEFT + MIDDLE - self.kernel + 1] += gp[:, None, 2 * f :] / (MIDDLE - self.kernel + 1)
        gh[rows, LEFT + a, each] += gp[:, :f]
        gh[rows, np.where(b < LEFT, b, b + MIDDLE - self.kernel + 1), each] += gp[:, f : 2 * f]
        gh = (gh * (h > 0)).reshape(n * steps, f)
        gc = (gh @ self.w["k"].T).reshape(n, steps, self.kernel, self.embed)
        ge = np.zeros((n, WIDTH, self.embed), dtype=np.float32)
        for k in range(self.kernel):
            ge[:, k : k + steps] += gc[:, :, k]
        flat = x.ravel()
        return {
            "e": np.column_stack([np.bincount(flat, ge[:, :, d].ravel(), CLASSES) for d in range(self.embed)]), "k": cols.T @ gh, "b": gh.sum(axis=0),
            "o": pooled.T @ g, "c": np.array([g.sum()]),
        }

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 4e-3, seed: int = 11) -> None:
        r, t = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                t += 1
                for k, g in self._gradient(x[order[i : i + batch]], y[order[i : i + batch]]).items():
                    g = g.astype(np.float32) + 1e-5 * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
