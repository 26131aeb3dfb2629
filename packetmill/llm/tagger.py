"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Tags are O and, per kind, B (begin) and I (inside); transitions into I are open only from B or I of the kind.
"""

from __future__ import annotations

import io

import numpy as np

DIM, HIDDEN = 8, 16
#: Characters with an embedding of their own; digits, lower and upper case letters and the rest share one each.
SYMBOLS = "@.-_+() %/:,;=#'\"[]\n\t"
PAD, DIGIT, LOWER, UPPER, OTHER = 0, 1, 2, 3, 4
_CLOSED = -1e4


def encode(text: str) -> np.ndarray:
    """Character classes of a text."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    table = np.full(128, OTHER, np.int64)
    table[48:58], table[97:123], table[65:91] = DIGIT, LOWER, UPPER
    for k, c in enumerate(SYMBOLS):
        table[ord(c)] = OTHER + 1 + k
    return np.where(codes < 128, table[np.minimum(codes, 127)], LOWER)


def open_transitions(kinds: int) -> np.ndarray:
    """0 where a transition is allowed, very low where it is not; the last row is the start."""
    n = 1 + 2 * kinds
    out = np.zeros((n + 1, n))
    for k in range(kinds):
        inside = 2 + 2 * k
        out[:, inside] = _CLOSED
        out[[inside - 1, inside], inside] = 0
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    def __init__(self, kinds: list[str], weights: dict[str, np.ndarray] | None = None, seed: int = 5):
        self.kinds, tags = kinds, 1 + 2 * len(kinds)
        self.closed = open_transitions(len(kinds))
        if weights is None:
            rng = np.random.default_rng(seed)
            scale = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
            weights = {"emb": rng.normal(0, 0.5, (OTHER + 1 + len(SYMBOLS), DIM)), "out": scale(2 * HIDDEN, tags),
                       "bias": np.zeros(tags), "trans": np.zeros((tags + 1, tags))}
            for d in "fb":
                weights |= {f"x{d}": scale(DIM, 4 * HIDDEN), f"h{d}": scale(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN)}
                weights[f"b{d}"][HIDDEN:2 * HIDDEN] = 1  # remember at first
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, kinds=np.array(self.kinds, dtype=str), **self.w)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tagger:
        with np.load(io.BytesIO(data)) as f:
            return cls(f["kinds"].tolist(), {k: f[k] for k in f.files if k != "kinds"})

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states ``(time, batch, HIDDEN)`` in reading order ``d``; ``keep`` stores what the gradient needs."""
        steps, n, h = len(x), x.shape[1], HIDDEN
        pre = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, kept = np.empty((steps, n, h), np.float32), []
        for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
            z = pre[t] + state @ self.w[f"h{d}"]
            gates, g = _sigmoid(z), np.tanh(z[:, 2 * h:3 * h])
            i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 3 * h:]
            before, old = cell, state
            cell = f * cell + i * g
            th = np.tanh(cell)
            state = o * th
            out[t] = state
            if keep:
                kept.append((t, i, f, g, o, before, th, old))
        return out, kept

    def _back(self, x, d, kept, dout, grads):
        n, h = x.shape[1], HIDDEN
        dx = np.zeros_like(x)
        dstate, dcell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        wh, wx = self.w[f"h{d}"], self.w[f"x{d}"]
        for t, i, f, g, o, before, th, old in reversed(kept):
            ds = dout[t] + dstate
            dc = dcell + ds * o * (1 - th * th)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g * g), ds * th * o * (1 - o)], 1)
            grads[f"h{d}"] += old.T @ dz
            grads[f"x{d}"] += x[t].T @ dz
            grads[f"b{d}"] += dz.sum(0)
            dx[t] = dz @ wx.T
            dstate, dcell = dz @ wh.T, dc * f
        return dx

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """Tag scores ``(time, batch, tags)`` of windows given as ``(batch, time)`` classes."""
        x = self.w["emb"][chars.T]
        both = np.concatenate([self._run(x, "f", False)[0], self._run(x, "b", False)[0]], 2)
        return both @ self.w["out"] + self.w["bias"]

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window (Viterbi)."""
        e, trans = self.emissions(chars), self.w["trans"] + self.closed
        steps, n, tags = e.shape
        best, back = e[0] + trans[-1], np.empty((steps, n, tags), np.int64)
        for t in range(1, steps):
            ways = best[:, :, None] + trans[:-1]
            back[t] = ways.argmax(1)
            best = ways.max(1) + e[t]
        out = np.empty((n, steps), np.int64)
        out[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t, np.arange(n), out[:, t]]
        return out

    def loss_and_gradient(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag sequences per window, and its gradient."""
        n, steps = chars.shape
        x = self.w["emb"][chars.T]
        (hf, kf), (hb, kb) = self._run(x, "f", True), self._run(x, "b", True)
        both = np.concatenate([hf, hb], 2)
        e = (both @ self.w["out"] + self.w["bias"]).astype(np.float64)
        trans = (self.w["trans"] + self.closed).astype(np.float64)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + trans[-1]
        for t in range(1, steps):
            alpha[t] = e[t] + _logsum(alpha[t - 1][:, :, None] + trans[:-1], 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum(trans[:-1] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsum(alpha[-1], 1)
        rows, y = np.arange(n), tags.T
        gold = e[np.arange(steps)[:, None], rows, y].sum(0) + trans[-1, y[0]] + trans[y[:-1], y[1:]].sum(0)
        de = np.exp(alpha + beta - z[:, None])
        dtrans = np.zeros_like(trans)
        dtrans[-1] += de[0].sum(0)
        for t in range(1, steps):
            dtrans[:-1] += np.exp(alpha[t - 1][:, :, None] + trans[:-1] + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        de[np.arange(steps)[:, None], rows, y] -= 1
        np.subtract.at(dtrans[-1], y[0], 1)
        np.subtract.at(dtrans, (y[:-1].ravel(), y[1:].ravel()), 1)
        de = (de / n).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["trans"] = (dtrans / n).astype(np.float32)
        grads["out"] = np.tensordot(both, de, ((0, 1), (0, 1)))
        grads["bias"] = de.sum((0, 1))
        dboth = de @ self.w["out"].T
        dx = self._back(x, "f", kf, dboth[:, :, :HIDDEN], grads) + self._back(x, "b", kb, dboth[:, :, HIDDEN:], grads)
        np.add.at(grads["emb"], chars.T, dx)
        return float((z - gold).mean()), grads

    def train(self, chars: np.ndarray, tags: np.ndarray, steps: int = 260, batch: int = 32, rate: float = 0.02, seed: int = 1) -> None:
        """Adam on random batches; the step size falls to a tenth."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            at = rng.integers(0, len(chars), batch)
            _, grads = self.loss_and_gradient(chars[at], tags[at])
            lr = rate * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] -= (lr * first[k] / (1 - 0.9 ** step)
                              / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)
