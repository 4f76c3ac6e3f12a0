"""A character-level bidirectional LSTM with CRF transitions, trained by back-propagation in numpy."""

from __future__ import annotations

import numpy as np

#: Character classes: 0 padding, 1 other letters, 2 other characters, 3 white space, then printable ASCII by itself (letters folded).
CLASSES = 4 + 95
_ascii = np.full(128, 2, np.int64)
_ascii[0x21:0x7F] = np.arange(0x21, 0x7F) - 0x20 + 3
_ascii[ord("A") : ord("Z") + 1] += 32
_ascii[[9, 10, 11, 12, 13, 32]] = 3


def char_classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _ascii[np.minimum(code, 127)], np.where(code < 0x250, 1, 2))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    def __init__(self, tags: int, hidden: int = 12, seed: int = 0) -> None:
        rng, h = np.random.default_rng(seed), hidden
        self.h, self.k = h, tags
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (CLASSES, 4 * h)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 0.6 / np.sqrt(h), (h, 4 * h)).astype(np.float32)
            self.p["c" + d] = np.concatenate((np.zeros(h), np.ones(h), np.zeros(2 * h))).astype(np.float32)
        self.p["out"] = rng.normal(0, 0.3, (2 * h, tags)).astype(np.float32)
        self.p["bias"] = np.zeros(tags, np.float32)
        self.p["step"] = np.zeros((tags, tags), np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, t, h = *x.shape, self.h
        wx, u, b = self.p["x" + d], self.p["u" + d], self.p["c" + d]
        out, memory = np.zeros((n, t, h), np.float32), []
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = wx[x[:, i]] + state @ u + b
            gates, g = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            before, old = state, cell
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * g
            squashed = np.tanh(cell)
            state = gates[:, 2 * h :] * squashed
            out[:, i] = state
            if keep:
                memory.append((i, before, old, gates, g, squashed))
        return out, memory

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate((self._run(x, "f", False)[0], self._run(x, "b", False)[0]), axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss (negative log-likelihood of tags y under the CRF) and its gradients."""
        n, t, h, k = *x.shape, self.h, self.k
        runs = {d: self._run(x, d, True) for d in "fb"}
        both = np.concatenate((runs["f"][0], runs["b"][0]), axis=2)
        e = (both @ self.p["out"] + self.p["bias"]).astype(np.float64)
        step = self.p["step"].astype(np.float64)
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = e[:, 0]
        for i in range(1, t):
            s = alpha[:, i - 1, :, None] + step
            m = s.max(axis=1)
            alpha[:, i] = m + np.log(np.exp(s - m[:, None]).sum(axis=1)) + e[:, i]
        for i in range(t - 2, -1, -1):
            s = step + (e[:, i + 1] + beta[:, i + 1])[:, None, :]
            m = s.max(axis=2)
            beta[:, i] = m + np.log(np.exp(s - m[:, :, None]).sum(axis=2))
        top = alpha[:, -1].max(axis=1)
        z = top + np.log(np.exp(alpha[:, -1] - top[:, None]).sum(axis=1))
        rows = np.arange(n)[:, None]
        score = e[rows, np.arange(t), y].sum(axis=1) + step[y[:, :-1], y[:, 1:]].sum(axis=1)
        de = np.exp(alpha + beta - z[:, None, None])
        de[rows, np.arange(t), y] -= 1
        pair = np.exp(alpha[:, :-1, :, None] + step + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        de = (de / n).astype(np.float32)
        grads = {"step": (pair / n).astype(np.float32), "bias": de.sum(axis=(0, 1)), "out": both.reshape(-1, 2 * h).T @ de.reshape(-1, k)}
        up = de @ self.p["out"].T
        for d, part in (("f", up[:, :, :h]), ("b", up[:, :, h:])):
            u = self.p["u" + d]
            gx, gu, gb = np.zeros_like(self.p["x" + d]), np.zeros_like(u), np.zeros_like(self.p["c" + d])
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for i, before, old, gates, g, squashed in reversed(runs[d][1]):
                dh = dh + part[:, i]
                dc = dc + dh * gates[:, 2 * h :] * (1 - squashed**2)
                dz = np.concatenate((dc * g, dc * old, dh * squashed), axis=1) * gates * (1 - gates)
                dz = np.concatenate((dz, dc * gates[:, :h] * (1 - g**2)), axis=1)
                dc = dc * gates[:, h : 2 * h]
                np.add.at(gx, x[:, i], dz)
                gu += before.T @ dz
                gb += dz.sum(axis=0)
                dh = dz @ u.T
            grads |= {"x" + d: gx, "u" + d: gu, "c" + d: gb}
        return float((z - score).mean()), grads

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 420, batch: int = 48, rate: float = 0.02, seed: int = 0) -> float:
        """Adam over batches drawn with a fixed seed; returns the last loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        loss = 0.0
        for s in range(1, steps + 1):
            at = rng.integers(0, len(x), batch)
            loss, grads = self.gradients(x[at], y[at])
            slower = rate * min(1.0, 2 * (1 - (s - 1) / steps))
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (slower * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-6)).astype(np.float32)
        return loss

    def best(self, e: np.ndarray) -> float:
        """Score of the best tags of one sequence of emissions."""
        step, score = self.p["step"], e[0]
        for row in e[1:]:
            score = (score[:, None] + step).max(axis=0) + row
        return float(score.max())

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags of one sequence of emissions (length x tags)."""
        step, score = self.p["step"], e[0]
        back = np.zeros(e.shape, np.int64)
        for i in range(1, len(e)):
            s = score[:, None] + step
            back[i] = s.argmax(axis=0)
            score = s.max(axis=0) + e[i]
        tags = np.zeros(len(e), np.int64)
        tags[-1] = score.argmax()
        for i in range(len(e) - 1, 0, -1):
            tags[i - 1] = back[i, tags[i]]
        return tags
