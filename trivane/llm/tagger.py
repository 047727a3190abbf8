"""A character-level bidirectional LSTM with a CRF over its tags, in numpy.

The gates of a character depend on it only through a table lookup, so a step costs one small product. All
windows of a batch are advanced together. Training is by exact gradients of the CRF's log-likelihood (forward and
backward sums), with Adam.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Ids of characters: ASCII as it is, one for all other letters, one for anything else; 0 also pads.
OTHER_LETTER, OTHER = 128, 129
VOCABULARY = 130


def character_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points, np.where(points < 0x2000, OTHER_LETTER, OTHER)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


@dataclass
class Tagger:
    tags: int
    hidden: int = 24
    embedding: int = 12
    seed: int = 11
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.w:
            return
        rng = np.random.default_rng(self.seed)
        e, h, k = self.embedding, self.hidden, self.tags
        self.w["embed"] = rng.normal(0, 0.3, (VOCABULARY, e))
        for side in ("f", "b"):
            self.w["x" + side] = rng.normal(0, e**-0.5, (e, 4 * h))
            self.w["h" + side] = rng.normal(0, h**-0.5, (h, 4 * h))
            bias = np.zeros(4 * h)
            bias[h : 2 * h] = 1.0  # remember at first
            self.w["c" + side] = bias
        self.w["out"] = rng.normal(0, (2 * h) ** -0.5, (2 * h, k))
        self.w["bias"] = np.zeros(k)
        self.w["move"] = np.zeros((k, k))
        self.w["start"] = np.zeros(k)
        self.w = {n: v.astype(np.float32) for n, v in self.w.items()}

    def _run(self, ids: np.ndarray, side: str, keep: bool):
        """States of one direction, (time, windows, hidden); with ``keep`` also what the gradient needs."""
        time, n = ids.shape
        h = self.hidden
        table = self.w["embed"] @ self.w["x" + side] + self.w["c" + side]
        out = np.empty((time, n, h), np.float32)
        kept = []
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(time) if side == "f" else range(time - 1, -1, -1):
            z = table[ids[t]] + state @ self.w["h" + side]
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            before, was = state, cell
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            out[t] = state
            if keep:
                kept.append((t, i, f, o, g, squashed, before, was))
        return out, kept

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """Scores of tags, (time, windows, tags)."""
        forward, kf = self._run(ids, "f", keep)
        backward, kb = self._run(ids, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.w["out"] + self.w["bias"], both, kf, kb

    def gradients(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the gold tags of (time, windows), and its gradients."""
        scores, both, kf, kb = self.emissions(ids, True)
        time, n, k = scores.shape
        move, at = self.w["move"], np.arange(n)
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0] + self.w["start"]
        for t in range(1, time):
            alpha[t] = scores[t] + _sum_exp(alpha[t - 1][:, :, None] + move, 1)
        for t in range(time - 2, -1, -1):
            beta[t] = _sum_exp(move + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _sum_exp(alpha[-1], 1)
        d = np.exp(alpha + beta - total[None, :, None])
        g = {"move": np.zeros_like(move)}
        for t in range(1, time):
            pair = alpha[t - 1][:, :, None] + move + (scores[t] + beta[t])[:, None, :] - total[:, None, None]
            g["move"] += np.exp(pair).sum(0)
            np.add.at(g["move"], (gold[t - 1], gold[t]), -1)
        picked = scores[np.arange(time)[:, None], at, gold].sum(0) + self.w["start"][gold[0]] + move[gold[:-1], gold[1:]].sum(0)
        d[np.arange(time)[:, None], at, gold] -= 1
        g["start"] = d[0].sum(0)
        g["out"] = np.einsum("tnh,tnk->hk", both, d)
        g["bias"] = d.sum((0, 1))
        into = d @ self.w["out"].T
        g["embed"] = np.zeros_like(self.w["embed"])
        h = self.hidden
        for side, kept, own in (("f", kf, into[:, :, :h]), ("b", kb, into[:, :, h:])):
            dz = np.zeros((VOCABULARY, 4 * h), np.float32)
            dh = np.zeros_like(self.w["h" + side])
            later, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, i, f, o, c, squashed, before, was in reversed(kept):
                state = own[t] + later
                cell = cell + state * o * (1 - squashed**2)
                z = np.concatenate([cell * c * i * (1 - i), cell * was * f * (1 - f), state * squashed * o * (1 - o), cell * i * (1 - c**2)], axis=1)
                cell = cell * f
                later = z @ self.w["h" + side].T
                dh += before.T @ z
                np.add.at(dz, ids[t], z)
            g["h" + side], g["c" + side] = dh, dz.sum(0)
            g["x" + side] = self.w["embed"].T @ dz
            g["embed"] += dz @ self.w["x" + side].T
        return float((total - picked).sum() / n), {name: v / n for name, v in g.items()}

    def train(self, ids: np.ndarray, gold: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.02) -> list[float]:
        """Fit windows (windows, time) and their tags; returns each epoch's mean loss."""
        rng = np.random.default_rng(self.seed)
        first = {n: np.zeros_like(v) for n, v in self.w.items()}
        second = {n: np.zeros_like(v) for n, v in self.w.items()}
        step, losses = 0, []
        steps = epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            order, seen = rng.permutation(len(ids)), []
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                loss, g = self.gradients(ids[pick].T, gold[pick].T)
                seen.append(loss)
                step += 1
                norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
                pace = rate * min(1.0, 2 * (1 - step / steps) + 0.02) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for name, v in g.items():
                    v = v * min(1.0, 5.0 / (norm + 1e-9))
                    first[name] += 0.1 * (v - first[name])
                    second[name] += 0.001 * (v**2 - second[name])
                    self.w[name] -= (pace * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tags of windows (windows, time) by Viterbi."""
        scores = self.emissions(ids.T)[0]
        time, n, k = scores.shape
        best, back = scores[0] + self.w["start"], np.zeros((time, n, k), np.int8)
        for t in range(1, time):
            each = best[:, :, None] + self.w["move"]
            back[t] = each.argmax(1)
            best = each.max(1) + scores[t]
        out = np.empty((time, n), np.int64)
        out[-1] = best.argmax(1)
        for t in range(time - 1, 0, -1):
            out[t - 1] = back[t][np.arange(n), out[t]]
        return out.T
