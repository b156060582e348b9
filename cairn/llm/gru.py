"""A gated recurrent language model in numpy: forward, truncated backpropagation, class-factored softmax.

The state before a word gives P(class) by a softmax over all classes, and, for the ``head`` classes (blocks of
``BLOCK`` frequent words), P(word | class) by a softmax over the block.  Words of the other classes have a fixed
share of their class.  Word ids of the head come first, ``BLOCK`` ids a class; id ``head + j`` stands for any word
of the j-th other class (its share is not the model's concern).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN = 12
BLOCK = 64
WINDOW = 32
_ROWS = 8192
_F = np.float32


@dataclass
class Gru:
    """Parameters by name; ``head`` words in ``blocks`` classes, then ``others`` classes."""

    p: dict[str, np.ndarray]
    blocks: int
    others: int

    @staticmethod
    def fresh(unigrams: np.ndarray, blocks: int, seed: int = 1) -> Gru:
        """Starts as the unigram model; ``unigrams`` has a share for each id (blocks * BLOCK, then the others)."""
        rng, others, h = np.random.default_rng(seed), len(unigrams) - blocks * BLOCK, HIDDEN
        u = np.maximum(unigrams, 1e-9)
        head = u[: blocks * BLOCK].reshape(blocks, BLOCK)
        classes = np.concatenate([head.sum(axis=1), u[blocks * BLOCK :]])
        noise = lambda *s: rng.normal(0, 1, s).astype(_F)
        return Gru(
            {
                "in": noise(len(u), 3 * h) * _F(0.3),
                "b": np.concatenate([np.full(h, -1.0), np.zeros(2 * h)]).astype(_F),
                "rec": noise(h, 3 * h) * _F(0.7 / np.sqrt(h)),
                "cls": noise(h, blocks + others) * _F(0.05),
                "cls_b": np.log(classes / classes.sum()).astype(_F),
                "word": noise(blocks, h, BLOCK) * _F(0.05),
                "word_b": np.log(head / head.sum(axis=1, keepdims=True)).astype(_F),
            },
            blocks,
            others,
        )

    def classes_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.blocks * BLOCK, ids // BLOCK, ids - self.blocks * (BLOCK - 1))

    def step(self, ids: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, and what backpropagation needs (gate, reset, candidate, reset state)."""
        h = HIDDEN
        x = self.p["in"][ids] + self.p["b"]
        zr = _sigmoid(x[:, : 2 * h] + state @ self.p["rec"][:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        rs = r * state
        c = np.tanh(x[:, 2 * h :] + rs @ self.p["rec"][:, 2 * h :])
        return state + z * (c - state), z, r, c, rs

    def by_block(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of head words by their class, and where each class starts and ends among them."""
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cut = np.searchsorted(cls[order], np.arange(self.blocks + 1))
        return order[: cut[-1]], cut

    def word_logits(self, states: np.ndarray, cls: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Logits of the words of each row's block; rows are sorted by block."""
        out = np.empty((len(states), BLOCK), _F)
        for k in np.flatnonzero(np.diff(cut)):
            np.matmul(states[cut[k] : cut[k + 1]], self.p["word"][k], out=out[cut[k] : cut[k + 1]])
        out += self.p["word_b"][cls]
        return out

    def log_likelihood(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each id (head word, or other class) after its state."""
        out = np.empty(len(ids), _F)
        cls = self.classes_of(ids)
        for at in range(0, len(ids), _ROWS):
            s, c = states[at : at + _ROWS], cls[at : at + _ROWS]
            logits = s @ self.p["cls"] + self.p["cls_b"]
            out[at : at + _ROWS] = logits[np.arange(len(c)), c] - _log_sum(logits)
        order, cut = self.by_block(cls)
        for at in range(0, len(order), _ROWS):
            rows = order[at : at + _ROWS]
            logits = self.word_logits(states[rows], cls[rows], np.clip(cut - at, 0, len(rows)))
            out[rows] += logits[np.arange(len(rows)), ids[rows] - cls[rows] * BLOCK] - _log_sum(logits)
        return out


def _sigmoid(x):
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _log_sum(x):
    """log of the sum of exponentials by row; logits stay far below the range of float32."""
    return np.log(np.exp(np.minimum(x, _F(80))).sum(axis=1))


def _softmax(x):
    """By row, in place; logits stay far below the range of float32."""
    np.exp(np.minimum(x, 80, out=x), out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def score_documents(model: Gru, ids: np.ndarray, lengths: np.ndarray, lanes: int = 1024) -> np.ndarray:
    """Natural log-likelihood of each document; ``ids`` holds their ids end to end.

    Documents run side by side, longest first, in windows of ``WINDOW`` words; the state is carried from window to
    window until the document ends, so the whole document conditions each word.
    """
    total = np.zeros(len(lengths))
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    for first in range(0, len(order), lanes):
        docs = order[first : first + lanes]
        size, start = lengths[docs], offsets[docs]
        state = np.zeros((len(docs), HIDDEN), _F)
        for t0 in range(0, int(size[0]) if len(size) else 0, WINDOW):
            states, words, owners = [], [], []
            for t in range(t0, min(t0 + WINDOW, int(size[0]))):
                live = int(np.searchsorted(-size, -t, side="left"))  # documents longer than t
                state = state[:live]
                w = ids[start[:live] + t]
                states.append(state)
                words.append(w)
                owners.append(live)
                state = model.step(w, state)[0]
            ll = model.log_likelihood(np.concatenate(states), np.concatenate(words))
            at = 0
            for live in owners:
                total[docs[:live]] += ll[at : at + live]
                at += live
    return total


class Trainer:
    """Adam on windows of equal length; the state is carried, the gradient is cut at each window's start."""

    def __init__(self, model: Gru, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}

    def window(self, ids: np.ndarray, state: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
        """One update from ``ids`` (lanes, words); returns the carried state.

        ``live``, where given, marks the words; what follows a lane's last one adds nothing.
        """
        p, h = self.model.p, HIDDEN
        lanes, steps = ids.shape
        rec_zr, rec_c = np.ascontiguousarray(p["rec"][:, : 2 * h]), np.ascontiguousarray(p["rec"][:, 2 * h :])
        x = p["in"][ids.T] + p["b"]
        states = np.empty((steps + 1, lanes, h), _F)
        zr, c, rs = np.empty((steps, lanes, 2 * h), _F), np.empty((steps, lanes, h), _F), np.empty((steps, lanes, h), _F)
        states[0] = state
        for t in range(steps):
            old = states[t]
            zr[t] = _sigmoid(x[t, :, : 2 * h] + old @ rec_zr)
            np.multiply(zr[t, :, h:], old, out=rs[t])
            np.tanh(x[t, :, 2 * h :] + rs[t] @ rec_c, out=c[t])
            np.add(old, zr[t, :, :h] * (c[t] - old), out=states[t + 1])
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        flat, words = states[:-1].reshape(-1, h), ids.T.ravel()
        if live is None or live.all():
            n, d_states = lanes * steps, self._output(flat, words, grad)
        else:
            there = np.flatnonzero(live.T)
            n, d_states = len(there), np.zeros_like(flat)
            d_states[there] = self._output(flat[there], words[there], grad)
        d_states = d_states.reshape(steps, lanes, h)
        # What the gradient is multiplied by on its way back through each gate, for all steps at once.
        z, r, before = zr[:, :, :h], zr[:, :, h:], states[:-1]
        stay = 1 - z
        to_c, to_z, to_r = z * (1 - c * c), (c - before) * z * stay, before * r * (1 - r)
        back_zr, back_c = rec_zr.T.copy(), rec_c.T.copy()
        d, d_in = np.zeros((lanes, h), _F), np.empty((steps, lanes, 3 * h), _F)
        for t in range(steps - 1, -1, -1):
            here = d_in[t]
            np.multiply(d, to_z[t], out=here[:, :h])
            np.multiply(d, to_c[t], out=here[:, 2 * h :])
            d_rs = here[:, 2 * h :] @ back_c
            np.multiply(d_rs, to_r[t], out=here[:, h : 2 * h])
            d *= stay[t]
            d_rs *= r[t]
            d += d_rs
            d += here[:, : 2 * h] @ back_zr
            d += d_states[t]
        rows = d_in.reshape(-1, 3 * h)
        grad["rec"][:, : 2 * h] = flat.T @ rows[:, : 2 * h]
        grad["rec"][:, 2 * h :] = rs.reshape(-1, h).T @ rows[:, 2 * h :]
        grad["b"] += rows.sum(axis=0)
        order = np.argsort(words.astype(np.int16), kind="stable") if len(p["in"]) < 1 << 15 else np.argsort(words, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], words[order][1:] != words[order][:-1]]))
        grad["in"][words[order[first]]] = np.add.reduceat(rows[order], first, axis=0)
        self._update(grad, n)
        return states[-1]

    def _output(self, states, words, grad):
        g, p = self.model, self.model.p
        cls = g.classes_of(words)
        e = states @ p["cls"]
        e += p["cls_b"]
        _softmax(e)
        e[np.arange(len(cls)), cls] -= 1
        grad["cls"] += states.T @ e
        grad["cls_b"] += e.sum(axis=0)
        d = e @ p["cls"].T
        order, cut = g.by_block(cls)
        if len(order):
            s, mine = states[order], cls[order]
            e = _softmax(g.word_logits(s, mine, cut))
            e[np.arange(len(order)), words[order] - mine * BLOCK] -= 1
            used = np.flatnonzero(np.diff(cut))
            grad["word_b"][used] += np.add.reduceat(e, cut[used], axis=0)
            back = np.empty_like(s)
            for k in used:
                part = e[cut[k] : cut[k + 1]]
                np.matmul(s[cut[k] : cut[k + 1]].T, part, out=grad["word"][k])
                np.matmul(part, p["word"][k].T, out=back[cut[k] : cut[k + 1]])
            d[order] += back
        return d

    def _update(self, grad, n):
        self.t += 1
        scale = _F(1 / n)
        a = self.rate * np.sqrt(1 - 0.98**self.t) / (1 - 0.9**self.t)
        for k, x in self.model.p.items():
            g, m, v = grad[k], self.m[k], self.v[k]
            g *= scale
            m *= _F(0.9)
            m += _F(0.1) * g
            v *= _F(0.98)
            g *= g
            g *= _F(0.02)
            v += g
            np.sqrt(v, out=g)
            g += _F(1e-5)
            np.divide(m, g, out=g)
            g *= _F(a)
            x -= g
