"""A gated recurrent language model in numpy with a class-factored output.

Words of the shortlist are in classes of PER_CLASS by rank; the probability of one is that of its
class, a softmax of the state, times that within the class, another softmax of the state. All other
words are in TAIL classes, within which their corpus shares hold. Biases start at the logarithms of
corpus counts, so an untrained model is the unigram model.

Texts are laid end to end on parallel streams; the state is set to zero where a text begins and
carried from window to window, so a text's likelihood is complete however long it is.
"""

from __future__ import annotations

import numpy as np

HIDDEN, PER_CLASS, TAIL = 16, 32, 32
#: Adam: step, decay of the mean gradient and of its mean square.
RATE, MEAN, SQUARE = 0.01, 0.9, 0.99
F32 = np.float32


def layout(words: int) -> dict[str, tuple[int, ...]]:
    classes = -(-words // PER_CLASS) + TAIL
    return {"gates": (words + TAIL + 1, 3 * HIDDEN), "again": (HIDDEN, 3 * HIDDEN), "to_class": (HIDDEN, classes), "class_bias": (classes,), "to_word": (words, HIDDEN), "word_bias": (words,)}


def start(counts: np.ndarray, tail_mass: np.ndarray, seed: int = 1) -> np.ndarray:
    """Parameters as one flat array: shortlist counts in falling order, and the TAIL classes' counts."""
    rng, words = np.random.default_rng(seed), len(counts)
    heads = [counts[i : i + PER_CLASS].sum() for i in range(0, words, PER_CLASS)]
    p = {k: np.zeros(s, F32) for k, s in layout(words).items()}
    p["gates"] += rng.normal(0, 0.3, p["gates"].shape).astype(F32)
    p["again"] += rng.normal(0, HIDDEN**-0.5, p["again"].shape).astype(F32)
    p["to_class"] += rng.normal(0, 0.05, p["to_class"].shape).astype(F32)
    p["to_word"] += rng.normal(0, 0.05, p["to_word"].shape).astype(F32)
    p["class_bias"] += np.log(np.r_[heads, tail_mass] + 1e-3).astype(F32)
    p["class_bias"] -= p["class_bias"].max(initial=0)
    p["word_bias"] += np.log(counts + 0.1).astype(F32)
    return np.concatenate([p[k].ravel() for k in p])


def views(flat: np.ndarray, words: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in layout(words).items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def streams(ids: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Lays texts ids[first[i]:first[i+1]] on up to `most` streams, longest text first, each to the shortest
    stream. Returns the streams' lengths in falling order, and for each token of a stream its place in ids,
    streams one after another."""
    n = np.diff(first)
    texts = np.argsort(-n, kind="stable")
    k = max(1, min(most, len(texts)))
    own: list[list[int]] = [[] for _ in range(k)]
    size = np.zeros(k, np.int64)
    for a in range(0, len(texts), k):  # a round gives each stream one text, the longest to the shortest stream
        part = texts[a : a + k]
        to = np.argsort(size, kind="stable")[: len(part)]
        size[to] += n[part]
        for t, s in zip(part.tolist(), to.tolist()):
            own[s].append(t)
    order = np.argsort(-size, kind="stable")
    line = [t for s in order.tolist() for t in own[s]]
    starts, lens = first[line], n[line]
    place = np.repeat(starts - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(int(lens.sum()))
    return size[order], place


def _softmax(x: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Turns logits into probabilities over the first axis, in place; returns the log probabilities at own."""
    x -= x.max(0)
    lp = x[own]
    np.exp(x, out=x)
    total = x.sum(0)
    x /= total
    return lp - np.log(total)


class Model:
    """Gates are (1 + tanh) / 2. Outputs are computed with words or classes along the first axis, so that numpy's
    inner loops run over tokens."""

    def __init__(self, flat: np.ndarray, words: int) -> None:
        self.words, self.flat = words, flat.astype(F32)
        self.p = views(self.flat, words)
        self.heads = -(-words // PER_CLASS)

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.words, ids // PER_CLASS, ids - self.words + self.heads)

    def forward(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """inputs, fresh (the text begins here): steps x streams. Returns the states, steps x streams x HIDDEN."""
        out = np.empty((*inputs.shape, HIDDEN), F32)
        gates, again, on = np.take(self.p["gates"], inputs, axis=0), self.p["again"], (~fresh).astype(F32)[:, :, None]
        for t in range(len(inputs)):
            h = h * on[t]
            a, g = h @ again, gates[t]
            zr = np.tanh(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            zr += F32(1)
            zr *= F32(0.5)
            z, r, back = zr[:, :HIDDEN], zr[:, HIDDEN:], a[:, 2 * HIDDEN :]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * back)
            less = h - n
            if keep is not None:
                keep.append((h, z, r, n, back, less))
            h = np.add(n, z * less, out=out[t])
        return out

    def log_p(self, h: np.ndarray, ids: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of P(class) * P(word | class) for shortlist words, of P(class) for others; with grad, adds
        the gradients of the negative sum and returns that of h."""
        c, at = self.class_of(ids), np.arange(len(ids))
        order = np.argsort(c.astype(np.int16), kind="stable")
        h, ids, c = h[order], ids[order], c[order]
        d = self.p["to_class"].T @ h.T
        d += self.p["class_bias"][:, None]
        out, dh, own = np.empty(len(ids)), None, _softmax(d, (c, at)).astype(np.float64)
        if grad is not None:
            d[c, at] -= 1
            grad["to_class"] += (d @ h).T
            grad["class_bias"] += d.sum(1)
            dh = d.T @ self.p["to_class"].T
        bound = np.searchsorted(c, np.arange(self.heads + 1))
        for k in np.flatnonzero(np.diff(bound)):
            i, a, b = slice(bound[k], bound[k + 1]), k * PER_CLASS, min((k + 1) * PER_CLASS, self.words)
            w = self.p["to_word"][a:b]
            d = w @ h[i].T
            d += self.p["word_bias"][a:b, None]
            j, word = at[: bound[k + 1] - bound[k]], ids[i] - a
            own[i] += _softmax(d, (word, j))
            if grad is not None:
                d[word, j] -= 1
                grad["to_word"][a:b] += d @ h[i]
                grad["word_bias"][a:b] += d.sum(1)
                dh[i] += d.T @ w
        out[order] = own
        if grad is not None:
            back = np.empty_like(dh)
            back[order] = dh
            dh = back
        return out, dh

    def _windows(self, ids: np.ndarray, first: np.ndarray, most: int, steps: int, piece: int | None = None):
        """Windows over the streams: input ids, targets, where the state starts afresh, the targets' places, which
        places are real, and how many streams go on. Pieces of a longer text start afresh after the word before them."""
        begins = np.zeros(len(ids), bool)
        begins[first[:-1][np.diff(first) > 0]] = True
        inputs = np.where(begins, self.words + TAIL, ids[np.arange(len(ids)) - 1]) if len(ids) else ids
        if piece:
            n = np.diff(first)
            parts = np.maximum(1, -(-n // piece))
            first = np.r_[np.repeat(first[:-1], parts) + piece * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)), len(ids)]
            begins[first[:-1][np.diff(first) > 0]] = True
        size, place = streams(ids, first, most)
        offset = np.r_[0, np.cumsum(size)[:-1]]
        for a in range(0, int(size[0]) if len(size) else 0, steps):
            t = np.arange(a, min(a + steps, int(size[0])))[:, None]
            live = int((size > a).sum())
            inside = t < size[None, :live]
            at = place[np.where(inside, offset[None, :live] + t, 0)]
            yield inputs[at], ids[at], begins[at], at, inside, live

    def score(self, ids: np.ndarray, first: np.ndarray, most: int = 384, steps: int = 32) -> np.ndarray:
        """log_p of every token."""
        out = np.zeros(len(ids))
        h = np.zeros((most, HIDDEN), F32)
        for before, target, fresh, at, inside, live in self._windows(ids, first, most, steps):
            states = self.forward(before, fresh, h[:live])
            h = states[-1]
            out[at[inside]] = self.log_p(states[inside], target[inside])[0]
        return out

    def gradients(self, before: np.ndarray, target: np.ndarray, fresh: np.ndarray, inside: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """Of a window's negative log-likelihood: of every parameter, of "gates" only for the words of the second
        result; and the last state."""
        tape: list = []
        states = self.forward(before, fresh, h, tape)
        grad = {k: np.zeros(v.shape, F32) for k, v in self.p.items() if k != "gates"}
        d_all = np.zeros(states.shape, F32)
        d_all[inside] = self.log_p(states[inside], target[inside], grad)[1]
        into, back_grad = np.empty((*before.shape, 3 * HIDDEN), F32), np.zeros((before.shape[1], HIDDEN), F32)
        on, turned = (~fresh).astype(F32)[:, :, None], np.ascontiguousarray(self.p["again"].T)
        through = np.empty((before.shape[1], 3 * HIDDEN), F32)
        for t in range(len(before) - 1, -1, -1):
            h0, z, r, n, back, less = tape[t]
            d = d_all[t]
            d += back_grad
            dz = d * z
            back_grad = dz.copy()
            dn = (d - dz) * (1 - n * n)
            dz *= less
            dz *= 1 - z
            dz *= F32(2)
            dr = dn * back
            dr *= r * (1 - r)
            dr *= F32(2)
            part = into[t]
            part[:, :HIDDEN], part[:, HIDDEN : 2 * HIDDEN], part[:, 2 * HIDDEN :] = dz, dr, dn
            through[:, :HIDDEN], through[:, HIDDEN : 2 * HIDDEN], through[:, 2 * HIDDEN :] = dz, dr, dn * r
            grad["again"] += h0.T @ through
            back_grad += through @ turned
            back_grad *= on[t]
        rows = before.ravel()
        order = np.argsort(rows.astype(np.int16), kind="stable")
        node, at = np.unique(rows[order], return_index=True)
        grad["gates"] = np.add.reduceat(into.reshape(-1, 3 * HIDDEN)[order], at)
        return grad, node, states[-1]

    def train(self, ids: np.ndarray, first: np.ndarray, rate: float = RATE, most: int = 192, steps: int = 16, piece: int = 512) -> None:
        """One pass of truncated backpropagation with Adam steps, over pieces of the texts; an input word's gates move when it occurs."""
        m, v = ({k: np.zeros(x.shape, F32) for k, x in self.p.items()} for _ in range(2))
        h, count = np.zeros((most, HIDDEN), F32), 0
        for before, target, fresh, _, inside, live in self._windows(ids, first, most, steps, piece):
            grad, node, h = self.gradients(before, target, fresh, inside, h[:live])
            count += 1
            step = F32(rate * np.sqrt(1 - SQUARE**count) / (1 - MEAN**count))
            for k, x in self.p.items():
                g, at = grad[k], node if k == "gates" else slice(None)
                g *= F32(1 / max(1, int(inside.sum())))
                m[k][at] = F32(MEAN) * m[k][at] + F32(1 - MEAN) * g
                v[k][at] = F32(SQUARE) * v[k][at] + F32(1 - SQUARE) * g * g
                x[at] -= step * m[k][at] / (np.sqrt(v[k][at]) + F32(1e-6))
