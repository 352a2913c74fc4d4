"""A gated recurrent language model with a class-factored softmax, in numpy.

A token is a class and, in the classes of frequent words, a word of its class. The state after the tokens so
far gives a distribution over classes and, inside a class of frequent words, over its words. What lies in the
other classes is left to the caller. Biases start as the logarithms of counts, so that the untrained model is
the unigram model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

HIDDEN, WIDTH, STREAMS, STEPS = 24, 3 * 24, 64, 16
RATE, BETA1, BETA2, CLIP = 0.004, 0.9, 0.99, 1.0
#: States that the softmax takes at a time in scoring.
ROWS = 1 << 15
#: States whose classes' scores, and parameters whose moments, stay in a processor's cache.
CACHED, BLOCK = 1 << 11, 1 << 13
#: Logarithms of weights up to this size, of either sign, and their sums are far from the limits of single precision.
RANGE = 60


def sigmoid(x: np.ndarray) -> np.ndarray:
    """``1 / (1 + exp(-x))``, in the place of ``x``."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def softmax(x: np.ndarray, bounded: bool) -> np.ndarray:
    """The softmax of every column, in the place of ``x``: sums over the first axis run along the memory.

    ``bounded``: no value leaves ``RANGE``, so the greatest one need not be taken off."""
    if not bounded:
        x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def chosen(x: np.ndarray, rows: np.ndarray, bounded: bool) -> np.ndarray:
    """Of every column the log softmax in its row of ``rows``; overwrites ``x``."""
    if not bounded:
        x -= x.max(axis=0)
    at = x[rows, np.arange(x.shape[1])]
    np.exp(x, out=x)
    return at - np.log(x.sum(axis=0))


class Gru:
    """Parameters as one vector with named views; ``c`` and ``cb`` lie side by side in ``cs``, ``w`` and ``wb`` in ``ws``, so that a
    product with states and a column of ones takes the biases in.

    ``bounds``: class ``c`` of frequent words holds the words ``bounds[c]`` to ``bounds[c + 1]``; classes behind these have no
    words here. Input ids are the words, then the other classes, then the start of a text.
    """

    def __init__(self, bounds: list[int], classes: int):
        self.bounds, self.classes = np.asarray(bounds), classes
        self.words, self.headed = int(bounds[-1]), len(bounds) - 1
        self.start = self.words + classes - self.headed
        shapes = {"x": (self.start + 1, WIDTH), "u": (HIDDEN, WIDTH), "cs": (classes, HIDDEN + 1), "ws": (self.words, HIDDEN + 1)}
        self.shapes = shapes
        self.vector = np.zeros(sum(int(np.prod(s)) for s in shapes.values()), np.float32)
        self.set(self.vector)

    def views(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            out[name] = vector[at : at + size].reshape(shape)
            at += size
        for name in ("c", "w"):
            out[name], out[name + "b"] = out[name + "s"][:, :HIDDEN], out[name + "s"][:, HIDDEN]
        return out

    def set(self, vector: np.ndarray) -> None:
        self.vector = vector.astype(np.float32)
        self.p = self.views(self.vector)

    def begin(self, class_counts: np.ndarray, word_counts: np.ndarray) -> None:
        """Small random weights; biases from counts."""
        random = np.random.default_rng(7)
        for name in ("x", "u", "c", "w"):
            self.p[name][:] = random.normal(0, 0.1, self.p[name].shape)
        self.p["cb"][:] = np.log(class_counts + 1)
        self.p["wb"][:] = np.log(word_counts + 1)

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        gx, gh = self.p["x"][x], h @ self.p["u"]
        gates = sigmoid(gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
        n = gates[:, :HIDDEN] * gh[:, 2 * HIDDEN :]
        n += gx[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        out = h - n
        out *= gates[:, HIDDEN:]
        out += n
        return out

    def log_probs(self, states: np.ndarray, classes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural logarithm of class times, where ``words`` isn't negative, word within the class."""
        out = np.empty(len(states), np.float32)
        bounded = self.bounded()
        for a in range(0, len(states), ROWS):
            s, c = np.ones((len(states[a : a + ROWS]), HIDDEN + 1), np.float32), classes[a : a + ROWS]
            s[:, :HIDDEN] = states[a : a + ROWS]
            part = out[a : a + ROWS]
            for i in range(0, len(s), CACHED):
                part[i : i + CACHED] = chosen(self.p["cs"] @ s[i : i + CACHED].T, c[i : i + CACHED], bounded)
            order, s, w, edges = self.by_class(s, c, words[a : a + ROWS])
            for k, at, low, high in self.spans(edges):
                part[order[at]] += chosen(self.p["ws"][low:high] @ s[at].T, w[at] - low, bounded)
        return out

    def bounded(self) -> bool:
        """Whether no score can leave ``RANGE``; states lie between -1 and 1."""
        return all((np.abs(self.p[name]) @ np.ones(HIDDEN + 1, np.float32)).max(initial=0) < RANGE for name in ("cs", "ws"))

    def spans(self, edges: np.ndarray) -> Iterator[tuple[int, slice, int, int]]:
        """The classes of more than one word that occur, with their tokens in the order of ``by_class`` and their words."""
        for k in np.flatnonzero((np.diff(edges) > 0) & (np.diff(self.bounds) > 1)).tolist():
            yield k, slice(edges[k], edges[k + 1]), self.bounds[k], self.bounds[k + 1]

    def by_class(self, states: np.ndarray, classes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The order of the tokens in classes of frequent words by class, their states and words so, and where each class starts and the last ends."""
        order = np.argsort(classes.astype(np.int16), kind="stable")
        edges = np.searchsorted(classes[order], np.arange(self.headed + 1))
        order = order[: edges[-1]]
        return order, states[order], words[order], edges

    def score(self, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log-likelihood of whole documents, each given as input ids, classes and words of its tokens.

        All documents advance together; the state goes on from one window of ``STEPS`` tokens to the next.
        """
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i][0]))
        sizes = np.array([len(docs[i][0]) for i in order])
        if not len(sizes):
            return np.zeros(0)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        x, c, w = (np.concatenate([docs[i][k] for i in order]) for k in range(3))
        total = np.zeros(len(docs))
        h = np.zeros((len(docs), HIDDEN), np.float32)
        previous = np.full(len(docs), self.start)
        active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")  # documents longer than t
        for begin in range(0, int(sizes[0]), STEPS):
            states, places, owners = [], [], []
            for t in range(begin, min(begin + STEPS, int(sizes[0]))):
                n = int(active[t])
                h[:n] = self.step(previous[:n], h[:n])
                states.append(h[:n].copy())
                places.append(starts[:n] + t)
                owners.append(np.arange(n))
                previous[:n] = x[places[-1]]
            place = np.concatenate(places)
            total += np.bincount(np.concatenate(owners), self.log_probs(np.concatenate(states), c[place], w[place]), len(docs))
        out = np.empty(len(docs))
        out[order] = total
        return out

    def train(self, x: np.ndarray, classes: np.ndarray, words: np.ndarray, fresh: np.ndarray) -> None:
        """One pass of truncated backpropagation over a sequence of documents; ``fresh`` marks first tokens."""
        streams = max(1, min(STREAMS, len(x) // (2 * STEPS)))
        whole = len(x) // streams * streams
        inputs = np.concatenate([[self.start], x[:-1]])
        inputs[fresh] = self.start
        m, v, n = np.zeros_like(self.vector), np.zeros_like(self.vector), 0
        # the tokens that the streams leave over, fewer than there are streams, are one more
        for a, b, streams in ((0, whole, streams), (whole, len(x), 1)):
            cut = lambda v: v[a:b].reshape(streams, -1).T  # noqa: B023, E731
            block = cut(inputs), cut(classes), cut(words), cut(fresh).copy()
            block[3][:1] = True
            h = np.zeros((streams, HIDDEN), np.float32)
            for t in range(0, len(block[0]), STEPS):
                gradient, h = self.window(*(x[t : t + STEPS] for x in block), h)
                norm = float(np.sqrt(gradient @ gradient))
                if norm > CLIP:
                    gradient *= CLIP / norm
                n += 1
                self.adapt(gradient, m, v, n)

    def adapt(self, gradient: np.ndarray, m: np.ndarray, v: np.ndarray, n: int) -> None:
        """The ``n``-th step of Adam; overwrites ``gradient``. Both moments lack the same second root, so it is taken into the rate."""
        root = np.sqrt(1 - BETA2**n)
        rate, least = RATE * root / (1 - BETA1**n), 1e-6 * root
        part = np.empty(BLOCK, gradient.dtype)
        for a in range(0, len(gradient), BLOCK):
            g, p, q, x = (y[a : a + BLOCK] for y in (gradient, m, v, self.vector))
            d = part[: len(g)]
            np.subtract(g, p, out=d)
            d *= 1 - BETA1
            p += d
            g *= g
            g -= q
            g *= 1 - BETA2
            q += g
            np.sqrt(q, out=d)
            d += least
            np.divide(p, d, out=d)
            d *= rate
            x -= d

    def window(self, inputs, classes, words, fresh, h) -> tuple[np.ndarray, np.ndarray]:
        """The mean gradient over one window, and the state behind it."""
        p, (steps, streams), count = self.p, inputs.shape, inputs.size
        kind, two = self.vector.dtype, 2 * HIDDEN
        gx = p["x"][inputs]
        # states before and behind each step, gates (r, z), candidates (n) and what of these comes from the state
        before, n, gn = (np.empty((steps, streams, HIDDEN), kind) for _ in range(3))
        wide = np.ones((steps, streams, HIDDEN + 1), kind)
        states = wide[:, :, :HIDDEN]
        gates = np.empty((steps, streams, two), kind)
        starts = fresh.any(axis=1)
        for t in range(steps):
            before[t] = np.where(fresh[t][:, None], 0, h) if starts[t] else h
            gh = before[t] @ p["u"]
            gates[t] = gh[:, :two]
            gates[t] += gx[t, :, :two]
            sigmoid(gates[t])
            gn[t] = gh[:, two:]
            np.multiply(gates[t, :, :HIDDEN], gn[t], out=n[t])
            n[t] += gx[t, :, two:]
            np.tanh(n[t], out=n[t])
            np.subtract(before[t], n[t], out=states[t])
            states[t] *= gates[t, :, HIDDEN:]
            states[t] += n[t]
            h = states[t]
        s, c, w = wide.reshape(count, HIDDEN + 1), classes.ravel(), words.ravel()
        gradient, bounded = np.zeros_like(self.vector), self.bounded()
        g = self.views(gradient)
        error = softmax(p["cs"] @ s.T, bounded)
        error[c, np.arange(count)] -= 1
        np.matmul(error, s, out=g["cs"])
        back = error.T @ p["c"]
        order, s, w, edges = self.by_class(s, c, w)
        inner, each = np.zeros((len(order), HIDDEN), kind), np.arange(len(order))
        for _, at, low, high in self.spans(edges):
            error = softmax(p["ws"][low:high] @ s[at].T, bounded)
            error[w[at] - low, each[: at.stop - at.start]] -= 1
            np.matmul(error, s[at], out=g["ws"][low:high])
            np.matmul(error.T, p["w"][low:high], out=inner[at])
        back[order] += inner
        for x in (g["cs"], g["ws"], back):
            x /= count
        back = back.reshape(steps, streams, HIDDEN)
        # what a step's gradient is multiplied with, for all steps at once
        r, z = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
        by_n, by_r, by_z = (1 - z) * (1 - n * n), gn * r * (1 - r), (before - n) * z * (1 - z)
        dh, dx, du = np.zeros((streams, HIDDEN), kind), np.empty((steps, streams, WIDTH), kind), np.empty((steps, streams, WIDTH), kind)
        for t in reversed(range(steps)):
            dh += back[t]
            dn = dx[t, :, two:]
            np.multiply(dh, by_n[t], out=dn)
            np.multiply(dn, by_r[t], out=dx[t, :, :HIDDEN])
            np.multiply(dh, by_z[t], out=dx[t, :, HIDDEN:two])
            du[t, :, :two] = dx[t, :, :two]
            np.multiply(dn, r[t], out=du[t, :, two:])
            dh *= z[t]
            dh += du[t] @ p["u"].T
            if starts[t]:
                dh[fresh[t]] = 0
        g["u"][:] = before.reshape(count, HIDDEN).T @ du.reshape(count, WIDTH)
        ids, dx = inputs.ravel(), dx.reshape(count, WIDTH)
        order = np.argsort(ids, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) > 0]))
        g["x"][ids[order][heads]] = np.add.reduceat(dx[order], heads)
        return gradient, states[-1].copy()
