"""A gated recurrent language model in numpy, trained and applied on Spark.

One layer of gated units reads a text token by token. Its output is factored:
first the class of the next token, then the token within its class. Training is
truncated back-propagation over windows; the state goes on from window to window
and starts anew with each text. Executors train on their own texts from one
common start, and the models are averaged, weighted by tokens, once per round.
Scoring carries the state through whole texts, many texts side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Shape:
    words: int  # ids 0 (end of text) to words - 2 are tokens, words - 1 is all others
    hidden: int
    per_class: int

    @property
    def classes(self) -> int:
        return -(-self.words // self.per_class)

    def sizes(self) -> list[tuple[int, ...]]:
        v, h, c = self.words, self.hidden, self.classes
        return [(v, 3 * h), (h, 3 * h), (h, c), (c,), (v, h), (v,)]


def unpack(flat: np.ndarray, shape: Shape) -> list[np.ndarray]:
    out, at = [], 0
    for s in shape.sizes():
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def start(shape: Shape, counts: np.ndarray, seed: int) -> np.ndarray:
    """Small random weights; output biases that give every token its share."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 0.1, s).astype(np.float32) for s in shape.sizes()]
    share = (counts + 0.5) / (counts + 0.5).sum()
    mass = np.add.reduceat(share, np.arange(0, shape.words, shape.per_class))
    parts[3], parts[5] = np.log(mass), np.log(share)
    parts[4] = parts[4] * 0.1
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.maximum(x, -30)  # beyond, the exponential grows out of range
    np.negative(y, out=y)
    np.exp(y, out=y)
    y += 1
    return np.reciprocal(y, out=y)


def _step(x: np.ndarray, h: np.ndarray, u: np.ndarray):
    k = h.shape[1]
    a = h @ u
    gates = _sigmoid(x[:, : 2 * k] + a[:, : 2 * k])
    r, z = gates[:, :k], gates[:, k:]
    n = np.tanh(x[:, 2 * k :] + r * a[:, 2 * k :])
    return n + z * (h - n), r, z, n, a[:, 2 * k :]


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def _outputs(h: np.ndarray, target: np.ndarray, p: list[np.ndarray], shape: Shape, grad: list | None = None):
    """Natural log-probability of each target; with ``grad``, also the gradient of
    their sum towards ``h``, and the weights' gradients are added."""
    _, _, wc, bc, wo, bo = p
    cls = target // shape.per_class
    rows = np.arange(len(h))
    x = h @ wc + bc
    out = x[rows, cls]
    total = _log_sum(x)
    out = out - total
    if grad is not None:
        d = -np.exp(x - total[:, None])
        d[rows, cls] += 1
        grad[2] += h.T @ d
        grad[3] += d.sum(0)
        dh = d @ wc.T
    order = np.argsort(cls, kind="stable")
    edges = np.searchsorted(cls[order], np.arange(shape.classes + 1))
    for c in np.flatnonzero(np.diff(edges)):
        at = order[edges[c] : edges[c + 1]]
        lo, hi = c * shape.per_class, min(shape.words, (c + 1) * shape.per_class)
        hc = h[at]
        x = hc @ wo[lo:hi].T + bo[lo:hi]
        total = _log_sum(x)
        mine = (np.arange(len(at)), target[at] - lo)
        out[at] += x[mine] - total
        if grad is not None:
            d = -np.exp(x - total[:, None])
            d[mine] += 1
            grad[4][lo:hi] += d.T @ hc
            grad[5][lo:hi] += d.sum(0)
            dh[at] += d @ wo[lo:hi]
    return out if grad is None else (out, dh)


def _logs(h: np.ndarray, target: np.ndarray, p: list[np.ndarray], shape: Shape) -> np.ndarray:
    """The log-probabilities of ``_outputs`` alone. Rows are sorted by class once, so a
    class is a slice, and outputs stand in rows: numpy adds many columns up at a time."""
    _, _, wc, bc, wo, bo = p
    cls = target // shape.per_class
    order = np.argsort(cls, kind="stable")
    h, cls, target = h[order], cls[order], target[order]
    places = np.arange(len(h))

    def log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        top = x.max(0)
        mine = x[at, places[: len(at)]] - top
        x -= top
        return mine - np.log(np.exp(x, out=x).sum(0))

    out = log_share(wc.T @ h.T + bc[:, None], cls)
    edges = np.searchsorted(cls, np.arange(shape.classes + 1)).tolist()
    for c, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            lo, hi = c * shape.per_class, min(shape.words, (c + 1) * shape.per_class)
            out[a:b] += log_share(wo[lo:hi] @ h[a:b].T + bo[lo:hi, None], target[a:b] - lo)
    back = np.empty_like(out)
    back[order] = out
    return back


class Lanes:
    """Texts laid end to end in lanes of about equal length, longest lane first.
    Each text is its ids; it is read from an end token and ends with one."""

    def __init__(self, texts: list[np.ndarray], lanes: int) -> None:
        import heapq

        lanes = max(1, min(lanes, len(texts)))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        heap = [(0, k) for k in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        for i in order:
            n, k = heapq.heappop(heap)
            held[k].append(i)
            heapq.heappush(heap, (n + len(texts[i]) + 1, k))
        held.sort(key=lambda own: -sum(len(texts[i]) + 1 for i in own))
        flat = [i for own in held for i in own]
        zero = np.zeros(1, np.int32)
        self.inputs = np.concatenate([x for i in flat for x in (zero, texts[i])]) if flat else zero[:0]
        self.targets = np.concatenate([x for i in flat for x in (texts[i], zero)]) if flat else zero[:0]
        sizes = np.array([len(texts[i]) + 1 for i in flat])
        self.text = np.repeat(np.array(flat, np.int64), sizes)
        self.opens = np.zeros(len(self.inputs), bool)
        self.opens[np.cumsum(sizes) - sizes] = True
        self.lengths = np.array([sum(len(texts[i]) + 1 for i in own) for own in held])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def windows(self, size: int):
        """Per window the places (steps by lanes still going) and lane counts."""
        for t in range(0, int(self.lengths[0]) if len(self.lengths) else 0, size):
            yield [self.starts[: int((self.lengths > s).sum())] + s for s in range(t, min(t + size, int(self.lengths[0])))]


def score(texts: list[np.ndarray], flat: np.ndarray, shape: Shape, lanes: int = 384, window: int = 48) -> np.ndarray:
    """log10 probability of each whole text and its end."""
    p = unpack(flat, shape)
    table, u = p[0], p[1]
    side = Lanes(texts, lanes)
    out = np.zeros(len(texts))
    h = np.zeros((len(side.lengths), shape.hidden), np.float32)
    for places in side.windows(window):
        states = []
        for at in places:
            h = h[: len(at)]
            h = np.where(side.opens[at, None], np.float32(0), h)
            h = _step(table[side.inputs[at]], h, u)[0]
            states.append(h)
        at = np.concatenate(places)
        logs = _logs(np.concatenate(states), side.targets[at], p, shape)
        out += np.bincount(side.text[at], weights=logs.astype(np.float64), minlength=len(texts))
    return out / np.log(10)


def train(
    texts: list[np.ndarray], flat: np.ndarray, shape: Shape, lanes: int = 128, window: int = 24, rate: float = 0.08,
) -> np.ndarray:
    """One pass of truncated back-propagation with AdaGrad steps.

    A window touches few rows of the input table; only those take a step.
    """
    flat = flat.copy()
    p, k = unpack(flat, shape), shape.hidden
    total = np.full(len(flat), 1e-3, np.float32)
    in_table, at_rest = unpack(total, shape)[0], total[p[0].size :]
    grad_flat = np.zeros_like(flat)
    g, rest, to_rest = unpack(grad_flat, shape), flat[p[0].size :], grad_flat[p[0].size :]
    back = np.ascontiguousarray(p[1].T)
    side = Lanes(texts, lanes)
    h = np.zeros((len(side.lengths), k), np.float32)
    for places in side.windows(window):
        to_rest[:] = 0
        back[:] = p[1].T
        at = np.concatenate(places)
        edges = np.cumsum([0, *(len(x) for x in places)])
        ids, goes_on = side.inputs[at], (~side.opens[at]).astype(np.float32)[:, None]
        x = p[0][ids]
        tape, states, befores = [], np.empty((len(at), k), np.float32), np.empty((len(at), k), np.float32)
        for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
            before = np.multiply(h[: hi - lo], goes_on[lo:hi], out=befores[lo:hi])
            h, *rest_of = _step(x[lo:hi], before, p[1])
            states[lo:hi] = h
            tape.append(rest_of)
        _, dh_all = _outputs(states, side.targets[at], p, shape, g)
        # All factors that do not wait for later steps, for the whole window at once.
        r, z, n, an = (np.concatenate(c) for c in zip(*tape))
        to_n, to_z, to_r = (1 - z) * (1 - n * n), (befores - n) * z * (1 - z), an * r * (1 - r)
        later = np.zeros((0, k), np.float32)
        dx_all, da_all = np.empty((len(at), 3 * k), np.float32), np.empty((len(at), 3 * k), np.float32)
        for lo, hi in zip(edges[-2::-1].tolist(), edges[:0:-1].tolist()):
            d, dx, da = dh_all[lo:hi], dx_all[lo:hi], da_all[lo:hi]
            d[: len(later)] += later
            np.multiply(d, to_n[lo:hi], out=dx[:, 2 * k :])
            np.multiply(d, to_z[lo:hi], out=dx[:, k : 2 * k])
            np.multiply(dx[:, 2 * k :], to_r[lo:hi], out=dx[:, :k])
            da[:, : 2 * k] = dx[:, : 2 * k]
            np.multiply(dx[:, 2 * k :], r[lo:hi], out=da[:, 2 * k :])
            later = (d * z[lo:hi] + da @ back) * goes_on[lo:hi]
        g[1][:] = befores.T @ da_all
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) > 0]))
        rows = ids[order[first]]
        step = np.clip(np.add.reduceat(dx_all[order], first) / np.float32(len(places[0])), -5, 5)
        seen = in_table[rows] + step * step
        in_table[rows] = seen
        p[0][rows] += rate * step / np.sqrt(seen)
        to_rest /= len(places[0])
        np.clip(to_rest, -5, 5, out=to_rest)
        at_rest += to_rest * to_rest
        rest += rate * to_rest / np.sqrt(at_rest)
    return flat
