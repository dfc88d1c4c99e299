"""A small causal self-attention language model over subword symbols, in numpy.

Windows of `CONTEXT + SCORED` inputs overlap by `CONTEXT`; each token is scored in one window only.
The output is a class of symbols, then a member of it, so that a token costs two small softmaxes.
Both start from a prior, the counted symbols that follow the last input; what attention sees of the
window is added to its logits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

CLASSES, MEMBER_BITS = 32, 5
MEMBERS = 1 << MEMBER_BITS
VOCAB = CLASSES * MEMBERS
DIM, HIDDEN = 8, 16
CONTEXT, SCORED = 4, 12
WINDOW = CONTEXT + SCORED
#: Windows that are scored at once.
SLAB = 256
#: Steps that a pass over the windows is divided into, and the least and most windows of a step.
STEPS, LEAST, MOST = 1024, 64, 256

#: Slope of the hidden units below 0, so that none dies.
LEAK = np.float32(0.1)
#: Steps over which the rate rises at the begin of a pass.
WARM = 50

#: How far a scored position (row) is from an input (column); inputs after it are never seen.
_BACK = np.arange(CONTEXT, WINDOW)[:, None] - np.arange(WINDOW)
_SEEN, _DISTANCE = _BACK >= 0, np.maximum(_BACK, 0)
_UNSEEN = np.float32(-1e4)
#: Sums of exp() from which no addend that counts is missing, so that no maximum need be subtracted before.
_LEAST, _MOST = 1e-30, 1e30
_PLACES = np.arange(WINDOW)
#: Rows of one class; the places of an input's embedding among all.
_CLASS, _PARTS = np.eye(CLASSES, dtype=np.float32), np.arange(VOCAB * DIM).reshape(VOCAB, DIM)

Params = dict[str, np.ndarray]


def initial(seed: int = 6) -> Params:
    """Parameters that add next to nothing to the prior."""
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "emb": normal(0.5, VOCAB, DIM), "back": (-0.5 * np.arange(WINDOW)).astype(np.float32), "q": normal(DIM**-0.5, DIM, DIM), "kv": normal(DIM**-0.5, DIM, 2 * DIM),
        "w": normal((2 * DIM) ** -0.5, 2 * DIM, HIDDEN), "b": np.zeros(HIDDEN, np.float32),
        "u1": normal(0.01, HIDDEN, CLASSES), "gate": 1 + normal(0.1, CLASSES, HIDDEN), "u2": normal(0.01, HIDDEN, MEMBERS),
    }


@dataclass
class Prior:
    """Log probabilities of the classes after each symbol, and of the members after each symbol and class."""

    classes: np.ndarray
    members: np.ndarray

    @classmethod
    def counted(cls, pairs: np.ndarray) -> Prior:
        """From [VOCAB, VOCAB] counts of symbols after symbols; what was seldom seen leans on the symbol's own share."""
        single = pairs.sum(0) + 0.5
        kinds = (pairs > 0).sum(1, keepdims=True) + 1.0
        p = (pairs + kinds * (single / single.sum())) / (pairs.sum(1, keepdims=True) + kinds)
        p = p.reshape(VOCAB, CLASSES, MEMBERS)
        of_class = p.sum(2)
        return cls(np.log(of_class).astype(np.float32), np.log(p / of_class[:, :, None]).astype(np.float32).reshape(-1, MEMBERS))


class Windows:
    """Windows over texts in one stream: text i's targets are the `sizes[i]` symbols from `starts[i]`, each preceded by its input; the symbol before the first is an end."""

    def __init__(self, stream: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        n = -(-sizes // SCORED)
        self.text = np.repeat(np.arange(len(sizes)), n)
        self.first = (np.arange(len(self.text)) - np.repeat(np.cumsum(n) - n, n)) * SCORED
        self.at = starts[self.text] + self.first
        self.left = sizes[self.text] - self.first
        padded = np.concatenate([np.zeros(CONTEXT + 1, stream.dtype), stream, np.zeros(SCORED, stream.dtype)])
        self.rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 1)  # from CONTEXT + 1 before the first target

    def __len__(self) -> int:
        return len(self.text)

    def reorder(self, order: np.ndarray) -> None:
        self.text, self.first, self.at, self.left = self.text[order], self.first[order], self.at[order], self.left[order]

    def take(self, part: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs [n, WINDOW] with a mask of those before a text's begin, all of CONTEXT or none, and targets [n, SCORED] with a mask of those that the text has."""
        rows = self.rows[self.at[part]].astype(np.intp)
        return rows[:, :WINDOW], _PLACES < (CONTEXT - self.first[part])[:, None], rows[:, CONTEXT + 1 :], _PLACES[:SCORED] < self.left[part][:, None]


def _exp(logits: Callable[[], np.ndarray], at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """exp() of logits, the sum of each row, and the logits `at` these places; less each row's maximum where exp() over- or underflows."""
    for steady in (False, True):
        e = logits()
        if steady:
            e -= e.max(-1, keepdims=True)
        picked = None if at is None else e.ravel().take(at)
        np.exp(e, out=e)
        sums = e.reshape(-1, e.shape[-1]) @ np.ones(e.shape[-1], e.dtype)
        if not sums.size or sums.min() > _LEAST and sums.max() < _MOST:
            break
    return e, sums, picked


def forward(p: Params, prior: Prior, inputs: np.ndarray, before: np.ndarray, targets: np.ndarray, scored: bool = True) -> tuple[np.ndarray | None, tuple]:
    """[n, SCORED] natural log probabilities of the targets, if they are `scored`, and what backward() needs."""
    with np.errstate(over="ignore"):
        return _forward(p, prior, inputs, before, targets, scored)


def _forward(p: Params, prior: Prior, inputs: np.ndarray, before: np.ndarray, targets: np.ndarray, scored: bool) -> tuple[np.ndarray | None, tuple]:
    n = len(inputs)
    x = p["emb"].take(inputs, 0)
    kv = (x.reshape(-1, DIM) @ p["kv"]).reshape(n, WINDOW, 2 * DIM)
    here = np.ascontiguousarray(x[:, CONTEXT:]).reshape(-1, DIM)
    q = (here @ p["q"]).reshape(n, SCORED, DIM)
    keys, back, begin = kv[:, :, :DIM].transpose(0, 2, 1), np.where(_SEEN, p["back"][_DISTANCE], _UNSEEN), np.flatnonzero(before[:, CONTEXT - 1])

    def met() -> np.ndarray:
        a = q @ keys
        a += back
        if len(begin):
            a[begin, :, :CONTEXT] += _UNSEEN
        return a

    a, sums, _ = _exp(met)
    a /= sums.reshape(n, SCORED, 1)
    seen = (a @ kv[:, :, DIM:]).reshape(-1, DIM)
    both = np.concatenate([here, seen], 1)
    h = both @ p["w"]
    # All places of a window at once: longer rows are added faster.
    h.reshape(n, -1)[:] += np.tile(p["b"], SCORED)
    np.maximum(h, LEAK * h, out=h)
    flat, last = targets.ravel(), inputs[:, CONTEXT:].ravel()
    c, m = flat >> MEMBER_BITS, flat & MEMBERS - 1
    # Places of the targets' classes and members among all rows' logits.
    rows = np.arange(len(h))
    at_class, at_member = rows * CLASSES + c, rows * MEMBERS + m

    def classes() -> np.ndarray:
        e = h @ p["u1"]
        e += prior.classes.take(last, 0)
        return e

    gate = p["gate"].take(c, 0)
    g = gate * h

    def members() -> np.ndarray:
        e = g @ p["u2"]
        e += prior.members.take(last * CLASSES + c, 0)
        return e

    e1, s1, of_class = _exp(classes, at_class if scored else None)
    e2, s2, of_member = _exp(members, at_member if scored else None)
    lp = (of_class + of_member - np.log(s1) - np.log(s2)).reshape(n, SCORED) if scored else None
    return lp, (x, q, kv, a, here, both, h, c, at_class, at_member, e1, s1, gate, g, e2, s2)


def backward(p: Params, inputs: np.ndarray, real: np.ndarray, held: tuple) -> Params:
    """Gradients of the mean negative log probability of the real targets; overwrites what was held."""
    x, q, kv, a, here, both, h, c, at_class, at_member, d1, s1, gate, g, d2, s2 = held
    n, share = len(inputs), real.ravel().astype(h.dtype) / max(1, int(real.sum()))
    d1 *= (share / s1)[:, None]
    d1.ravel()[at_class] -= share
    d2 *= (share / s2)[:, None]
    d2.ravel()[at_member] -= share
    dh = d2 @ p["u2"].T
    dgate = _CLASS.take(c, 0).T @ (dh * h)
    dh *= gate
    dh += d1 @ p["u1"].T
    slope = (h > 0).astype(h.dtype)
    slope *= 1 - LEAK
    slope += LEAK
    dh *= slope
    dseen = (dh @ p["w"][DIM:].T).reshape(n, SCORED, DIM)
    da = dseen @ kv[:, :, DIM:].transpose(0, 2, 1)
    da -= ((da * a).reshape(-1, WINDOW) @ np.ones(WINDOW, a.dtype)).reshape(n, SCORED, 1)
    da *= a
    dkv = np.empty_like(kv)
    np.matmul(da.transpose(0, 2, 1), q, out=dkv[:, :, :DIM])
    np.matmul(a.transpose(0, 2, 1), dseen, out=dkv[:, :, DIM:])
    dq, flat = (da @ kv[:, :, :DIM]).reshape(-1, DIM), dkv.reshape(-1, 2 * DIM)
    dx = (flat @ p["kv"].T).reshape(n, WINDOW, DIM)
    dhere = dh @ p["w"][:DIM].T
    dhere += dq @ p["q"].T
    dx[:, CONTEXT:] += dhere.reshape(n, SCORED, DIM)
    demb = np.bincount(_PARTS.take(inputs, 0).ravel(), dx.ravel(), VOCAB * DIM).astype(h.dtype).reshape(VOCAB, DIM)
    dback = np.bincount(_DISTANCE.ravel(), np.ones(n, h.dtype) @ da.reshape(n, -1) * _SEEN.ravel(), WINDOW).astype(h.dtype)
    return {
        "emb": demb, "back": dback, "q": here.T @ dq, "kv": x.reshape(-1, DIM).T @ flat, "w": both.T @ dh, "b": np.ones(len(dh), h.dtype) @ dh,
        "u1": h.T @ d1, "gate": dgate, "u2": g.T @ d2,
    }


def log10_scores(p: Params, prior: Prior, stream: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each text's log10 probability: the sum over its targets."""
    w, out = Windows(stream, starts, sizes), np.zeros(len(sizes))
    for i in range(0, len(w), SLAB):
        part = slice(i, i + SLAB)
        inputs, before, targets, real = w.take(part)
        lp, _ = forward(p, prior, inputs, before, targets)
        sums, text = np.where(real, lp, 0).sum(1, dtype=np.float64), w.text[part]
        out[text[0] : text[-1] + 1] += np.bincount(text - text[0], sums)
    return out / np.log(10)


class Adam:
    """All parameters as one vector, of which `p` has the parts."""

    def __init__(self, p: Params):
        self.flat = np.concatenate([v.ravel() for v in p.values()])
        self.p = dict(unflatten(self.flat, p))
        self.m, self.s, self.t = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

    def step(self, grads: Params, rate: float) -> None:
        self.t += 1
        g = np.concatenate([grads[k].ravel() for k in self.p])
        self.m += 0.1 * (g - self.m)
        g *= g
        g -= self.s
        g *= 0.01
        self.s += g
        np.multiply(self.s, 1 / (1 - 0.99**self.t), out=g)
        np.sqrt(g, out=g)
        g += 1e-8
        np.divide(self.m, g, out=g)
        g *= rate / (1 - 0.9**self.t)
        self.flat -= g


def unflatten(flat: np.ndarray, like: Params) -> Iterator[tuple[str, np.ndarray]]:
    """The parts of a vector, as views, under the names and in the shapes of `like`."""
    at = 0
    for k, v in like.items():
        yield k, flat[at : at + v.size].reshape(v.shape)
        at += v.size


def train(p: Params, prior: Prior, stream: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rate: float, seed: int = 6) -> Params:
    """Parameters after a pass over all windows in random order, by Adam at a falling rate."""
    w, adam = Windows(stream, starts, sizes), Adam(p)
    w.reorder(np.random.default_rng(seed).permutation(len(w)))
    batch = min(MOST, max(LEAST, len(w) // STEPS))
    for i in range(0, len(w), batch):
        inputs, before, targets, real = w.take(slice(i, i + batch))
        _, held = forward(adam.p, prior, inputs, before, targets, scored=False)
        adam.step(backward(adam.p, inputs, real, held), rate * min(1, (adam.t + 1) / WARM) * (1 - 0.9 * i / len(w)))
    return adam.p
