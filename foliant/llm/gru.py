"""A gated recurrent language model in numpy with a class-factored output.

Words have classes: frequent words share classes in which a softmax picks the word, other words share classes by
frequency and alphabet in which their counts do. A step costs a softmax over classes and one within a class. Texts run
in lanes side by side; a lane takes the next text when its own ends, and its state goes on from window to window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Layout:
    """Sizes: hidden units, head classes and their words, other classes, lanes and steps of a window."""

    hidden: int = 24
    head_classes: int = 64
    slots: int = 32
    tail_classes: int = 18
    lanes: int = 256
    steps: int = 64
    rate: float = 0.01

    @property
    def classes(self) -> int:
        return self.head_classes + self.tail_classes

    @property
    def head(self) -> int:
        """Words of head classes, which are numbered first; the other classes follow."""
        return self.head_classes * self.slots

    @property
    def inputs(self) -> int:
        return self.head + self.tail_classes

    def parts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, slot or -1) of numbers of words and classes."""
        tail = ids >= self.head
        return np.where(tail, ids - self.head + self.head_classes, ids % self.head_classes), np.where(tail, -1, ids // self.head_classes)


Params = dict[str, np.ndarray]


def init(layout: Layout, class_mass: np.ndarray, slot_count: np.ndarray, seed: int = 5) -> Params:
    """Parameters that start as the unigram model: biases are the logarithms of counts."""
    rng, h = np.random.default_rng(seed), layout.hidden
    f = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {
        "x": f(layout.inputs, 3 * h), "u": f(h, 3 * h) * 3, "b": np.zeros(3 * h, np.float32), "c": f(h, layout.classes) * 0.1, "cb": np.log(class_mass + 1).astype(np.float32),
        "o": f(layout.head_classes, layout.slots, h) * 0.1, "ob": np.where(slot_count > 0, np.log(np.maximum(slot_count, 1)), -60.0).astype(np.float32),
    }


@dataclass
class Window:
    """Steps by lanes: number of the token, whether it is a text's first, whether there is one, and the text's number."""

    ids: np.ndarray
    before: np.ndarray
    start: np.ndarray
    on: np.ndarray
    owner: np.ndarray
    #: lanes of the window before that are still there
    lanes: np.ndarray

    def __post_init__(self) -> None:
        self.full = bool(self.on.all())

    def rows(self, a: np.ndarray) -> np.ndarray:
        """What ``a`` has for the tokens there are, step by step."""
        return a.reshape(-1, *a.shape[2:]) if self.full else a[self.on]


def windows(seqs: Iterable[np.ndarray], layout: Layout) -> Iterator[Window]:
    """Windows over sequences of numbers, none of them empty; lanes leave when no sequence is left for them."""
    source = enumerate(seqs)
    first = layout.head  # what stands before a text
    running: list[list] = []
    for k, seq in source:
        running.append([k, seq, 0])
        if len(running) == layout.lanes:
            break
    lanes = np.arange(len(running))
    last = np.full(len(running), first, np.int32)
    more_to_come = len(running) == layout.lanes
    while running:
        # Several windows are filled at a time, but for the last ones, out of which lanes should leave.
        size = layout.steps * 4 if more_to_come else min(layout.steps, max(len(seq) - at for _, seq, at in running))
        shape = (len(running), size)
        ids, owner, start = np.zeros(shape, np.int32), np.full(shape, -1, np.int32), np.zeros(shape, bool)
        left = []
        for lane, state in enumerate(running):
            filled = 0
            while True:
                k, seq, at = state
                n = min(size - filled, len(seq) - at)
                ids[lane, filled : filled + n] = seq[at : at + n]
                owner[lane, filled : filled + n] = k
                if not at:
                    start[lane, filled] = True
                filled, state[2] = filled + n, at + n
                if state[2] < len(seq):
                    break
                more = next(source, None)
                if more is None:
                    state[1], more_to_come = None, False
                    break
                state[:] = [*more, 0]
                if filled == size:
                    break
            if state[1] is not None:
                left.append(lane)
        ids, start, owner = (np.ascontiguousarray(a.T) for a in (ids, start, owner))
        before = np.concatenate([last[lanes][None], ids[:-1]])
        before[start] = first
        last, on = ids[-1], owner >= 0
        for a in range(0, size, layout.steps):
            part = slice(a, a + layout.steps)
            if on[part].any():
                yield Window(ids[part], before[part], start[part], on[part], owner[part], lanes)
                lanes = np.arange(len(running))
        running, lanes = [running[k] for k in left], np.array(left, np.int64)


def _shares(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, logarithm of the sum) of the exponentials of each row, which ``a`` then has."""
    np.exp(a, out=a)
    total = a @ np.ones(a.shape[1], a.dtype) + np.float32(1e-37)
    return total, np.log(total)


def _shifted(weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """``bias`` less one number per softmax, so that no exponential of a state (all within -1 and 1) times ``weight`` (units last) plus bias exceeds float32."""
    bound = np.abs(weight).sum(axis=-1) + bias
    return bias - np.maximum(bound.max(axis=-1, keepdims=True) - np.float32(80), bias.max(axis=-1, keepdims=True))


#: rows of the output that fit in a core's cache
_BLOCK = 2048


class Gru:
    """The model with its parameters and the moments of their gradients."""

    def __init__(self, layout: Layout, params: Params) -> None:
        self.l, self.p = layout, params
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}
        self.t = 0
        self.held: dict[str, np.ndarray] = {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array that windows of one shape use in turn."""
        a = self.held.get(name)
        if a is None or a.shape != shape:
            a = self.held[name] = np.empty(shape, np.float32)
        return a

    def forward(self, x: np.ndarray, start: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, ...]:
        """(states before and after every step, z, r, candidate, its recurrent part) over a window; the last four only to ``keep``."""
        n, (steps, lanes) = self.l.hidden, x.shape
        # Half the sum of a gate, as its sigmoid is half a hyperbolic tangent of that.
        half = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), n)
        u, gates = self.p["u"] * half, self._room("gates", steps, lanes, 3 * n)
        np.take((self.p["x"] + self.p["b"]) * half, x, axis=0, out=gates, mode="clip")
        last, states = h, self._room("states", steps + 1, lanes, n)
        states[0] = last
        z, r, cand, rec = (self._room(name, steps if keep else 1, lanes, n) for name in ("z", "r", "cand", "rec"))
        hh, both = self._room("hh", lanes, 3 * n), self._room("both", lanes, 2 * n)
        reset = start.any(axis=1)
        for t in range(steps):
            k, h, gate = t if keep else 0, states[t], gates[t]
            if reset[t]:
                h = np.where(start[t][:, None], np.float32(0), h)
            np.matmul(h, u, out=hh)
            np.add(gate[:, : 2 * n], hh[:, : 2 * n], out=both)
            np.tanh(both, out=both)
            both += np.float32(1)
            both *= np.float32(0.5)
            # Contiguous copies, as what follows is faster over them.
            z[k], r[k], rec[k] = both[:, :n], both[:, n:], hh[:, 2 * n :]
            c, new = cand[k], states[t + 1]
            np.multiply(r[k], rec[k], out=c)
            c += gate[:, 2 * n :]
            np.tanh(c, out=c)
            np.subtract(h, c, out=new)
            new *= z[k]
            new += c
        return states, z, r, cand, rec

    def output(self, h: np.ndarray, ids: np.ndarray, grads: Params | None) -> tuple[np.ndarray, np.ndarray | None]:
        """(log probability of each row's number, gradient to h or None)."""
        cls, slot = self.l.parts(ids)
        score, back, up = np.empty(len(ids), np.float32), None, np.ascontiguousarray(self.p["c"].T)
        bias, inner = _shifted(up, self.p["cb"]), _shifted(self.p["o"], self.p["ob"])
        if grads is not None:
            back = np.empty_like(h)
            grads |= {"c": np.zeros_like(self.p["c"]), "cb": np.zeros_like(self.p["cb"]), "o": np.zeros_like(self.p["o"]), "ob": np.zeros_like(self.p["ob"])}
        for first in range(0, len(ids), _BLOCK):
            at = slice(first, first + _BLOCK)
            own, k = h[at], cls[at]
            a = own @ self.p["c"]
            a += bias
            rows = np.arange(len(k))
            part = a[rows, k]
            total, log = _shares(a)
            np.subtract(part, log, out=score[at])
            if grads is not None:
                a *= (1 / total)[:, None]
                a[rows, k] -= 1
                grads["c"] += own.T @ a
                grads["cb"] += np.ones(len(k), np.float32) @ a
                np.matmul(a, up, out=back[at])
        head = np.flatnonzero(slot >= 0)
        head = head[np.argsort(cls[head].astype(np.uint16), kind="stable")]
        cuts = np.flatnonzero(np.diff(cls[head], prepend=-1))
        own, word, more = h[head], slot[head], np.empty(len(head), np.float32)
        down = np.empty_like(own) if grads is not None else None
        some = np.arange(len(head))
        for first, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(head)]):
            k, at = int(cls[head[first]]), slice(first, end)
            a = own[at] @ self.p["o"][k].T
            a += inner[k]
            here = some[: end - first]
            more[at] = a[here, word[at]]
            total, log = _shares(a)
            more[at] -= log
            if grads is not None:
                a *= (1 / total)[:, None]
                a[here, word[at]] -= 1
                grads["o"][k], grads["ob"][k] = a.T @ own[at], a.sum(axis=0)
                np.matmul(a, self.p["o"][k], out=down[at])
        score[head] += more
        if grads is not None:
            back[head] += down
        return score, back

    def _run(self, seqs: Iterable[np.ndarray], keep: bool):
        h = None
        for w in windows(seqs, self.l):
            h = np.zeros((len(w.lanes), self.l.hidden), np.float32) if h is None else h[w.lanes]
            out = self.forward(w.before, w.start, h, keep)
            h = out[0][-1].copy()
            yield w, out

    def score(self, seqs: Iterable[np.ndarray]) -> np.ndarray:
        """Natural log probability of every sequence."""
        total, n = np.zeros(0), 0
        for w, (states, *_) in self._run(seqs, False):
            owner = w.rows(w.owner)
            logs = self.output(w.rows(states[1:]), w.rows(w.ids), None)[0]
            more = np.bincount(owner, logs)
            if len(more) > len(total):
                total = np.concatenate([total, np.zeros(max(len(more), 2 * len(total)) - len(total))])
            total[: len(more)] += more
            n = max(n, len(more))
        return total[:n]

    def gradients(self, w: Window, out: tuple[np.ndarray, ...]) -> Params:
        """Gradients of the negative log probability of a window, back to its first step."""
        n, grads = self.l.hidden, {}
        states, z, r, cand, rec = out
        more = self.output(w.rows(states[1:]), w.rows(w.ids), grads)[1]
        if w.full:
            back = more.reshape(cand.shape)
        else:
            back = np.zeros_like(cand)
            back[w.on] = more
        # Gradients of the recurrent sums of z, r and c, of which the last has not met r yet.
        d, dh, up = self._room("d", *w.ids.shape, 3 * n), np.zeros_like(cand[0]), np.ascontiguousarray(self.p["u"].T)
        grads["u"] = np.zeros_like(self.p["u"])
        through, left, dz, dr, dc = np.empty_like(d[0]), *(np.empty_like(dh) for _ in range(4))
        one = np.float32(1)
        stops = w.start.any(axis=1)
        for t in range(len(d) - 1, -1, -1):
            dh += back[t]
            zt, rt, c, g = z[t], r[t], cand[t], d[t]
            h = np.where(w.start[t][:, None], np.float32(0), states[t]) if stops[t] else states[t]
            np.subtract(one, zt, out=left)
            np.multiply(dh, left, out=dc)
            left *= zt
            left *= dh
            np.subtract(h, c, out=dz)
            dz *= left
            np.multiply(c, c, out=left)
            np.subtract(one, left, out=left)
            dc *= left
            np.subtract(one, rt, out=left)
            left *= rt
            left *= rec[t]
            np.multiply(dc, left, out=dr)
            through[:, :n], through[:, n : 2 * n] = dz, dr
            g[:, : 2 * n], g[:, 2 * n :] = through[:, : 2 * n], dc
            dc *= rt
            through[:, 2 * n :] = dc
            grads["u"] += h.T @ through
            dh *= zt
            dh += through @ up
            if stops[t]:
                dh[w.start[t]] = 0
        flat, ids = w.rows(d), w.rows(w.before)
        order = np.argsort(ids.astype(np.uint16) if self.l.inputs < 1 << 16 else ids, kind="stable")
        cuts = np.flatnonzero(np.diff(ids[order], prepend=-1))
        grads["b"], grads["x"] = flat.sum(axis=0), np.zeros_like(self.p["x"])
        grads["x"][ids[order][cuts]] = np.add.reduceat(flat[order], cuts, axis=0)
        return grads

    def train(self, seqs: Iterable[np.ndarray]) -> int:
        """One pass with backpropagation through each window; returns the number of tokens."""
        seen = 0
        for w, out in self._run(seqs, True):
            tokens = int(w.on.sum())
            self._step(self.gradients(w, out), tokens)
            seen += tokens
        return seen

    def _step(self, grads: Params, tokens: int) -> None:
        """Adam on the mean gradient."""
        self.t += 1
        fix = np.float32(self.l.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        mean = np.float32(1 / max(tokens, 1))
        for k, g in grads.items():
            m, v, room = self.m[k], self.v[k], self._room(f"step {k}", *g.shape)
            g *= mean
            m *= np.float32(0.9)
            m += np.multiply(g, np.float32(0.1), out=room)
            g *= g
            v *= np.float32(0.999)
            v += np.multiply(g, np.float32(0.001), out=room)
            np.sqrt(v, out=room)
            room += np.float32(1e-6)
            np.divide(m, room, out=room)
            room *= fix
            self.p[k] = np.subtract(self.p[k], room, out=g)


def to_bytes(params: Params) -> bytes:
    return b"".join(np.ascontiguousarray(params[k], np.float32).tobytes() for k in sorted(params))


def from_vector(vector: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = vector[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out
