"""A bidirectional LSTM block labeller in numpy: forward pass, gradients, Adam."""

from __future__ import annotations

import io
import pkgutil

import numpy as np

from .html_blocks import FIGURES, PATH_BUCKETS, WORD_BUCKETS

INPUT, HIDDEN = 24, 20
WEIGHTS = "html_lstm.npz"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {
        "buckets": r.normal(0, 0.1, (PATH_BUCKETS + WORD_BUCKETS, INPUT)),
        "figures": r.normal(0, 0.2, (FIGURES, INPUT)),
        "bias": np.zeros(INPUT),
        "out": r.normal(0, 0.2, (2 * HIDDEN, 1)),
        "out_bias": np.zeros(1),
    }
    for d in ("f", "b"):
        w[f"{d}_in"] = r.normal(0, 0.2, (INPUT, 4 * HIDDEN))
        w[f"{d}_rec"] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        w[f"{d}_bias"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)))
    return {k: v.astype(np.float32) for k, v in w.items()}


def load() -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(pkgutil.get_data(__package__, WEIGHTS))) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


class Sparse:
    """Bags of buckets of many blocks: the mean vector of each bag's path buckets plus that of its word buckets."""

    def __init__(self, paths: list[list[int]], words: list[list[int]]):
        both = [(p, 1 / max(1, len(p)) ** 0.5) for p in paths], [(w, 1 / max(1, len(w)) ** 0.5) for w in words]
        self.n = len(paths)
        bags = [*both[0], *both[1]]
        self.columns = np.fromiter((c for b, _ in bags for c in b), np.int64)
        sizes = np.array([len(b) for b, _ in bags], np.int64)
        self.rows = np.repeat(np.tile(np.arange(self.n), 2), sizes)
        self.scale = np.repeat(np.array([s for _, s in bags], np.float32), sizes)

    def times(self, table: np.ndarray) -> np.ndarray:
        out = np.empty((self.n, table.shape[1]), np.float32)
        for k in range(table.shape[1]):
            out[:, k] = np.bincount(self.rows, weights=table[self.columns, k] * self.scale, minlength=self.n)
        return out

    def gradient(self, up: np.ndarray, size: int) -> np.ndarray:
        out = np.empty((size, up.shape[1]), np.float32)
        for k in range(up.shape[1]):
            out[:, k] = np.bincount(self.columns, weights=up[self.rows, k] * self.scale, minlength=size)
        return out


def _run(x: np.ndarray, mask: np.ndarray, w: dict, d: str, keep: bool):
    """One direction over (time, batch, input); masked steps carry the state on."""
    steps, batch, _ = x.shape
    gates_in = x @ w[f"{d}_in"] + w[f"{d}_bias"]
    h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    outs, trace = np.zeros((steps, batch, HIDDEN), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = gates_in[t] + h @ w[f"{d}_rec"]
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = f * c + i * g
        tan = np.tanh(new)
        if keep:
            trace.append((t, h, c, i, f, o, g, tan, m))
        c = np.where(m, new, c)
        h = np.where(m, o * tan, h)
        outs[t] = h
    return outs, trace


def _back(up: np.ndarray, x: np.ndarray, trace: list, w: dict, d: str, grads: dict) -> np.ndarray:
    dx_gates = np.zeros((*up.shape[:2], 4 * HIDDEN), np.float32)
    dh, dc = np.zeros(up.shape[1:], np.float32), np.zeros(up.shape[1:], np.float32)
    rec = np.zeros_like(w[f"{d}_rec"])
    for t, h0, c0, i, f, o, g, tan, m in reversed(trace):
        dh = dh + up[t]
        on_h, on_c = dh * m, dc * m
        dnew = on_c + on_h * o * (1 - tan**2)
        dz = np.concatenate((dnew * g * i * (1 - i), dnew * c0 * f * (1 - f), on_h * tan * o * (1 - o), dnew * i * (1 - g**2)), axis=1)
        dx_gates[t] = dz
        rec += h0.T @ dz
        dh = dh * ~m + dz @ w[f"{d}_rec"].T
        dc = dc * ~m + dnew * f
    flat = dx_gates.reshape(-1, 4 * HIDDEN)
    grads[f"{d}_rec"], grads[f"{d}_in"], grads[f"{d}_bias"] = rec, x.reshape(-1, INPUT).T @ flat, flat.sum(axis=0)
    return dx_gates @ w[f"{d}_in"].T


def inputs(paths, words, figures: np.ndarray, w: dict) -> tuple[np.ndarray, Sparse]:
    bag = Sparse(paths, words)
    return np.tanh(bag.times(w["buckets"]) + figures @ w["figures"] + w["bias"]), bag


def _padded(x: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Time-major batch of sequences that lie one behind the other in ``x``; places of every row in it."""
    n = np.array(lengths)
    batch = np.repeat(np.arange(len(n)), n)
    time = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros((int(n.max()), len(n), x.shape[1]), np.float32)
    mask = np.zeros(out.shape[:2], bool)
    out[time, batch], mask[time, batch] = x, True
    return out, mask, time, batch


def label(x: np.ndarray, lengths: list[int], w: dict, at_once: int = 256) -> np.ndarray:
    """Probability of being main text for every block; pages of like length run together."""
    out = np.zeros(len(x), np.float32)
    n = np.array(lengths)
    begin = np.cumsum(n) - n
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    for a in range(0, len(order), at_once):
        some = order[a : a + at_once]
        rows = np.concatenate([np.arange(begin[i], begin[i] + n[i]) for i in some])
        seq, mask, time, batch = _padded(x[rows], n[some].tolist())
        both = np.concatenate([_run(seq, mask, w, d, False)[0] for d in ("f", "b")], axis=2)[time, batch]
        out[rows] = _sigmoid(both @ w["out"] + w["out_bias"])[:, 0]
    return out


def gradients(paths, words, figures, lengths: list[int], y: np.ndarray, w: dict) -> tuple[float, dict]:
    """Loss and gradients over one batch of pages."""
    x, bag = inputs(paths, words, figures, w)
    seq, mask, time, batch = _padded(x, lengths)
    runs = {d: _run(seq, mask, w, d, True) for d in ("f", "b")}
    both = np.concatenate([runs[d][0] for d in ("f", "b")], axis=2)
    hidden = both[time, batch]
    p = _sigmoid(hidden @ w["out"] + w["out_bias"])[:, 0]
    loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
    dz = ((p - y) / len(y)).astype(np.float32)[:, None]
    grads = {"out": hidden.T @ dz, "out_bias": dz.sum(axis=0)}
    up = np.zeros_like(both)
    up[time, batch] = dz @ w["out"].T
    dseq = sum(_back(up[:, :, k * HIDDEN : (k + 1) * HIDDEN], seq, runs[d][1], w, d, grads) for k, d in enumerate(("f", "b")))
    dx = dseq[time, batch] * (1 - x**2)
    grads |= {"bias": dx.sum(axis=0), "figures": figures.T @ dx, "buckets": bag.gradient(dx, len(w["buckets"]))}
    return loss, grads


class Adam:
    def __init__(self, w: dict, rate: float = 0.01):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def step(self, w: dict, grads: dict, decay: float = 1e-4) -> None:
        self.t += 1
        norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
        for k, g in grads.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g**2
            w[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8) + decay * w[k])
