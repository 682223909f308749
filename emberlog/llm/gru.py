"""A bidirectional gated recurrent network with attention pooling, in numpy, forward and backward.

Each word is a pair of inputs: an embedding of the word itself and the mean embedding of its
character n-grams, both by hashed number. Two recurrent passes, one from each end, read a
window of words; attention pools their states into one vector, and a linear layer gives the logit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Params = dict[str, np.ndarray]
_TABLES = ("word", "char")


def new_params(slots: int, size: int, hidden: int, attention: int, seed: int = 5) -> Params:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    params = {t: normal(slots, size, scale=0.1) for t in _TABLES}
    for way in ("f", "b"):
        params |= {
            f"x{way}": normal(2 * size, 3 * hidden, scale=(2 * size) ** -0.5),
            f"c{way}": np.zeros(3 * hidden, np.float32),
            f"h{way}": normal(hidden, 3 * hidden, scale=hidden**-0.5),
        }
    return params | {
        "a": normal(2 * hidden, attention, scale=(2 * hidden) ** -0.5),
        "ac": np.zeros(attention, np.float32),
        "v": normal(attention, scale=attention**-0.5),
        "o": normal(2 * hidden, scale=(2 * hidden) ** -0.5),
        "oc": np.zeros(1, np.float32),
    }


@dataclass
class Words:
    """Distinct words: slot of the word, and slots of its character n-grams, flat, with the begin of each word's."""

    slot: np.ndarray
    grams: np.ndarray
    begins: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(np.append(self.begins, len(self.grams)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def inputs(params: Params, words: Words) -> np.ndarray:
    """Input vector of every distinct word."""
    if not len(words.slot):
        return np.zeros((0, 2 * params["word"].shape[1]), params["word"].dtype)
    sums = np.add.reduceat(params["char"][words.grams], words.begins, axis=0)
    return np.concatenate([params["word"][words.slot], sums / words.counts()[:, None].astype(sums.dtype)], axis=1)


def _pass(params: Params, way: str, projected: np.ndarray, windows: np.ndarray, real: np.ndarray, keep: bool):
    """States after every step of one direction, (steps, windows, hidden), and what the way back needs."""
    steps, n = windows.shape
    hidden = params["h" + way].shape[0]
    state = np.zeros((n, hidden), projected.dtype)
    states, kept = np.empty((steps, n, hidden), projected.dtype), {}
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        x = projected[windows[t]]
        u = state @ params["h" + way]
        gates = _sigmoid(x[:, : 2 * hidden] + u[:, : 2 * hidden])
        z, r = gates[:, :hidden], gates[:, hidden:]
        new = np.tanh(x[:, 2 * hidden :] + r * u[:, 2 * hidden :])
        before = state
        state = before + (1 - z) * (new - before) * real[t][:, None]
        states[t] = state
        if keep:
            kept[t] = (before, u[:, 2 * hidden :], z, r, new)
    return states, kept


def forward(params: Params, words: Words, windows: np.ndarray, real: np.ndarray, keep: bool = False):
    """Logit of every window; ``windows``: (steps, windows) numbers of words, ``real``: 1 at words, 0 at padding."""
    x = inputs(params, words)
    passes = {}
    for way in ("f", "b"):
        passes[way] = _pass(params, way, x @ params["x" + way] + params["c" + way], windows, real, keep)
    both = np.concatenate([passes["f"][0], passes["b"][0]], axis=2)
    hint = np.tanh(both @ params["a"] + params["ac"])
    energy = np.where(real > 0, hint @ params["v"], np.float32(-1e9))
    weight = np.exp(energy - energy.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", weight, both)
    logits = pooled @ params["o"] + params["oc"][0]
    return (logits, (x, passes, both, hint, weight, pooled)) if keep else logits


def gradients(params: Params, words: Words, windows: np.ndarray, real: np.ndarray, labels: np.ndarray):
    """Mean logistic loss of the windows and its derivatives by all parameters."""
    logits, (x, passes, both, hint, weight, pooled) = forward(params, words, windows, real, keep=True)
    p = _sigmoid(logits)
    loss = float(-np.mean(np.where(labels > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
    d_logit = ((p - labels) / len(labels)).astype(both.dtype)
    out = {k: np.zeros_like(v) for k, v in params.items()}
    out["o"], out["oc"] = pooled.T @ d_logit, np.array([d_logit.sum()], both.dtype)
    d_pooled = d_logit[:, None] * params["o"]
    d_both = weight[:, :, None] * d_pooled
    d_weight = np.einsum("tnh,nh->tn", both, d_pooled)
    d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
    out["v"] = np.einsum("tn,tna->a", d_energy, hint)
    d_hint = d_energy[:, :, None] * params["v"] * (1 - hint**2)
    out["a"], out["ac"] = np.einsum("tnh,tna->ha", both, d_hint), d_hint.sum(axis=(0, 1))
    d_both += d_hint @ params["a"].T

    hidden, steps = params["hf"].shape[0], len(windows)
    d_x = np.zeros_like(x)
    for way, part in (("f", slice(0, hidden)), ("b", slice(hidden, None))):
        kept, u_matrix = passes[way][1], params["h" + way]
        d_state = np.zeros((windows.shape[1], hidden), both.dtype)
        d_projected = np.zeros((len(x), 3 * hidden), both.dtype)
        for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
            before, u_new, z, r, new = kept[t]
            on = real[t][:, None].astype(both.dtype)
            d_state = d_state + d_both[t][:, part]
            d_new = d_state * (1 - z) * on * (1 - new**2)
            d_z = d_state * (before - new) * on * z * (1 - z)
            d_r = d_new * u_new * r * (1 - r)
            d_gates = np.concatenate([d_z, d_r, d_new], axis=1)
            np.add.at(d_projected, windows[t], d_gates)
            d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
            out["h" + way] += before.T @ d_u
            d_state = d_state * (1 - (1 - z) * on) + d_u @ u_matrix.T
        out["x" + way], out["c" + way] = x.T @ d_projected, d_projected.sum(axis=0)
        d_x += d_projected @ params["x" + way].T
    size = params["word"].shape[1]
    np.add.at(out["word"], words.slot, d_x[:, :size])
    counts = words.counts()
    np.add.at(out["char"], words.grams, np.repeat(d_x[:, size:] / counts[:, None].astype(d_x.dtype), counts, axis=0))
    return loss, out


class Adam:
    def __init__(self, params: Params, rate: float):
        self.rate, self.step = rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in params.items()}
        self.square = {k: np.zeros_like(v) for k, v in params.items()}

    def move(self, params: Params, slopes: Params) -> None:
        self.step += 1
        length = np.sqrt(sum(float((g**2).sum()) for g in slopes.values()))
        for k, g in slopes.items():
            g = g * min(1.0, 5.0 / (length + 1e-9))
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g**2 - self.square[k])
            m, s = self.mean[k] / (1 - 0.9**self.step), self.square[k] / (1 - 0.999**self.step)
            params[k] -= (self.rate * m / (np.sqrt(s) + 1e-8)).astype(params[k].dtype)
