"""A bidirectional gated recurrent network over bytes that labels every position.

Plain numpy: training by backpropagation through time, and application to many windows of
bytes at once. Arrays are laid out (step, unit, window), so that every operation runs along
the windows. The sigmoid of x is taken as (1 + tanh(x/2)) / 2.
"""

from __future__ import annotations

import numpy as np

WINDOW = 64
UNITS = 8

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def new_parameters(classes: int, seed: int = 1) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    shape = {"out": (classes, 2 * UNITS), "bias": (classes, 1)}
    for side in "fb":
        shape |= {f"in_{side}": (3 * UNITS, 256), f"re_{side}": (3 * UNITS, UNITS)}
    scale = {"in": 0.3, "re": 1 / np.sqrt(UNITS), "ou": 1 / np.sqrt(UNITS), "bi": 0.0}
    return {k: (draw.standard_normal(s) * scale[k[:2]]).astype(np.float32) for k, s in shape.items()}


def _states(inputs, recurrent, data, keep=False):
    """States after each step; `data` is (step, window). With `keep`, also the gates."""
    steps, n = data.shape
    states = np.empty((steps, UNITS, n), dtype=np.float32)
    gates = np.empty((steps, 4 * UNITS, n), dtype=np.float32) if keep else None
    h = np.zeros((UNITS, n), dtype=np.float32)
    u = UNITS
    for t in range(steps):
        x = inputs.take(data[t], axis=1)
        g = recurrent @ h
        x[: 2 * u] += g[: 2 * u]
        zr = np.tanh(x[: 2 * u])  # the input weights of both gates hold the half
        zr += 1
        zr *= 0.5
        new = g[2 * u :] * zr[u:]
        new += x[2 * u :]
        np.tanh(new, out=new)
        if keep:
            gates[t, : 2 * u], gates[t, 2 * u : 3 * u], gates[t, 3 * u :] = zr, new, g[2 * u :]
        h = h - new
        h *= zr[:u]
        h += new
        states[t] = h
    return states, gates


def _halved(inputs, recurrent):
    """Weights with those of the two gates halved, as the tanh form of the sigmoid needs."""
    factor = np.ones((3 * UNITS, 1), dtype=np.float32)
    factor[: 2 * UNITS] = 0.5
    return inputs * factor, recurrent * factor


def probabilities(p: dict[str, np.ndarray], data: np.ndarray) -> np.ndarray:
    """(step, class, window): what each position is taken for."""
    forward, _ = _states(*_halved(p["in_f"], p["re_f"]), data)
    backward, _ = _states(*_halved(p["in_b"], p["re_b"]), data[::-1])
    logits = np.matmul(p["out"][:, :UNITS], forward)
    logits += np.matmul(p["out"][:, UNITS:], backward[::-1])
    logits += p["bias"]
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _state_gradients(inputs, recurrent, data, states, gates, d_states):
    """Gradients of input and recurrent weights, going back through all steps."""
    u = UNITS
    steps, n = data.shape
    d_inputs = np.empty((steps, 3 * u, n), dtype=np.float32)
    d_recurrent = np.zeros_like(recurrent)
    carry = np.zeros((u, n), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        before = states[t - 1] if t else np.zeros((u, n), dtype=np.float32)
        z, r, new, fed = (gates[t, k * u : (k + 1) * u] for k in range(4))
        d = carry + d_states[t]
        d_new = d * (1 - z) * (1 - new * new)
        d_inputs[t, :u] = d * (before - new) * z * (1 - z)
        d_inputs[t, u : 2 * u] = d_new * fed * r * (1 - r)
        d_inputs[t, 2 * u :] = d_new
        d_gates = d_inputs[t].copy()
        d_gates[2 * u :] *= r
        d_recurrent += d_gates @ before.T
        carry = d * z + recurrent.T @ d_gates
    flat = data.ravel()
    by_unit = d_inputs.transpose(1, 0, 2).reshape(3 * u, -1)
    d_in = np.stack([np.bincount(flat, weights=row, minlength=256) for row in by_unit])
    return d_in.astype(np.float32), d_recurrent


def gradients(p, data, target, counts):
    """Mean loss per position and its gradients. `counts` is 1 where a position counts."""
    sides = {}
    for side, seen in (("f", data), ("b", data[::-1])):
        halved = _halved(p[f"in_{side}"], p[f"re_{side}"])
        sides[side] = (seen, *_states(*halved, seen, keep=True))
    forward, backward = sides["f"][1], sides["b"][1][::-1]
    both = np.concatenate((forward, backward), axis=1)
    logits = np.matmul(p["out"], both) + p["bias"]
    logits -= logits.max(axis=1, keepdims=True)
    e = np.exp(logits)
    prob = e / e.sum(axis=1, keepdims=True)
    total = max(float(counts.sum()), 1.0)
    at = np.arange(data.shape[1])
    loss = -float((np.log(prob[:, target, at] + 1e-9) * counts).sum()) / total
    d = prob
    d[:, target, at] -= 1
    d *= counts[:, None, :] / total
    out = {
        "out": np.einsum("tcn,tun->cu", d, both, optimize=True),
        "bias": d.sum(axis=(0, 2))[:, None],
    }
    d_both = np.matmul(p["out"].T, d)
    for side, part in (("f", d_both[:, :UNITS]), ("b", d_both[::-1, UNITS:])):
        seen, states, gates = sides[side]
        out[f"in_{side}"], out[f"re_{side}"] = _state_gradients(
            p[f"in_{side}"], p[f"re_{side}"], seen, states, gates, part
        )
    return loss, out


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step, window) bytes in lower case, which positions count, and each window's text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    number = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(texts)), number)
    data = np.full(int(number.sum()) * WINDOW, 32, dtype=np.uint8)
    counts = np.zeros(len(data), dtype=bool)
    begin = (np.cumsum(number) - number) * WINDOW
    flat = LOWER[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    at = np.arange(len(flat)) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
    data[at], counts[at] = flat, True
    shape = (-1, WINDOW)
    return np.ascontiguousarray(data.reshape(shape).T), np.ascontiguousarray(counts.reshape(shape).T), owner


def train(texts: list[bytes], labels: list[int], classes: int, rounds: int = 240, batch: int = 256, rate: float = 0.02, seed: int = 1):
    """Parameters fitted by Adam on random batches of windows."""
    data, counts, owner = windows_of(texts)
    target = np.array(labels)[owner]
    draw = np.random.default_rng(seed)
    p = new_parameters(classes, seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    # every class is drawn as often, however often it occurs
    members = [np.flatnonzero(target == c) for c in range(classes)]
    members = [m for m in members if len(m)]
    for step in range(1, rounds + 1):
        take = np.concatenate([draw.choice(m, batch // len(members) + 1) for m in members])
        _, grad = gradients(p, data[:, take], target[take], counts[:, take].astype(np.float32))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        now = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        for k, g in grad.items():
            g = g / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            m, v = first[k] / (1 - 0.9**step), second[k] / (1 - 0.99**step)
            p[k] = (p[k] - now * m / (np.sqrt(v) + 1e-6)).astype(np.float32)
    return p


def pooled(p, texts: list[bytes], group: int = 4096) -> np.ndarray:
    """Mean probability of each class over all positions of each text."""
    data, counts, owner = windows_of(texts)
    classes = len(p["bias"])
    sums = np.zeros((len(texts), classes))
    for at in range(0, data.shape[1], group):
        prob = probabilities(p, data[:, at : at + group])
        prob *= counts[:, None, at : at + group]
        per_window = prob.sum(axis=0)
        for c in range(classes):
            sums[:, c] += np.bincount(owner[at : at + group], weights=per_window[c], minlength=len(texts))
    lengths = np.array([max(len(t), 1) for t in texts])
    return sums / lengths[:, None]
