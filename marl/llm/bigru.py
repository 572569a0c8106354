"""A bidirectional gated recurrent network over bytes, in numpy: inference, and training by backpropagation through time.

The squashing function is x (27 + x^2) / (27 + 9 x^2) on [-3, 3], tanh's Pade form, which ends flat at -1 and 1;
the gates' sigmoid is the same function, halved. Both cost a fraction of tanh itself.

Texts are cut into segments of `SEGMENT` bytes, state starts at zero in each. At every byte a forward and a
backward unit of `HIDDEN` cells give the probabilities of the classes at that position. Arrays are laid out
cells by segments, so each gate is one contiguous block; a byte's input weights are a column of a table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEGMENT, HIDDEN = 64, 8
#: Segments that run side by side; their states fit a core's cache.
WIDTH = 1024


@dataclass
class Direction:
    """Gates in rows: update (what is kept), reset, candidate."""

    table: np.ndarray  # (3 cells, 256)
    state: np.ndarray  # (3 cells, cells)


@dataclass
class Network:
    ahead: Direction
    back: Direction
    out: np.ndarray  # (classes, 2 cells)
    bias: np.ndarray  # (classes, 1)

    def arrays(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.state, self.back.table, self.back.state, self.out, self.bias]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Network:
        a, b, c, d, out, bias = arrays
        return cls(Direction(a, b), Direction(c, d), out, bias)


def new_network(classes: int, seed: int = 7, cells: int = HIDDEN) -> Network:
    rng = np.random.default_rng(seed)
    shape = [(3 * cells, 256), (3 * cells, cells)] * 2 + [(classes, 2 * cells)]
    made = [(rng.standard_normal(s) * (0.3 if s[1] == 256 else s[1] ** -0.5)).astype(np.float32) for s in shape]
    for table in (made[0], made[2]):
        table[:cells] += 1  # remember by default
    return Network.of([*made, np.zeros((classes, 1), np.float32)])


def segments(texts: list[bytes], size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segments, size) bytes with zeros behind each text, the number of real bytes of each, and segments a text (at least 1)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    count = np.maximum(1, -(-lengths // size))
    data = np.frombuffer(b"".join(t.ljust(n * size, b"\0") for t, n in zip(texts, count.tolist(), strict=True)), np.uint8)
    first = np.cumsum(count) - count
    place = np.arange(count.sum()) - np.repeat(first, count)
    return data.reshape(-1, size), np.clip(np.repeat(lengths, count) - place * size, 0, size), count


def _squash(x: np.ndarray, room: np.ndarray) -> None:
    """In place; room: two arrays of x's shape or more rows."""
    square, below = room[0][: len(x)], room[1][: len(x)]
    np.maximum(x, -3, out=x)
    np.minimum(x, 3, out=x)
    np.multiply(x, x, out=square)
    np.multiply(square, 9, out=below)
    below += 27
    square += 27
    x *= square
    x /= below


def _halved(d: Direction) -> tuple[np.ndarray, np.ndarray]:
    """Weights for gates by the squashing function t: a gate is (1 + t(x / 2)) / 2."""
    cells = d.state.shape[1]
    half = np.ones((3 * cells, 1), np.float32)
    half[: 2 * cells] = 0.5
    return np.ascontiguousarray(d.table * half), np.ascontiguousarray(d.state * half)


def _states(d: tuple[np.ndarray, np.ndarray], steps: np.ndarray, backward: bool) -> np.ndarray:
    """The states (time, cells, segments) of a direction over bytes (time, segments)."""
    table, state = d
    cells = state.shape[1]
    n = steps.shape[1]
    out = np.empty((len(steps), cells, n), np.float32)
    h = np.zeros((cells, n), np.float32)
    given, own = np.empty((3 * cells, n), np.float32), np.empty((3 * cells, n), np.float32)
    room = np.empty((2, 2 * cells, n), np.float32)
    gates, c = given[: 2 * cells], own[2 * cells :]
    keep, reset = gates[:cells], gates[cells:]
    for t in range(len(steps) - 1, -1, -1) if backward else range(len(steps)):
        np.take(table, steps[t], axis=1, out=given, mode="clip")
        np.matmul(state, h, out=own)
        gates += own[: 2 * cells]
        _squash(gates, room)
        gates *= 0.5
        gates += 0.5
        c *= reset
        c += given[2 * cells :]
        _squash(c, room)
        h = out[t]
        np.subtract(out[t - 1] if t and not backward else out[t + 1] if backward and t + 1 < len(steps) else 0, c, out=h)
        h *= keep
        h += c
    return out


def pooled(net: Network, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(segments, classes): the sums of each segment's position probabilities.

    Every block has WIDTH segments, the last one with empty ones behind it, so that a segment's sums don't depend
    on what stands beside it.
    """
    ahead, back = _halved(net.ahead), _halved(net.back)
    cells = net.ahead.state.shape[1]
    first, second = np.ascontiguousarray(net.out[:, :cells]), np.ascontiguousarray(net.out[:, cells:])
    sums = np.empty((len(data), len(net.out)), np.float64)
    for at in range(0, len(data), WIDTH):
        part, real = data[at : at + WIDTH], lengths[at : at + WIDTH]
        n = len(part)
        if n < WIDTH:
            part, real = np.pad(part, ((0, WIDTH - n), (0, 0))), np.pad(real, (0, WIDTH - n))
        steps = np.ascontiguousarray(part.T).astype(np.intp)
        score = np.matmul(first, _states(ahead, steps, False))
        score += np.matmul(second, _states(back, steps, True))
        score += net.bias
        np.exp(score, out=score)
        score /= score.sum(axis=1, keepdims=True)
        if real.min(initial=0) < part.shape[1]:
            score *= (np.arange(part.shape[1])[:, None] < real)[:, None, :]
        sums[at : at + WIDTH] = score.sum(axis=0).T[:n]
    return sums


# -- training ---------------------------------------------------------------------------------------------


def _squashed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The squashing function and its slope."""
    x = np.clip(x, -3, 3)
    q = x * x
    return x * (27 + q) / (27 + 9 * q), ((9 - q) / (9 + 3 * q)) ** 2


def _gate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value, slope = _squashed(0.5 * x)
    return 0.5 * value + 0.5, 0.25 * slope


def _run(d: Direction, steps: np.ndarray, order: range) -> dict[str, np.ndarray]:
    """All that the way back needs, by time."""
    cells, n = d.state.shape[1], steps.shape[1]
    kept = {k: np.zeros((len(steps), cells, n), d.state.dtype) for k in ("prev", "z", "r", "u", "c", "h", "dz", "dr", "dc")}
    h = np.zeros((cells, n), d.state.dtype)
    for t in order:
        given, own = d.table[:, steps[t]], d.state @ h
        (z, kept["dz"][t]), (r, kept["dr"][t]) = _gate(given[:cells] + own[:cells]), _gate(given[cells : 2 * cells] + own[cells : 2 * cells])
        u = own[2 * cells :]
        c, kept["dc"][t] = _squashed(given[2 * cells :] + r * u)
        kept["prev"][t], kept["z"][t], kept["r"][t], kept["u"][t], kept["c"][t] = h, z, r, u, c
        h = c + z * (h - c)
        kept["h"][t] = h
    return kept


def _back(d: Direction, steps: np.ndarray, order: range, kept: dict[str, np.ndarray], from_above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradients of a direction's table and state weights."""
    cells = d.state.shape[1]
    given = np.empty((len(steps), 3 * cells, steps.shape[1]), d.state.dtype)
    by_state = np.zeros_like(d.state)
    later = np.zeros_like(kept["h"][0])
    for t in reversed(order):
        z, r, u, c, prev = (kept[k][t] for k in ("z", "r", "u", "c", "prev"))
        dh = from_above[t] + later
        dc = dh * (1 - z) * kept["dc"][t]
        dz, dr = dh * (prev - c) * kept["dz"][t], dc * u * kept["dr"][t]
        own = np.concatenate([dz, dr, dc * r])
        given[t] = np.concatenate([dz, dr, dc])
        by_state += own @ prev.T
        later = dh * z + d.state.T @ own
    flat, at = given.transpose(1, 0, 2).reshape(3 * cells, -1), steps.ravel()
    return np.stack([np.bincount(at, weights=row, minlength=256) for row in flat]).astype(d.state.dtype), by_state


def loss_and_gradients(net: Network, data: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over real positions, and its gradients in the order of `Network.arrays`."""
    steps = data.T.astype(np.intp)
    order = range(len(steps))
    turned = range(len(steps) - 1, -1, -1)
    cells = net.ahead.state.shape[1]
    fore, hind = _run(net.ahead, steps, order), _run(net.back, steps, turned)
    both = np.concatenate([fore["h"], hind["h"]], axis=1)
    score = net.out @ both + net.bias
    score -= score.max(axis=1, keepdims=True)
    p = np.exp(score)
    p /= p.sum(axis=1, keepdims=True)
    real = (np.arange(len(steps))[:, None] < lengths) / max(1, int(lengths.sum()))
    at = np.arange(data.shape[0])
    loss = -float((np.log(p[:, labels, at] + 1e-30) * real).sum())
    d = p
    d[:, labels, at] -= 1
    d *= real[:, None, :]
    d = d.astype(net.out.dtype)
    by_out = np.einsum("tkn,tcn->kc", d, both, optimize=True)
    down = net.out.T @ d
    return loss, [
        *_back(net.ahead, steps, order, fore, down[:, :cells]),
        *_back(net.back, steps, turned, hind, down[:, cells:]),
        by_out,
        d.sum(axis=(0, 2))[:, None],
    ]


def train(data: np.ndarray, lengths: np.ndarray, labels: np.ndarray, classes: int, steps: int = 500, batch: int = 192, rate: float = 0.012, seed: int = 7) -> Network:
    """Adam on batches that hold the classes alike; deterministic for a seed."""
    rng = np.random.default_rng(seed)
    arrays = new_network(classes, seed).arrays()
    members = [m for m in (np.flatnonzero(labels == k) for k in range(classes)) if len(m)]
    first, second = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(m, -(-batch // len(members))) for m in members])
        cut = np.where(rng.random(len(pick)) < 0.25, rng.integers(8, data.shape[1] + 1, len(pick)), data.shape[1])
        real = np.minimum(lengths[pick], cut)
        seen = np.where(np.arange(data.shape[1]) < real[:, None], data[pick], 0)
        _, grads = loss_and_gradients(Network.of(arrays), seen, real, labels[pick])
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for a, g, m, v in zip(arrays, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(a.dtype)
    return Network.of(arrays)
