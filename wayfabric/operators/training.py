"""Training of the segmentation network: reverse-mode gradients in NumPy, Adam, and averaging over workers.

Every worker runs Adam over its share of the tiles for an epoch, from the weights broadcast to it; the
weights are averaged by tiles after the epoch. One worker is plain Adam over all tiles. What passes through the
driver is one set of weights per worker, not tiles. Arrays are (channels, tiles, height, width).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wayfabric.operators.network import EPS, LEVELS, Weights, random_weights
from wayfabric.operators.tiles import decoded, prepared
from wayfabric.scratch import materialize

# Tiles of a step, weights of the four losses, share of a step in the running statistics.
BATCH = 8
LOSS_WEIGHTS = (1.0, 1.0, 0.5, 0.5)
MOMENTUM = 0.1


class Var:
    """A value with the gradient that flows back to it."""

    def __init__(self, value: np.ndarray, parents: tuple[Var, ...] = (), back: Callable[[np.ndarray], tuple] | None = None):
        self.value, self.parents, self.back = value, parents, back
        self.grad: np.ndarray | None = None

    def backward(self) -> None:
        """Fill the gradients of everything that this scalar depends on."""
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p in v.parents]
        self.grad = np.ones_like(self.value)
        for v in reversed(order):
            if v.back is not None and v.grad is not None:
                for p, g in zip(v.parents, v.back(v.grad), strict=True):
                    p.grad = g if p.grad is None else p.grad + g


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sum a gradient over the axes along which its value was repeated."""
    axes = tuple(i for i, (n, m) in enumerate(zip(g.shape, shape, strict=True)) if n != m)
    return g.sum(axis=axes, keepdims=True) if axes else g


def add(a: Var, b: Var) -> Var:
    return Var(a.value + b.value, (a, b), lambda g: (_fit(g, a.value.shape), _fit(g, b.value.shape)))


def mul(a: Var, b: Var) -> Var:
    return Var(a.value * b.value, (a, b), lambda g: (_fit(g * b.value, a.value.shape), _fit(g * a.value, b.value.shape)))


def relu(x: Var) -> Var:
    return Var(np.maximum(x.value, 0), (x,), lambda g: (g * (x.value > 0),))


def sigmoid(x: Var) -> Var:
    s = 1 / (1 + np.exp(-x.value))
    return Var(s, (x,), lambda g: (g * s * (1 - s),))


def mean(x: Var, axes: tuple[int, ...]) -> Var:
    n = np.prod([x.value.shape[a] for a in axes])
    return Var(x.value.mean(axis=axes, keepdims=True), (x,), lambda g: (np.broadcast_to(g / n, x.value.shape),))


def largest(x: Var, axes: tuple[int, ...]) -> Var:
    """Maximum over axes; ties share the gradient."""
    top = x.value.max(axis=axes, keepdims=True)
    at = x.value == top
    return Var(top, (x,), lambda g: (g * at / at.sum(axis=axes, keepdims=True),))


def concat(a: Var, b: Var) -> Var:
    n = len(a.value)
    return Var(np.concatenate([a.value, b.value]), (a, b), lambda g: (g[:n], g[n:]))


def dense(w: Var, x: Var) -> Var:
    """Matrix times the channels of (channels, tiles, 1, 1)."""
    flat = x.value[:, :, 0, 0]
    return Var((w.value @ flat)[:, :, None, None], (w, x), lambda g: (g[:, :, 0, 0] @ flat.T, (w.value.T @ g[:, :, 0, 0])[:, :, None, None]))


def conv(x: Var, k: Var, dilation: int = 1) -> Var:
    """Zero-padded convolution that keeps the size."""
    cout, _, kh, kw = k.value.shape
    c, n, h, w = x.value.shape
    py, px = dilation * (kh // 2), dilation * (kw // 2)
    padded = np.pad(x.value, ((0, 0), (0, 0), (py, py), (px, px)))
    places = [(i, j, slice(i * dilation, i * dilation + h), slice(j * dilation, j * dilation + w)) for i in range(kh) for j in range(kw)]
    out = np.zeros((cout, n * h * w), dtype=x.value.dtype)
    for i, j, ys, xs in places:
        out += k.value[:, :, i, j] @ padded[:, :, ys, xs].reshape(c, -1)

    def back(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = np.ascontiguousarray(g).reshape(cout, -1)
        dk, dx = np.zeros_like(k.value), np.zeros_like(padded)
        for i, j, ys, xs in places:
            dk[:, :, i, j] = g @ padded[:, :, ys, xs].reshape(c, -1).T
            dx[:, :, ys, xs] += (k.value[:, :, i, j].T @ g).reshape(c, n, h, w)
        return dx[:, :, py : py + h, px : px + w], dk

    return Var(out.reshape(cout, n, h, w), (x, k), back)


def normalize(x: Var, p: Var, seen: dict[str, tuple[np.ndarray, np.ndarray]], name: str) -> Var:
    """Batch normalisation by rows 0 and 1 of ``p``; the batch's mean and unbiased variance go into ``seen``."""
    axes, count = (1, 2, 3), x.value[0].size
    centre = x.value.mean(axis=axes, keepdims=True)
    var = x.value.var(axis=axes, keepdims=True)
    seen[name] = (centre.ravel(), var.ravel() * count / max(count - 1, 1))
    root = np.sqrt(var + EPS)
    unit = (x.value - centre) / root
    scale, shift = p.value[0][:, None, None, None], p.value[1][:, None, None, None]

    def back(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dp = np.zeros_like(p.value)
        dp[0], dp[1] = (g * unit).sum(axis=axes), g.sum(axis=axes)
        gu = g * scale
        return (gu - gu.mean(axis=axes, keepdims=True) - unit * (gu * unit).mean(axis=axes, keepdims=True)) / root, dp

    return Var(unit * scale + shift, (x, p), back)


def halve(x: Var) -> Var:
    """2 x 2 maximum."""
    c, n, h, w = x.value.shape
    cut = Var(x.value.reshape(c, n, h // 2, 2, w // 2, 2), (x,), lambda g: (g.reshape(c, n, h, w),))
    top = largest(cut, (3, 5))
    return Var(top.value.reshape(c, n, h // 2, w // 2), (top,), lambda g: (g.reshape(c, n, h // 2, 1, w // 2, 1),))


def double_size(x: Var, k: Var, bias: Var) -> Var:
    """Transposed convolution with a 2 x 2 kernel and step 2."""
    c, n, h, w = x.value.shape
    d = k.value.shape[1]
    out = np.einsum("cnhw,cdij->dnhiwj", x.value, k.value, optimize=True).reshape(d, n, 2 * h, 2 * w) + bias.value[:, None, None, None]

    def back(g: np.ndarray) -> tuple[np.ndarray, ...]:
        cut = g.reshape(d, n, h, 2, w, 2)
        dx = np.einsum("dnhiwj,cdij->cnhw", cut, k.value, optimize=True)
        return dx, np.einsum("cnhw,dnhiwj->cdij", x.value, cut, optimize=True), g.sum(axis=(1, 2, 3))

    return Var(out, (x, k, bias), back)


def logits(x: np.ndarray, w: dict[str, Var], seen: dict) -> Var:
    """Logits (1, tiles, height, width); sizes are multiples of 8."""

    def double(x: Var, name: str, dilation: int = 1) -> Var:
        for i in range(2):
            x = relu(normalize(conv(x, w[f"{name}.conv{i}"], dilation), w[f"{name}.norm{i}"], seen, f"{name}.norm{i}"))
        return x

    def attend(x: Var, name: str) -> Var:
        def gate(pooled: Var) -> Var:
            return dense(w[f"{name}.excite"], relu(dense(w[f"{name}.squeeze"], pooled)))

        x = mul(x, sigmoid(add(gate(mean(x, (2, 3))), gate(largest(x, (2, 3))))))
        return mul(x, sigmoid(conv(concat(mean(x, (0,)), largest(x, (0,))), w[f"{name}.where"])))

    v, skips = Var(x), []
    for i in range(LEVELS):
        v = double(v, f"down{i}")
        skips.append(v)
        v = halve(v)
    v = attend(double(v, "middle", dilation=2), "middle.attention")
    for i in reversed(range(LEVELS)):
        v = double(concat(skips[i], double_size(v, w[f"up{i}.spread"], w[f"up{i}.bias"])), f"up{i}")
        if i:
            v = attend(v, f"up{i}.attention")
    bias = w["head.bias"]
    flat = Var(bias.value[:, None, None, None], (bias,), lambda g: (g[:, 0, 0, 0],))
    return add(conv(v, w["head.conv"]), flat)


def combined_loss(z: Var, t: np.ndarray, weights: tuple[float, float, float, float] = LOSS_WEIGHTS) -> Var:
    """Cross-entropy, Dice, IoU and boundary losses, weighted, of logits and targets (1, tiles, height, width)."""
    wb, wd, wi, we = weights
    y, n = z.value, t.shape[1]
    p = sigmoid(z)
    entropy = (np.maximum(y, 0) - y * t + np.log1p(np.exp(-np.abs(y)))).mean()
    axes = (0, 2, 3)
    both, sp, st = (p.value * t).sum(axis=axes, keepdims=True), p.value.sum(axis=axes, keepdims=True), t.sum(axis=axes, keepdims=True)
    union = sp + st - both
    dice, iou = 1 - (2 * both + 1) / (sp + st + 1), 1 - (both + 1) / (union + 1)
    overlap_grad = wd * (-2 * t * (sp + st + 1) + (2 * both + 1)) / (sp + st + 1) ** 2 + wi * (-t * (union + 1) + (both + 1) * (1 - t)) / (union + 1) ** 2
    cross = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], dtype=y.dtype)
    kernel = Var(np.stack([cross, cross.T])[:, None])

    def magnitude(v: np.ndarray) -> tuple[Var, np.ndarray]:
        g = conv(Var(v), kernel)
        return g, np.sqrt((g.value**2).sum(axis=0, keepdims=True) + 1e-6)

    (own, size), (_, want) = magnitude(p.value), magnitude(t.astype(y.dtype))
    border = np.abs(size - want).mean()
    edge_grad = own.back(np.sign(size - want) / size.size * own.value / size)[0]
    overlap = Var(np.asarray(wd * dice.mean() + wi * iou.mean() + we * border), (p,), lambda g: (g * (overlap_grad / n + we * edge_grad),))
    rest = Var(np.asarray(wb * entropy), (z,), lambda g: (g * wb * (1 / (1 + np.exp(-y)) - t) / t.size,))
    return Var(overlap.value + rest.value, (overlap, rest), lambda g: (g, g))


def loss_and_gradients(w: Weights, x: np.ndarray, t: np.ndarray) -> tuple[float, Weights, dict]:
    """(loss, gradients, batch statistics by norm) of tiles (tiles, 3, height, width) and targets (tiles, height, width)."""
    held, seen = {k: Var(v) for k, v in w.items()}, {}
    loss = combined_loss(logits(np.ascontiguousarray(x.transpose(1, 0, 2, 3)), held, seen), t[None])
    loss.backward()
    return float(loss.value), {k: v.grad if v.grad is not None else np.zeros_like(v.value) for k, v in held.items()}, seen


class Adam:
    """Adam's moments for a dictionary of arrays (fixed values: the usual decays 0.9 and 0.999)."""

    def __init__(self, rate: float):
        self.rate, self.turn, self.m, self.v = rate, 0, {}, {}

    def step(self, w: Weights, grads: Weights) -> None:
        self.turn += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            ahead, spread = self.m[k] / (1 - 0.9**self.turn), self.v[k] / (1 - 0.999**self.turn)
            w[k] = (w[k] - self.rate * ahead / (np.sqrt(spread) + 1e-8)).astype(np.float32)


def run_epoch(w: Weights, tiles: list[tuple], size: int, adam: Adam, rng: np.random.Generator, occlude: bool, augment: bool) -> float:
    """One pass over (size, img, mask) tiles in random order, changing ``w``; the mean loss of its steps."""
    losses = []
    order = rng.permutation(len(tiles))
    for at in range(0, len(order), BATCH):
        made = [prepared(*decoded(*tiles[i]), size, rng, occlude, augment) for i in order[at : at + BATCH]]
        loss, grads, seen = loss_and_gradients(w, np.stack([x for x, _ in made]), np.stack([t for _, t in made]))
        adam.step(w, grads)
        for name, (centre, var) in seen.items():
            w[name][2] += MOMENTUM * (centre - w[name][2])
            w[name][3] += MOMENTUM * (var - w[name][3])
        losses.append(loss)
    return float(np.mean(losses))


def train_network(
    tiles: DataFrame, size: int = 128, epochs: int = 3, rate: float = 1e-3, seed: int = 0, workers: int = 1, base: int = 24,
    occlude: bool = True, augment: bool = True, out: str | None = None, say: Callable[[str], None] | None = None,
) -> Weights:
    """Weights trained on rows (tile_id, size, img, mask), saved as ``out`` (.npz) if that is given.

    Each of ``workers`` tasks holds its share of the tiles as bytes. Its moments start anew every epoch when
    there are several workers; a single one keeps them. ValueError for no tiles or a size that is no multiple of 8.
    """
    if size % 8:
        raise ValueError(f"the size must be a multiple of 8, not {size}")
    spark = tiles.sparkSession
    names = ("tile_id", "size", "img", "mask")
    fixed = materialize(tiles.select(*names).repartition(workers, "tile_id") if workers > 1 else tiles.select(*names).coalesce(1), "tiles")
    if fixed.isEmpty():
        raise ValueError("no tiles to train on")
    w = random_weights(3, base, seed)
    rounds = [(e, e + 1) for e in range(epochs)] if workers > 1 else [(0, epochs)] if epochs else []
    for first, last in rounds:
        sent = spark.sparkContext.broadcast(w)

        def run(frames: Iterator[pd.DataFrame], sent=sent, first=first, last=last) -> Iterator[pd.DataFrame]:
            held = sorted(row for frame in frames for row in zip(*(frame[c] for c in names), strict=True))
            if not held:
                return
            own, adam = {k: v.copy() for k, v in sent.value.items()}, Adam(rate)
            for epoch in range(first, last):
                rng = np.random.default_rng([seed, epoch, int(held[0][0])])
                loss = run_epoch(own, [row[1:] for row in held], size, adam, rng, occlude, augment)
                flat = np.concatenate([v.ravel() for v in own.values()]).tobytes() if epoch == last - 1 else b""
                yield pd.DataFrame({"epoch": [epoch], "n": [len(held)], "loss": [loss], "w": [flat]})

        dealt = fixed.repartition(workers, "tile_id") if workers > 1 else fixed.coalesce(1)
        rows = dealt.mapInPandas(run, "epoch int, n long, loss double, w binary").collect()  # a row per worker and epoch
        sent.unpersist()
        for epoch in range(first, last):
            own = [r for r in rows if r["epoch"] == epoch]
            if say:
                say(f"epoch {epoch + 1}/{epochs} loss {sum(r['loss'] * r['n'] for r in own) / sum(r['n'] for r in own):.4f}")
        ends = [r for r in rows if r["epoch"] == last - 1]
        flat = sum(np.frombuffer(r["w"], dtype=np.float32).astype(np.float64) * r["n"] for r in ends) / sum(r["n"] for r in ends)
        sizes = np.cumsum([v.size for v in w.values()])[:-1]
        w = {k: part.reshape(w[k].shape).astype(np.float32) for k, part in zip(w, np.split(flat, sizes), strict=True)}
    if out:
        Path(out).parent.mkdir(parents=True, exist_ok=True)
        np.savez(out, **w)
    return w
