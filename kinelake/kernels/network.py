"""Forward pass of the window network: dilated convolutions over time, averaged, and a small head an output.

All windows of a batch go through each layer as one matrix product.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np

#: Taps and dilations of the residual blocks, and what keeps a flat channel vector's norm from dividing by 0.
TAPS, DILATIONS, NORM_EPS = 3, (1, 2, 4), 1e-5
#: Heads by name: outputs and whether a softplus keeps them positive. The first two are required.
HEADS = {"mean": (1, True), "logvar": (1, False), "context": (5, False), "yaw": (2, False)}
REQUIRED = ("mean", "logvar")


def shapes(features: int, hidden: int, heads: tuple[str, ...] = REQUIRED) -> dict[str, tuple[int, ...]]:
    """Names and shapes of a network's weights; matrices map a row of inputs to a row of outputs."""
    out: dict[str, tuple[int, ...]] = {"input.weight": (features, hidden), "input.bias": (hidden,)}
    for i in range(len(DILATIONS)):
        out |= {f"block{i}.weight": (TAPS, hidden, hidden), f"block{i}.bias": (hidden,), f"block{i}.gain": (hidden,), f"block{i}.offset": (hidden,)}
    for head in heads:
        out |= {f"{head}.weight0": (hidden, hidden // 2), f"{head}.bias0": (hidden // 2,), f"{head}.weight1": (hidden // 2, HEADS[head][0]), f"{head}.bias1": (HEADS[head][0],)}
    return out


def random_weights(features: int, hidden: int, heads: tuple[str, ...] = REQUIRED, seed: int = 0) -> dict[str, np.ndarray]:
    """Untrained weights (float32) by seed, for tests and as a stand-in where no model is at hand."""
    rng = np.random.default_rng(seed)
    return {name: (rng.normal(0, 0.5, shape) / np.sqrt(shape[-2] if len(shape) > 1 else 1) + name.endswith("gain")).astype(np.float32) for name, shape in shapes(features, hidden, heads).items()}


def heads_of(weights: Mapping[str, np.ndarray]) -> tuple[str, ...]:
    return tuple(h for h in HEADS if f"{h}.weight0" in weights)


def problems(weights: Mapping[str, np.ndarray], features: int) -> list[str]:
    """What is missing, superfluous, of a wrong shape or not finite; empty for weights that can be run."""
    if "input.weight" not in weights or weights["input.weight"].ndim != 2:
        return ["input.weight is missing"]
    wanted = shapes(features, weights["input.weight"].shape[1], tuple(dict.fromkeys((*REQUIRED, *heads_of(weights)))))
    out = [f"{n} is missing" for n in wanted if n not in weights] + [f"{n} is unknown" for n in weights if n not in wanted]
    out += [f"{n} has shape {weights[n].shape}, not {s}" for n, s in wanted.items() if n in weights and weights[n].shape != s]
    return out + [f"{n} isn't finite" for n in wanted if n in weights and not np.isfinite(weights[n]).all()]


def dilated(h: np.ndarray, weight: np.ndarray, bias: np.ndarray, dilation: int) -> np.ndarray:
    """A convolution over time (windows x rows x channels) that keeps the number of rows; beyond the ends are zeros."""
    windows, rows, channels = h.shape
    reach = (len(weight) - 1) // 2 * dilation
    padded = np.pad(h, ((0, 0), (reach, reach), (0, 0)))
    taps = np.concatenate([padded[:, k * dilation : k * dilation + rows] for k in range(len(weight))], axis=2)
    return taps.reshape(windows * rows, -1) @ weight.reshape(-1, weight.shape[-1]).reshape(len(weight) * channels, -1) + bias


def forward(weights: Mapping[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    """Each head's outputs (windows x outputs) for normalised windows (windows x rows x features)."""
    windows, rows, _ = x.shape
    h = x @ weights["input.weight"] + weights["input.bias"]
    for i, dilation in enumerate(DILATIONS):
        y = dilated(h, weights[f"block{i}.weight"], weights[f"block{i}.bias"], dilation).reshape(windows, rows, -1)
        y = y - y.mean(axis=2, keepdims=True)
        y = y / np.sqrt((y * y).mean(axis=2, keepdims=True) + NORM_EPS) * weights[f"block{i}.gain"] + weights[f"block{i}.offset"]
        h = h + np.maximum(y, 0)
    z = h.mean(axis=1)
    out = {}
    for head in heads_of(weights):
        y = np.maximum(z @ weights[f"{head}.weight0"] + weights[f"{head}.bias0"], 0) @ weights[f"{head}.weight1"] + weights[f"{head}.bias1"]
        out[head] = np.logaddexp(0, y) if HEADS[head][1] else y
    return out
