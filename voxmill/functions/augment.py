"""Seeded augmentations of volumes: functions (array, generator) -> array, and a policy that chains them with probabilities."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from . import kernels as k

Step = Callable[[np.ndarray, np.random.Generator], np.ndarray]


def compose(steps: Sequence[tuple[float, Step]], share: float = 1.0) -> Callable[[np.ndarray, int], np.ndarray]:
    """Steps with their probabilities as one function of (array, seed); share is the probability of the whole policy."""

    def run(volume: np.ndarray, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        out = volume.astype(float)
        if rng.random() < share:
            for p, f in steps:
                if rng.random() < p:
                    out = f(out, rng)
        return np.ascontiguousarray(out)

    return run


def pad_to(shape: Sequence[int]) -> Step:
    """Zero padding, centred, where an axis is shorter than asked."""

    def f(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        more = [max(0, n - m) for n, m in zip(shape, v.shape, strict=True)]
        return np.pad(v, [(m // 2, m - m // 2) for m in more])

    return f


def gaussian_noise(variances: tuple[float, float] = (0.0, 0.05)) -> Step:
    """Noise whose deviation is the sampled variance, as the augmentation it follows has it."""
    return lambda v, rng: v + rng.normal(0, rng.uniform(*variances), v.shape)


def quarter_turn(axes: tuple[int, int]) -> Step:
    return lambda v, rng: np.rot90(v, rng.integers(0, 4), axes)


def flip(axis: int) -> Step:
    return lambda v, rng: np.flip(v, axis)


def transpose(axes: Sequence[int]) -> Step:
    return lambda v, rng: np.transpose(v, axes)


def rotate(limits: Sequence[float]) -> Step:
    """A turn about each axis by up to its limit in degrees."""

    def f(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        m = np.eye(3)
        for axis, limit in enumerate(limits):
            t = np.radians(rng.uniform(-limit, limit))
            turn = np.eye(3)
            a, b = [i for i in range(3) if i != axis]
            turn[a, a] = turn[b, b] = np.cos(t)
            turn[a, b], turn[b, a] = -np.sin(t), np.sin(t)
            m = turn @ m
        c = (np.asarray(v.shape) - 1) / 2
        return k.affine(v, m.T, c - m.T @ c)

    return f


def scale(limits: tuple[float, float]) -> Step:
    """A zoom within the volume's size."""

    def f(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return k.to_size(k.resample(v, rng.uniform(*limits)), v.shape)

    return f


def normalize() -> Step:
    def f(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return (v - v.mean()) / v.std() if v.std() > 0 else np.zeros_like(v)

    return f


def gamma(limits: tuple[float, float] = (0.8, 1.2)) -> Step:
    def f(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        span = v.max() - v.min()
        return ((v - v.min()) / (span or 1)) ** rng.uniform(*limits)

    return f


def center_crop(shape: Sequence[int]) -> Step:
    return lambda v, rng: v[tuple(slice((m - n) // 2, (m - n) // 2 + n) for m, n in zip(v.shape, shape, strict=True))]


def random_crop(shape: Sequence[int], inside: Callable[[np.ndarray], np.ndarray] | None = None) -> Step:
    """A crop at a random place, or around a random voxel of the mask that `inside` gives if it has any."""

    def f(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        room = np.asarray(v.shape) - shape
        low = rng.integers(0, room + 1)
        if inside is not None and len(spots := np.argwhere(inside(v))):
            low = np.clip(spots[rng.integers(len(spots))] - np.asarray(shape) // 2, 0, room)
        return v[tuple(slice(a, a + n) for a, n in zip(low, shape, strict=True))]

    return f


def elastic(sigma: float = 4.0, alpha: float = 2.0) -> Step:
    """Smooth random displacements of up to about alpha voxels, sampled at the nearest voxel."""

    def f(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        grid = np.indices(v.shape).astype(float)
        for axis in range(v.ndim):
            d = k.gaussian_blur(rng.uniform(-1, 1, v.shape), (sigma,) * v.ndim)
            grid[axis] += alpha * d / max(np.abs(d).max(), 1e-12)
        at = tuple(np.clip(np.rint(g), 0, n - 1).astype(int) for g, n in zip(grid, v.shape, strict=True))
        return v[at]

    return f


def remove_border(border: float = 0.0) -> Step:
    def f(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        at = np.argwhere(v > border)
        return v[tuple(slice(a, b + 1) for a, b in zip(at.min(0), at.max(0), strict=True))] if len(at) else v

    return f
