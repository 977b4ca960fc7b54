"""Seeds, search spaces and the samplers that draw from them: random, Parzen estimators and Gaussian processes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class SeedBag:
    entropy_hex: str
    split_seed: int
    cv_seed: int
    sampler_seed: int
    model_seed: int


def seeds_from_hex(entropy_hex: str) -> SeedBag:
    """The four 31-bit seeds of a trial, from its recorded entropy alone."""
    children = np.random.SeedSequence(int(entropy_hex, 16)).spawn(4)
    return SeedBag(entropy_hex, *(int(c.generate_state(1)[0]) & 0x7FFFFFFF for c in children))


def trial_seeds(master: int | None, trial: int) -> SeedBag:
    """Seeds of a trial of a study; two trials of one master differ, and one trial is the same in every run."""
    words = np.random.SeedSequence(master, spawn_key=(trial,)).generate_state(4)
    return seeds_from_hex(f"{int.from_bytes(words.astype('<u4').tobytes(), 'little'):032x}")


@dataclass(frozen=True)
class Range:
    """A float or whole-number parameter; ``log`` samples its logarithm."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def unit(self, value: float) -> float:
        lo, hi, x = (math.log(v) if self.log else float(v) for v in (self.low, self.high, value))
        return (x - lo) / ((hi - lo) or 1.0)

    def value(self, unit: float) -> float | int:
        lo, hi = (math.log(v) if self.log else float(v) for v in (self.low, self.high))
        x = lo + min(max(unit, 0.0), 1.0) * (hi - lo)
        x = math.exp(x) if self.log else x
        return int(min(max(round(x), self.low), self.high)) if self.whole else x


@dataclass(frozen=True)
class Choice:
    options: tuple


Space = dict[str, Range | Choice]


def draw_random(space: Space, rng: np.random.Generator) -> dict:
    return {k: p.value(rng.random()) if isinstance(p, Range) else p.options[int(rng.integers(len(p.options)))] for k, p in space.items()}


def near(space: Space, params: dict, rng: np.random.Generator, width: float) -> dict:
    """Parameters around given ones: ranges move by a normal step, choices stay seven times in ten."""
    free = draw_random(space, rng)
    return {k: s.value(s.unit(params[k]) + rng.normal(0, width)) if isinstance(s, Range) else (params[k] if rng.random() < 0.7 else free[k]) for k, s in space.items()}


def draw_tpe(space: Space, history: list[tuple[dict, float]], rng: np.random.Generator, n_startup: int = 20, candidates: int = 24) -> dict:
    """Tree-structured Parzen estimator: candidates near the best quarter, ranked by good over bad density, all
    parameters of a candidate together. ``history`` holds values to be minimised."""
    if len(history) < n_startup:
        return draw_random(space, rng)
    ranked = [h for h, _ in sorted(history, key=lambda h: h[1])]
    n_good = max(1, math.ceil(0.25 * math.sqrt(len(ranked)) * 2))
    good, bad = ranked[:n_good], ranked[n_good:] or ranked

    def density(x: dict, past: list[dict]) -> float:
        width = max(0.05, len(past) ** -0.2 * 0.3)
        total = 1e-12
        for h in past:
            p = 1.0
            for k, s in space.items():
                if isinstance(s, Range):
                    p *= math.exp(-0.5 * ((s.unit(x[k]) - s.unit(h[k])) / width) ** 2) / width
                else:
                    p *= (1.0 + (x[k] == h[k]) * len(s.options)) / (2 * len(s.options))
            total += p
        return total / len(past)

    drawn = [near(space, good[int(rng.integers(len(good)))], rng, 0.15) for _ in range(candidates)]
    return max(drawn, key=lambda x: density(x, good) / density(x, bad))


#: Grids from which a Gaussian process takes the length scale of each coordinate and its noise (as a share of the signal).
SCALES = (0.08, 0.15, 0.3, 0.6, 1.2, 2.4, 5.0)
NOISES = (1e-6, 1e-4, 1e-2, 1e-1)
#: Passes over the coordinates when their scales are chosen.
SCALE_PASSES = 2


def place(space: Space, params: dict) -> list[float]:
    """A point of the unit cube: ranges by their unit, choices as corners at distance 1 of each other."""
    out: list[float] = []
    for k, s in space.items():
        out += [s.unit(params[k])] if isinstance(s, Range) else [(params[k] == o) * math.sqrt(0.5) for o in s.options]
    return out


def matern(a: np.ndarray, b: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Matern kernel of smoothness 5/2."""
    r = np.sqrt(5 * ((a[:, None, :] - b[None, :, :]) ** 2 / scales**2).sum(-1))
    return (1 + r + r * r / 3) * np.exp(-r)


class GaussianProcess:
    """Regression by Cholesky factors. Scales and noise are those of the largest marginal likelihood that a search over
    their grids finds: one scale for all coordinates first, then each coordinate's in turn."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.mean, self.unit = x, float(y.mean()), float(y.std()) or 1.0
        self.z = (y - self.mean) / self.unit
        tried = [self._fit(np.full(x.shape[1], s), noise) for s in SCALES for noise in NOISES]
        best = min(tried, key=lambda t: t[0])
        for _ in range(SCALE_PASSES):
            for k in range(x.shape[1]):
                for s in SCALES:
                    scales = best[1].copy()
                    scales[k] = s
                    best = min(best, self._fit(scales, best[2]), key=lambda t: t[0])
            best = min([best, *(self._fit(best[1], noise) for noise in NOISES)], key=lambda t: t[0])
        _, self.scales, self.noise, self.lower, self.half, self.signal = best

    def _fit(self, scales: np.ndarray, noise: float) -> tuple:
        n = len(self.x)
        lower = np.linalg.cholesky(matern(self.x, self.x, scales) + (noise + 1e-9) * np.eye(n))
        half = np.linalg.solve(lower, self.z)
        signal = max(float(half @ half) / n, 1e-12)  # the variance of largest likelihood
        return n * math.log(signal) + 2 * float(np.log(np.diag(lower)).sum()), scales, noise, lower, half, signal

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation at points."""
        cross = np.linalg.solve(self.lower, matern(self.x, x, self.scales))
        var = np.maximum(self.signal * (1 - (cross * cross).sum(0)), 1e-18)
        return self.mean + self.unit * (cross.T @ self.half), self.unit * np.sqrt(var)


def expected_improvement(mean: np.ndarray, sd: np.ndarray, best: float) -> np.ndarray:
    """How far below ``best`` a normal value lies on average, where it does."""
    z = (best - mean) / sd
    below = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    return (best - mean) * below + sd * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def draw_gp(space: Space, history: list[tuple[dict, float]], rng: np.random.Generator, n_startup: int = 10, candidates: int = 600) -> dict:
    """Gaussian process over the finished trials: of random candidates and some near the best trials, the one of the
    largest expected improvement. ``history`` holds values to be minimised; up to ``n_startup`` trials are random."""
    if len(history) < max(n_startup, 2) or not space:
        return draw_random(space, rng)
    x, y = np.array([place(space, h) for h, _ in history]), np.array([v for _, v in history], float)
    model = GaussianProcess(x, y)
    best = [h for h, _ in sorted(history, key=lambda h: h[1])[:4]]
    drawn = [draw_random(space, rng) for _ in range(candidates)]
    drawn += [near(space, h, rng, width) for h in best for width in (0.1, 0.03, 0.01) for _ in range(candidates // 12)]
    mean, sd = model.predict(np.array([place(space, c) for c in drawn]))
    return drawn[int(np.argmax(expected_improvement(mean, sd, float(y.min()))))]


SAMPLERS = {"random": lambda space, history, rng, n_startup: draw_random(space, rng), "tpe": draw_tpe, "gp": draw_gp}
#: Samplers that need a library of their own.
PLUGIN_SAMPLERS = ("hebo",)


def draw(sampler: str, space: Space, history: list[tuple[dict, float]], seed: int, n_startup: int = 20) -> dict:
    """Parameters of the next trial; one seed and history give the same draw."""
    if sampler in PLUGIN_SAMPLERS:
        raise ImportError(f"the sampler {sampler!r} needs its own library; built in: {sorted(SAMPLERS)}")
    if sampler not in SAMPLERS:
        raise ValueError(f"unknown sampler {sampler!r}; built in: {sorted(SAMPLERS)}")
    return SAMPLERS[sampler](space, history, np.random.default_rng(seed), n_startup)
