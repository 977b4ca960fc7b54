"""Pruners: whether a trial ends after the folds it has, given those of other trials."""

from __future__ import annotations

import math
from itertools import product
from statistics import fmean, median

#: Of the trials at a rung, one in so many goes on.
ETA = 3


def signed_rank_p(diffs: list[float]) -> float:
    """One-sided p of the Wilcoxon signed-rank test that the differences lie above 0: zeros are left out, ties share
    mid-ranks; exact up to 12 values, normal beyond."""
    d = [x for x in diffs if x]
    if not d:
        return 1.0
    size = sorted(abs(x) for x in d)
    ranks = [(size.index(abs(x)) + 1 + len(size) - size[::-1].index(abs(x))) / 2 for x in d]
    plus = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
    if len(d) <= 12:
        sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in product((0, 1), repeat=len(d))]
        return sum(s >= plus for s in sums) / len(sums)
    sd = math.sqrt(sum(r * r for r in ranks) / 4)
    return 0.5 * math.erfc((plus - sum(ranks) / 2 - 0.5) / sd / math.sqrt(2))


def brackets(most: int, eta: int = ETA) -> list[list[tuple[int, int]]]:
    """The brackets of Hyperband for trials of ``most`` folds, from the most to the least eager to prune.

    A bracket is a list of rungs (trials, folds): each rung has one in ``eta`` trials of the rung before and ``eta`` times
    its folds; the last one has all folds. All brackets cost about the same. An eager bracket begins with many trials of
    few folds, the last one runs its few trials in full.
    """
    if most < 1 or eta < 2:
        raise ValueError(f"brackets of {most} folds and one in {eta}")
    last = 0
    while eta ** (last + 1) <= most:
        last += 1
    out = []
    for s in range(last, -1, -1):
        n = -(-(last + 1) * eta**s // (s + 1))
        out.append([(n // eta**i, most // eta ** (s - i)) for i in range(s + 1)])
    return out


def bracket_of(number: int, most: int, eta: int = ETA) -> int:
    """The bracket of a trial: trials fill one bracket after the other by their numbers, then begin anew."""
    sizes = [b[0][0] for b in brackets(most, eta)]
    at = number % sum(sizes)
    for i, n in enumerate(sizes):
        if at < n:
            return i
        at -= n
    raise AssertionError


def stays(mine: float, others: list[float], eta: int = ETA) -> bool:
    """Whether a value is among the best one in ``eta`` (one at least) of all that reached its rung, itself included."""
    return sum(o < mine for o in others) < max(1, (len(others) + 1) // eta)


PRUNERS = ("none", "median", "wilcoxon", "successive_halving", "hyperband")


def prunes(pruner: str, scores: list[float], others: list[list[float]], maximize: bool, n_startup: int = 5, number: int = 0, n_folds: int | None = None, peers: dict[int, list[float]] | None = None) -> bool:
    """Whether a trial with these fold scores ends here. ``others``: fold scores of the finished trials.

    median: the mean so far is worse than the median of theirs at this fold. wilcoxon: after two folds, the scores are
    worse than the best trial's at p < 0.1. successive_halving: at folds 1, 2, 4, ... the trial is not in the better half.
    hyperband: ``number`` gives the trial its bracket; at the bracket's rungs before the last it goes on only among the
    best one in ETA of the trials of its bracket that came so far. ``peers`` has the scores of all earlier trials by
    number, pruned ones too, as they reached their rungs; ``n_folds`` is what a whole trial has.
    """
    if pruner not in PRUNERS:
        raise ValueError(f"unknown pruner {pruner!r}; known: {PRUNERS}")
    sign, k = (-1 if maximize else 1), len(scores)
    mine = [sign * s for s in scores]
    if pruner == "hyperband":
        most = n_folds or max([k, *map(len, others)])
        own = bracket_of(number, most)
        if k not in [folds for _, folds in brackets(most)[own][:-1]]:
            return False
        met = [fmean(sign * s for s in x[:k]) for t, x in (peers or {}).items() if t != number and len(x) >= k and bracket_of(t, most) == own]
        return not stays(fmean(mine), met)
    past = [[sign * s for s in o[:k]] for o in others if len(o) >= k]
    if pruner == "none" or not past or not k:
        return False
    if pruner == "wilcoxon":
        best = min((o for o in others if len(o) >= k), key=lambda o: sign * fmean(o))
        return k >= 2 and signed_rank_p([m - sign * b for m, b in zip(mine, best[:k], strict=True)]) < 0.1
    if len(past) < (n_startup if pruner == "median" else 2):
        return False
    means = sorted(fmean(o) for o in past)
    if pruner == "median":
        return fmean(mine) > median(means)
    return k & (k - 1) == 0 and fmean(mine) > means[min(len(means) - 1, len(means) // 2)]
