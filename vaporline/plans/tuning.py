"""Sweeps over settings and objectives over their metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from itertools import product


@dataclass(frozen=True)
class Term:
    """A metric's part in an objective, brought to 0..1 by its bounds."""

    metric: str
    weight: float
    bounds: tuple[float, float] | None = None
    lower_is_better: bool = False
    required: bool = True

    def score(self, value: float) -> float:
        if self.bounds:
            low, high = self.bounds
            out = min(max((value - low) / (high - low), 0.0), 1.0)
        else:
            out = value if 0 <= value <= 1 else value / (1 + value) if value > 0 else 0.0
        return 1 - out if self.lower_is_better else out


@dataclass(frozen=True)
class Constraint:
    metric: str
    at_least: float = float("-inf")
    at_most: float = float("inf")

    def holds(self, metrics: Mapping[str, float]) -> bool:
        return self.metric in metrics and self.at_least <= metrics[self.metric] <= self.at_most


def evaluate(metrics: Mapping[str, float], terms: Sequence[Term], constraints: Sequence[Constraint] = (), tie_breaks: Sequence[Term] = ()) -> dict:
    """The weighted sum of terms if all required ones are there, and whether the
    constraints hold."""
    complete = all(t.metric in metrics for t in terms if t.required)
    sum_of = lambda ts: sum(t.weight * t.score(metrics[t.metric]) for t in ts if t.metric in metrics)
    return {"score": sum_of(terms) + sum_of(tie_breaks) if complete else None, "ready": complete and all(c.holds(metrics) for c in constraints)}


def variants(base, dimensions: Mapping[str, Sequence]) -> list:
    """The settings with every combination of the dimensions' values."""
    return [replace(base, **dict(zip(dimensions, values, strict=True))) for values in product(*dimensions.values())]


def sweep(base, dimensions: Mapping[str, Sequence], measure: Callable[[object], Mapping[str, float]], terms: Sequence[Term], constraints: Sequence[Constraint] = ()) -> list[tuple]:
    """(settings, evaluation) of every variant, the ready and best first."""
    found = [(s, evaluate(measure(s), terms, constraints)) for s in variants(base, dimensions)]
    return sorted(found, key=lambda x: (not x[1]["ready"], -(x[1]["score"] if x[1]["score"] is not None else float("-inf"))))
