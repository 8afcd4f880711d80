"""Frozen parameters of the stages. Each declares the range its value may take; the range is checked where an object is made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields


def within(default: float, low: float = 0.0, high: float = math.inf, share_of: str | None = None):
    """A parameter between low and high; those with one `share_of` must sum to 1."""
    return field(default=default, metadata={"low": low, "high": high, "share_of": share_of})


class Checked:
    """Base of parameter sets: every value in its range, every group of shares whole."""

    def __post_init__(self) -> None:
        whole: dict[str, float] = {}
        for f in fields(self):
            if "low" in f.metadata:
                value = getattr(self, f.name)
                if not f.metadata["low"] <= value <= f.metadata["high"]:
                    raise ValueError(f"{f.name} = {value} lies outside [{f.metadata['low']}, {f.metadata['high']}]")
                if f.metadata["share_of"]:
                    whole[f.metadata["share_of"]] = whole.get(f.metadata["share_of"], 0.0) + value
        for name, total in whole.items():
            if not math.isclose(total, 1.0, abs_tol=1e-9):
                raise ValueError(f"the shares of {name} sum to {total}")


# The defaults below are the published parameters of the stages.


@dataclass(frozen=True)
class ResolutionConfig(Checked):
    """Weights and limits of case resolution."""

    bm25_weight: float = within(0.75, 0, 1, "score")
    vector_weight: float = within(0.25, 0, 1, "score")
    threshold: float = within(0.40817840781035897, 0, 1)
    top_k: int = within(20, 1)
    k1: float = within(1.5)
    b: float = within(0.75, 0, 1)


@dataclass(frozen=True)
class AssociationConfig(Checked):
    """Weights and limits of the hierarchy."""

    semantic_weight: float = within(0.22, 0, 1, "association")
    evidence_weight: float = within(0.78, 0, 1, "association")
    threshold: float = within(0.19694262623786926)
    top_k: int = within(12, 1)
    max_cluster: int = within(20, 2)
    residual_role: str = "ROOT_CAUSE"
    residual_least: float = within(0.0317785682709644, 0, 1)
    residual_types: tuple[str, ...] = ("D_bge_high_structure_low", "safe_or_low_risk_control")


@dataclass(frozen=True)
class EventThresholds:
    equivalent: float = 0.65
    forbidden: float = 0.45
    equivalent_grid: tuple[float, ...] = (0.55, 0.60, 0.65, 0.70, 0.75)
    forbidden_grid: tuple[float, ...] = (0.35, 0.40, 0.45, 0.50, 0.55, 0.60)
    least_precision: float = 0.90
    most_violations: float = 0.10
