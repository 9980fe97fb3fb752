"""Settings of a search experiment; only those that have an effect."""

from __future__ import annotations

from dataclasses import dataclass, field

METHODS = ("range", "pivot", "anchor", "sae")


@dataclass(frozen=True)
class Config:
    method: str = "range"
    max_dist: tuple[int, ...] = field(default=(3,))
    k: int = 20
    num_anchors: int = 100
    seed: int = 42
    use_all: bool = True
    start_idx: int = 0
    end_idx: int = 0
    last_random: bool = False

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}, not {self.method!r}")
        if not 0 <= self.start_idx <= self.end_idx:
            raise ValueError("start_idx and end_idx must be 0 <= start <= end")
