"""Parameters of a localisation run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LocalizationConfig:
    """Weights and limits; the defaults are the pipeline's."""

    vsm_weight: float = 0.12
    log_weight: float = 1.0
    path_weight: float = 1.0
    path_vsm_share: float = 0.2
    damping: float = 0.85
    smoothing: float = 1.0
    upstream_depth: int = 1
    segment_size: int = 800
    language: str = "java"
    top: int = 5
    #: Accept execution chains one by one in report order; else the union of all.
    greedy_chains: bool = True
