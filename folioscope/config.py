"""Settings of the document-comparison operators; the defaults are fixed values of the method."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LayoutConfig:
    """Removal of running headers and footers, and sectioning."""

    ignore_patterns: tuple[str, ...] = ()
    header_patterns: tuple[str, ...] = ()
    footer_patterns: tuple[str, ...] = ()
    numeric_is_primary: bool = False
    repeat_ratio: float = 0.6
    top_band: float = 0.12
    bottom_band: float = 0.12
    fuzzy_threshold: float = 0.92
    line_gap: float = 2.0
    reliable_share: float = 0.8
    fallback_height: float = 1000.0


@dataclass(frozen=True)
class MatchConfig:
    """Alignment of the sections of two versions."""

    matched: float = 0.78
    low: float = 0.55
    title_weight: float = 0.65
    body_weight: float = 0.25
    anchor_weight: float = 0.05
    order_weight: float = 0.05
    title_norm_share: float = 0.35
    anchor_mismatch: float = 0.4
    metric: str = "sequence"
