"""Row predicates and masks. A missing value never passes a test: predicates are two-valued."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sure(condition: Column) -> Column:
    """True or false, false where the condition is unknown."""
    return F.coalesce(condition, F.lit(False))


def good_shots(df: DataFrame, min_sensitivity: float = 0.95, night_only: bool = True) -> DataFrame:
    """Lidar shots of good quality; absent fields take values that fail (quality, degradation, sensitivity) or pass (sun)."""
    keep = (F.coalesce("quality_flag", F.lit(0)) == 1) & (F.coalesce("degrade_flag", F.lit(1)) == 0) & (F.coalesce("sensitivity", F.lit(0.0)) >= min_sensitivity)
    if night_only:
        keep &= F.coalesce("solar_elevation", F.lit(0.0)) < 0
    return df.where(keep)


def inside_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    w, s, e, n = box
    return sure(lon.between(w, e) & lat.between(s, n))


def near_box(x: Column, y: Column, box: tuple[float, float, float, float], buffer: float) -> Column:
    w, s, e, n = box
    return inside_box(x, y, (w - buffer, s - buffer, e + buffer, n + buffer))


def admission(density: Column, geoid: Column, month: Column, min_density: float, leaf_on: Sequence[int]) -> Column:
    """Array of the reasons against a survey; empty if it is admitted."""
    reasons = [
        F.when(density.isNull(), "density unknown").when(density < min_density, "density low"),
        F.when(geoid.isNull(), "geoid missing"),
        F.when(~sure(month.isin(*leaf_on)), "outside leaf-on months"),
    ]
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


def scan_angle_ok(angle: Column, most: float) -> Column:
    return sure(F.abs(angle) <= most)


def class_ok(classification: Column, dropped: Sequence[int]) -> Column:
    if not dropped:
        raise ValueError("no class to drop")
    return sure(~classification.isin(*sorted(set(dropped))))


def epoch_masks(first: Column, second: Column, bare_max: float, canopy_min: float, limit: float) -> dict[str, Column]:
    """Masks over two heights of a cell."""
    valid = first.isNotNull() & second.isNotNull()
    change = second - first
    canopy, loss = sure(valid & ((first + second) / 2 >= canopy_min)), sure(valid & (change < -limit))
    return {
        "valid": valid,
        "bare": sure(valid & (first < bare_max) & (second < bare_max)),
        "canopy": canopy,
        "disturbed": sure(valid & (F.abs(change) > limit)),
        "loss": loss,
        "stratum": canopy & ~loss,
        "stable": sure(valid & (F.abs(change) <= limit)),
    }


def masked(value: Column, keep: Column) -> Column:
    return F.when(keep, value)


def clamped_height(surface: Column, terrain: Column, low: float, high: float) -> Column:
    h = surface - terrain
    return F.when((h >= low) & (h <= high), h)


def spikes(top: Column, upper: Column, around: Column, min_top: float, max_around: float, min_gap: float) -> tuple[Column, Column]:
    """(isolated, wire-like): a high cell among low ones, and one whose top stands clear of its upper returns."""
    isolated = sure((top >= min_top) & (around <= max_around))
    return isolated, isolated & sure(top - upper >= min_gap)


def clean_screen(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds a flag for each exclusion rule and ``clean``, true where none holds."""
    flagged = df.withColumns({k: sure(v) for k, v in rules.items()})
    clean = F.lit(True)
    for k in rules:
        clean = clean & ~F.col(k)
    return flagged.withColumn("clean", clean)


def available_as_of(end: Column, cutoff: Column, target_start: Column) -> Column:
    """A survey may serve as input if it ended by the cutoff, which lies before the target's start."""
    return sure((end <= cutoff) & (cutoff < target_start))


def excludes_zero(low: Column, high: Column) -> Column:
    return sure((low > 0) | (high < 0))
