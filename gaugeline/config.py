"""Names, feature blocks and fusion suites. Column names are the package's own; numbers in the blocks below are
parameters of the method and are kept together here."""

from __future__ import annotations

# Feature blocks (one list per information source; D is a declared but empty source).
HISTORY = [
    "prev_value", "prev2_value", "gap_days", "gap_years", "roll3_mean", "roll3_std", "prev_change", "recent_trend",
    "hist_mean", "hist_std", "hist_min", "hist_max", "prior_count", "density", "long_gap", "very_long_gap",
]
CLIMATE = ["temp_mean", "precip_total", "rh_mean", "wind_mean", "solar_mean"]
SITE = ["lat", "lon", "elev"]
BLOCKS = {"a": HISTORY, "b": CLIMATE, "c": SITE, "d": []}

# Columns derived from the target's own interpolated surface: never allowed among predictors.
BANNED = ["raster_value", "surface_depth", "dem_elevation"]

# Gap thresholds in days (2 and 3 years), density window in calendar years.
LONG_GAP_DAYS = 730.5
VERY_LONG_GAP_DAYS = 1095.75
DENSITY_YEARS = 3

# Antecedent precipitation windows, dry and rainy day threshold (mm).
PRECIP_WINDOWS = [7, 14, 30, 60, 90, 180]
RAIN_THRESHOLD = 1.0

# Reference-population index inputs.
MOISTURE_INPUTS = ["precip_30d", "precip_180d", "rain_days_30d", "rh_mean_30d"]
DEMAND_INPUTS = ["temp_mean_30d", "radiation_30d", "wind_mean_30d", "dry_spell_days"]

# Fusion suites: which blocks, how they are combined, and which metadata columns ride along.
# combine: plain = standardized as is; equal = 1/k; source = constant source weight; row = per-row weight.
SUITES = {
    "A0": {"blocks": "a", "combine": "plain"},
    "A1": {"blocks": "ab", "combine": "plain"},
    "A2": {"blocks": "abc", "combine": "plain"},
    "A3": {"blocks": "abc", "combine": "plain", "reliability": True},
    "A4": {"blocks": "abc", "combine": "source", "reliability": True, "weights": True},
    "A5": {"blocks": "abc", "combine": "row", "reliability": True, "observability": True, "weights": True},
    "A6": {"blocks": "abc", "combine": "row", "reliability": True, "observability": True, "weights": True,
           "robustness": True},
    "B0": {"blocks": "a", "combine": "plain"},
    "B1": {"blocks": "ab", "combine": "plain"},
    "B2": {"blocks": "abc", "combine": "plain"},
    "B3": {"blocks": "abc", "combine": "source", "weights": True},
    "B4": {"blocks": "abc", "combine": "row", "weights": True},
    "B5": {"blocks": "abc", "combine": "row", "weights": True, "observability": True},
    "C0": {"blocks": "abc", "combine": "plain"},
    "C1": {"blocks": "abc", "combine": "plain", "reliability": True, "observability": True, "weights": True},
    "C2": {"blocks": "abc", "combine": "row", "reliability": True, "observability": True, "weights": True},
    "F1": {"blocks": "abc", "combine": "equal"},
}
