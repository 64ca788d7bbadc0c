"""Default parameters. They must equal the published study's settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Costs:
    pip_size: float = 0.0001
    commission_pips_per_side: float = 0.35
    slippage_pips_per_side: float = 0.10
    stress_slippage_pips_per_side: float = 0.20
    fixed_risk_usd: float = 30.0
    usd_per_pip_per_lot: float = 10.0


@dataclass(frozen=True)
class Session:
    """A named local session: opens at ``open_hour`` local, ends at ``end_hour`` in ``end_tz``."""

    name: str
    tz: str
    open_hour: int
    end_tz: str
    end_hour: int
    open_minute: int = 0
    end_minute: int = 0


FX_TZ = "America/New_York"
FX_BOUNDARY_HOUR = 17
LONDON = Session("london", "Europe/London", 8, "America/New_York", 8)
NEW_YORK = Session("new_york", "America/New_York", 8, FX_TZ, FX_BOUNDARY_HOUR)
SESSIONS = (LONDON, NEW_YORK)
PERIODS = {2024: "construction", 2025: "replication"}

# timeframe -> minutes
TIMEFRAMES = {"15min": 15, "1H": 60, "4H": 240, "1D": 1440}


@dataclass(frozen=True)
class LabelParams:
    atr_period: int = 14
    min_coverage: float = 0.95
    swing_left: int = 2
    swing_right: int = 2
    equal_tolerance_pips: float = 1.0
    pip_size: float = 0.0001
    break_buffer_atr: float = 0.05
    displacement_body_atr: float = 0.80
    gap_min_atr: float = 0.10
    gap_max_age: int = 24
    zone_tolerance_atr: float = 0.20
    zone_min_touches: int = 2
    zone_max_age: int = 500
    ob_lookback: int = 6
    ob_max_age: int = 50
    sweep_excursion_atr: float = 0.05


# concept -> (name of the parameter, its field in LabelParams, values compared with the primary one)
VARIANTS: dict[str, tuple[str, str, tuple]] = {
    "swing": ("right_bars", "swing_right", (1, 3)),
    "swing_relationship": ("equality_tolerance_pips", "equal_tolerance_pips", (0.5, 1.5)),
    "structure_break": ("buffer_atr", "break_buffer_atr", (0.0, 0.10)),
    "fair_value_gap": ("minimum_size_atr", "gap_min_atr", (0.0, 0.20)),
    "support_resistance": ("cluster_tolerance_atr", "zone_tolerance_atr", (0.10, 0.30)),
    "order_block_candidate": ("candidate_lookback_bars", "ob_lookback", (3, 9)),
    "order_block_lifecycle": ("maximum_age_bars", "ob_max_age", (25, 100)),
}

# named rule sets for the candidate filters
FILTER_RULES: dict[str, tuple[str, ...]] = {
    "f1_displacement": ("displacement",),
    "f2_h1_opposition_veto": ("h1_opposition_veto",),
    "f3_h4_opposition_veto": ("h4_opposition_veto",),
    "f4_h1_h4_opposition_veto": ("h1_opposition_veto", "h4_opposition_veto"),
    "f5_displacement_h4_veto": ("displacement", "h4_opposition_veto"),
    "f6_displacement_h1_h4_veto": ("displacement", "h1_opposition_veto", "h4_opposition_veto"),
}
STOP_GRID = (1.0, 1.25, 1.5, 2.0)
FIXED_TARGET_ATR = 2.0
RR_TARGET_MULTIPLE = 2.0
HORIZONS = (15, 30, 60, 120, 240)
BASELINE_RULES = (
    "event_direction",
    "seeded_random_direction",
    "session_momentum",
    "session_mean_reversion",
    "four_bar_close_breakout",
)
SEED = 20260901
