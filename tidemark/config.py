"""Typed settings: the asset universe, signal symbols, strategy parameters and presets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Asset:
    symbol: str
    category: str
    cluster: str | None = None  # "risk", "safe" or neither
    label: str = ""


# The universe, in the order that pairs and matrices use.
ASSETS = (
    Asset("QQQ", "stock", None, "Nasdaq 100"),
    Asset("IWM", "stock", "risk", "Small caps"),
    Asset("SPY", "stock", "risk", "Large caps"),
    Asset("TLT", "bond", "safe", "Long Treasuries"),
    Asset("GLD", "gold", "safe", "Gold"),
    Asset("BTC-USD", "crypto", "risk", "Bitcoin"),
)
SYMBOLS = tuple(a.symbol for a in ASSETS)
SIGNALS = SYMBOLS[1:]
BASE = "QQQ"
CATEGORY = {a.symbol: a.category for a in ASSETS}
CLUSTER = {a.symbol: a.cluster for a in ASSETS}
WINDOWS = (20, 30, 60)
YEAR = 252


def pairs(symbols: tuple[str, ...] = SYMBOLS) -> list[tuple[str, str]]:
    """Unordered pairs in universe order."""
    return [(a, b) for i, a in enumerate(symbols) for b in symbols[i + 1 :]]


def pair_kind(a: str, b: str) -> str:
    """``cross`` (risk first), ``risk``, ``safe`` or ``other``."""
    kinds = {CLUSTER[a], CLUSTER[b]}
    return "other" if None in kinds else kinds.pop() if len(kinds) == 1 else "cross"


@dataclass(frozen=True)
class Thresholds:
    """Classic regime thresholds."""

    pair_on: float = 0.50
    pair_off: float = -0.10
    score_on: float = 0.65
    score_off: float = 0.30
    pair_min: float = 0.20


@dataclass(frozen=True)
class Execution:
    """How a state is traded.  ``price`` is open_close, open_open (to the next row's open), open_before (from the
    open before) or close_close."""

    price: str = "open_close"
    delay: int = 1
    leverage: float = 3.0
    neutral_weight: float = 0.33
    neutral_leverage: float = 3.0
    floor: float = -0.99


# Execution presets.
EXECUTIONS = {
    "app": Execution(),
    "compare": Execution("open_open"),
    "ffl_runner": Execution("open_close", neutral_weight=1.0, neutral_leverage=1.0),
    "fusion_runner": Execution("open_open"),
    "close": Execution("close_close", neutral_weight=0.33, neutral_leverage=1.0),
    "tomorrow_open": Execution("open_open", neutral_weight=0.33, neutral_leverage=1.0),
    "flux5": Execution("close_close", neutral_weight=1.0, neutral_leverage=1.0),
    "web": Execution("close_close", neutral_weight=0.40, neutral_leverage=1.0),
    "compare_runner": Execution("open_before"),
    "golden": Execution("close_close", neutral_weight=1.0, neutral_leverage=1.0),
}


@dataclass(frozen=True)
class Newgate:
    """Fusion-Newgate parameters; the defaults are the base preset."""

    on_thr: float = 0.30
    off_thr: float = -0.30
    a_chi: float = 0.40
    b_eta: float = 0.20
    c_r: float = 0.30
    d_dr: float = 0.10
    kappa: float = 2.5
    theta: float = 0.0
    w_min: float = 0.10
    w_max: float = 0.90
    shock_z: float = 2.0
    band: tuple[float, float] = (0.33, 0.66)
    ew: dict = field(default_factory=lambda: {"tilt": 0.80, "dr": 0.80, "chi": 0.60, "fqi": 0.0, "dt": -0.25})
    g1: float = 0.66
    dr: dict = field(default_factory=lambda: {"tilt": 1.10, "dr": 1.10, "chi": 0.90, "fqi": -0.25})
    g2: float = 0.50
    cr_enabled: bool = True
    cr: dict = field(default_factory=lambda: {"dr": 0.90, "tilt": 0.80, "eta": 0.80, "fqi": 0.0, "zr": 0.40, "rsi": 50.0})
    g3: float = 0.50
    cr_hold: int = 3
    classic_off_gate: bool = False
    flow_off_gate: bool = False
    off_cap: float = 0.20
    stab_off_cap: float | None = None  # while the flow engine's absorption or flux says off
    stab_soft_cap: float | None = None  # while its absorption or guard is high
    stab_mm: tuple[float, float] = (0.88, 0.96)
    stab_j_off: float = -0.08
    stab_guard: float = 0.95
    window: int = 63


_CAREFUL = {"tilt": 0.85, "dr": 0.85, "chi": 0.60, "fqi": 0.0, "dt": -0.25}
_BOLD_EW, _BOLD_DR = {"tilt": 1.05, "dr": 1.05, "chi": 0.75, "fqi": -0.15, "dt": -0.35}, {"tilt": 1.25, "dr": 1.25, "chi": 1.10, "fqi": -0.35}

# The presets; a plus adds the caps of the flow engine's stability overlay.
NEWGATE = {
    "base": Newgate(),
    "defensive": Newgate(kappa=2.2, g2=0.33),
    "defensive_plus": Newgate(kappa=2.2, g2=0.33, stab_off_cap=0.20, stab_soft_cap=0.40),
    "balanced": Newgate(kappa=2.4, ew=_CAREFUL, g1=0.75, g3=0.66, cr_hold=2),
    "balanced_plus": Newgate(kappa=2.4, ew=_CAREFUL, g1=0.75, g3=0.66, cr_hold=2, stab_off_cap=0.20, stab_soft_cap=0.40),
    "aggressive": Newgate(
        kappa=3.0, w_min=0.05, w_max=0.98, ew=_BOLD_EW, g1=0.95, dr=_BOLD_DR, g2=0.90, cr={"dr": 1.10, "tilt": 0.95, "eta": 0.95, "fqi": -0.10, "zr": 0.60, "rsi": 45.0},
        g3=0.80, cr_hold=1, shock_z=2.4, band=(0.30, 0.60),
    ),
    "aggressive_plus": Newgate(
        kappa=3.0, w_min=0.05, w_max=0.98, ew=_BOLD_EW, g1=1.0, dr=_BOLD_DR, g2=1.0, cr={"dr": 1.10, "tilt": 0.95, "eta": 0.95, "fqi": -0.15, "zr": 0.60, "rsi": 45.0},
        g3=0.80, cr_hold=2, shock_z=2.4, band=(0.30, 0.60), on_thr=0.20, off_thr=-0.30,
    ),
}


@dataclass(frozen=True)
class Stab:
    """Stability overlay of the flow engine."""

    fast: int = 21
    slow: int = 63
    z_win: int = 126
    z_up: float = 2.5
    z_down: float = 2.5
    slope_min: float = 0.02
    neutral_lo: float = 0.30
    neutral_hi: float = 0.40
    lag_up: int = 3
    lag_down: int = 4
    up_confirm_off: int = 2
    lead_on: int = 6
    down_grace: int = 6
    hazard: int = 9


# A tuned overlay to compare with.
STAB_ASYMMETRIC = Stab(lag_down=3, up_confirm_off=1, lead_on=7, down_grace=3, hazard=10)


@dataclass(frozen=True)
class Exp:
    """Ratio gates and timing of the exp variant."""

    lam: float = 0.75
    r_on: float = 0.76
    r_off: float = -0.05
    breadth: float = 0.45
    win: int = 52
    on_k: float = 0.81
    off_k: float = 0.37
    high_scale: float = 1.25
    strong_k: float = 1.5
    both_when_high: bool = False


@dataclass(frozen=True)
class Flow:
    """Flow regime (FFL) parameters; ``variant`` is classic, exp or stab."""

    variant: str = "stab"
    j_on: float = 0.10
    j_off: float = -0.08
    q_on: float = 0.715
    q_off: float = 0.244
    quantile_rows: int = 50
    drift_days: int = 3
    drift_cool: int = 2
    mm_hi: float = 0.90
    mm_off: float = 0.96
    pcon_on: float = 0.55
    pcon_off: float = 0.40
    kappa_lambda: float = 1.0
    score_on: float = 0.60
    score_off: float = 0.40
    stab: Stab = Stab()
    exp: Exp = Exp()

    def with_(self, **changes) -> Flow:
        return replace(self, **changes)
