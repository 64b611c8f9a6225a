"""Column contracts and fixed values of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values (they must equal those of other implementations for results to agree).
CADENCE_S = 300
HORIZON_STEPS = {"nowcast": 8, "6h": 72, "12h": 144}
DECODER_STEPS = 144
LOOKBACK_STEPS = 1152
ALERT_LOG10 = 3.0
QUANTILES = (0.1, 0.5, 0.9)
PROTON_KG = 1.67262192369e-27
L1_DISTANCE_KM = 1.5e6
DEFAULT_LAG_MIN = 47.0
MAD_TO_SIGMA = 1.4826
CDF_FILL = -1e31

MERGED_COLUMNS = (
    "flux_e2", "log_flux_e2", "flux_seed", "log_flux_seed", "vsw", "density", "pdyn", "bz_gsm", "bt", "ae", "al", "kp", "sym_h", "f107", "mlt", "longitude",
)
CDF_KINDS = {
    "goes": ("flux_e2", "flux_seed", "longitude", "mlt"), "omni": ("vsw", "density", "pdyn", "bz_gsm", "bt", "ae", "al", "kp", "sym_h", "f107"),
}
KNOWN_FUTURE = ("tod_sin", "tod_cos", "doy_sin", "doy_cos", "mlt_sin", "mlt_cos")
STATIC = ("sat_id", "longitude")


@dataclass(frozen=True)
class Grid:
    """How a frame is laid out: its time column, the columns that tell series apart, and the step in seconds."""

    time: str = "time"
    keys: tuple[str, ...] = ()
    step: int = CADENCE_S


@dataclass(frozen=True)
class Settings:
    """Parameters of the batch plan; a tree of these replaces a configuration file."""

    cadence_s: int = CADENCE_S
    lookback: int = LOOKBACK_STEPS
    decoder: int = DECODER_STEPS
    horizons: dict[str, int] = field(default_factory=lambda: dict(HORIZON_STEPS))
    threshold: float = ALERT_LOG10
    max_gap: int = 6
    hampel_window: int = 7
    hampel_sigma: float = 3.0
    train: float = 0.7
    val: float = 0.15
    stride: int = 1
    max_windows: int | None = None
    model: str = "persistence"
    params: dict = field(default_factory=dict)


def settings_from(tree: dict) -> Settings:
    """Settings from a parsed YAML or JSON tree; a nested `model` tree with `name` gives its other keys as params."""
    tree = dict(tree)
    if isinstance(tree.get("model"), dict):
        model = dict(tree["model"])
        tree["model"] = model.pop("name", "persistence")
        tree["params"] = {**model, **tree.get("params", {})}
    if unknown := set(tree) - set(Settings.__dataclass_fields__):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Settings(**tree)
