"""Settings: defaults, a JSON or YAML file over them, and environment variables over both."""

from __future__ import annotations

import json
import os
from copy import deepcopy
from pathlib import Path
from typing import Any

# The parameters with which results are stated.
DEFAULTS: dict[str, Any] = {
    "pairs": {"min_gap_days": 270, "max_gap_days": 550, "max_length_ratio": 3.0},
    "returns": {"horizon_rows": 21, "max_entry_lag_days": 7},
    "tickers": {"window_days": 400},
    "portfolio": {"quantiles": 5, "max_age_days": 365, "cost_bp": 10.0, "min_stocks": 100},
    "sections": {"min_words": 250, "max_heading_chars": 200},
    "excerpts": {"tokens": 500, "min_forward": 200, "retries": 1},
    "bars": {"ic": 0.02, "ic_t": 2.0, "sharpe_net": 0.5, "alpha_t": 2.0, "dsr": 0.95},
    "gates": {"signal_coverage": 0.80, "sections": 0.90, "scores": 0.95},
}
PREFIX = "TIDEMARK_"


def load_config(path: str | None = None, env: dict[str, str] | None = None) -> dict[str, Any]:
    """``TIDEMARK_PORTFOLIO__COST_BP=25`` sets ``portfolio.cost_bp``; unknown names are refused."""
    out = deepcopy(DEFAULTS)
    if path:
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            import yaml

            given = yaml.safe_load(text) or {}
        else:
            given = json.loads(text)
        for section, values in given.items():
            for name, value in values.items():
                _set(out, section, name, value)
    for key, raw in (os.environ if env is None else env).items():
        if key.startswith(PREFIX) and "__" in key:
            section, name = key.removeprefix(PREFIX).lower().split("__", 1)
            _set(out, section, name, json.loads(raw))
    return out


def _set(out: dict, section: str, name: str, value: Any) -> None:
    if name not in out.get(section, {}):
        raise KeyError(f"{section}.{name}")
    out[section][name] = value
