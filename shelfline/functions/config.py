"""Frozen settings of feature sets; unknown fields and impossible values are refused."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

STRATEGIES = ("zero", "ffill", "bfill", "mean", "expanding_mean", "drop")
AGGREGATIONS = ("mean", "std", "min", "max", "sum")


def canonical_hash(value: dict, sort_keys: bool = False) -> str:
    """First 16 hex digits of the SHA-256 of compact JSON."""
    text = json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=sort_keys, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def _positive(name: str, values) -> None:
    if any(v < 1 for v in values):
        raise ValueError(f"{name} must be positive")


@dataclass(frozen=True, kw_only=True)
class _Settings:
    schema_version: str = "1.0"

    def config_hash(self) -> str:
        return canonical_hash(asdict(self))


@dataclass(frozen=True, kw_only=True)
class LagConfig(_Settings):
    lags: tuple[int, ...] = (1, 7, 14, 28)
    target_column: str = "quantity"
    fill_value: float | None = None

    def __post_init__(self):
        if not self.lags:
            raise ValueError("give at least one lag")
        _positive("lags", self.lags)


@dataclass(frozen=True, kw_only=True)
class RollingConfig(_Settings):
    windows: tuple[int, ...] = (7, 14, 28)
    aggregations: tuple[str, ...] = ("mean", "std")
    target_column: str = "quantity"
    min_periods: int | None = None

    def __post_init__(self):
        if not self.windows:
            raise ValueError("give at least one window")
        _positive("windows", self.windows)
        if unknown := set(self.aggregations) - set(AGGREGATIONS):
            raise ValueError(f"unknown aggregations {sorted(unknown)}")


@dataclass(frozen=True, kw_only=True)
class CalendarConfig(_Settings):
    include_day_of_week: bool = True
    include_month: bool = True
    include_quarter: bool = True
    include_year: bool = False
    include_is_weekend: bool = True
    include_is_month_end: bool = True
    include_is_holiday: bool = True
    use_cyclical_encoding: bool = True


@dataclass(frozen=True, kw_only=True)
class ExogenousConfig(_Settings):
    """``include_promo`` and ``include_inventory`` use columns ``on_promotion`` and ``on_hand_qty``, lagged by one row."""

    include_price: bool = True
    price_lags: tuple[int, ...] = (7, 28)
    include_price_change: bool = True
    include_promo: bool = False
    include_inventory: bool = False
    include_stockout_flag: bool = True

    def __post_init__(self):
        _positive("price_lags", self.price_lags)


@dataclass(frozen=True, kw_only=True)
class ImputationConfig(_Settings):
    """Column -> strategy, applied in this order.  ``bfill`` and ``mean`` look into the future."""

    strategies: dict[str, str] = field(
        default_factory=lambda: {"quantity": "zero", "unit_price": "ffill", "total_amount": "zero"}
    )

    def __post_init__(self):
        if unknown := set(self.strategies.values()) - set(STRATEGIES):
            raise ValueError(f"unknown strategies {sorted(unknown)}")


@dataclass(frozen=True, kw_only=True)
class FeatureSetConfig(_Settings):
    name: str = "features"
    description: str | None = None
    entity_columns: tuple[str, ...] = ("store_id", "product_id")
    date_column: str = "date"
    target_column: str = "quantity"
    lag_config: LagConfig | None = None
    rolling_config: RollingConfig | None = None
    calendar_config: CalendarConfig | None = None
    exogenous_config: ExogenousConfig | None = None
    imputation_config: ImputationConfig | None = None

    def enabled_features(self) -> list[str]:
        parts = {
            "lag": self.lag_config,
            "rolling": self.rolling_config,
            "calendar": self.calendar_config,
            "exogenous": self.exogenous_config,
        }
        return [name for name, part in parts.items() if part]
