"""Thresholds, weights and calendars of the analytics, as frozen settings."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class OrderRules:
    """Which orders count. A NULL status never does."""

    excluded_statuses: tuple[str, ...] = ("Voided",)
    completed_status: str = "Completed"


@dataclass(frozen=True)
class MenuRules:
    # fixed values: percentile gates, score weights, flag thresholds
    high: float = 75.0
    low: float = 25.0
    weights: tuple[tuple[str, float], ...] = (
        ("demand_score", 0.25),
        ("profitability_score", 0.25),
        ("customer_signal_score", 0.15),
        ("wastage_health_score", 0.15),
        ("sales_trend_score", 0.10),
        ("promotion_independence_score", 0.10),
    )
    new_item_days: int = 30
    weekend_share: float = 0.60
    promotion_share: float = 0.50
    high_rating: float = 4.2
    low_rating: float = 3.0
    default_rating: float = 4.0


@dataclass(frozen=True)
class WasteRules:
    cost_ratio: float = 0.05
    quantity_ratio: float = 0.10
    decision: float = 0.50


@dataclass(frozen=True)
class ElasticityRules:
    pre_days: int = 28
    post_days: int = 28
    high: float = 1.50
    moderate: float = 0.75
    min_price_move: float = 1e-6
    prior_price_share: float = 0.95


@dataclass(frozen=True)
class PromotionRules:
    min_redemptions: int = 50
    min_margin: float = 0.10


@dataclass(frozen=True)
class RatingRules:
    z_low: float = -1.5
    poor_mean: float = 3.0
    busy_volume: int = 20
    negative_score: int = 2
    negative_rate: float = 0.30
    lone_week_std: float = 0.5


@dataclass(frozen=True)
class SalesRules:
    days: int = 14
    z_limit: float = 2.5


@dataclass(frozen=True)
class SplitDates:
    """Last day of each window; later days are the unseen comparison window."""

    train_end: str = "2025-08-31"
    validation_end: str = "2025-10-31"
    test_end: str = "2025-11-30"


@dataclass(frozen=True)
class DemandRules:
    same_weekday_rows: int = 4
    splits: SplitDates = field(default_factory=SplitDates)


@dataclass(frozen=True)
class StockRules:
    """Days of cover below and above which stock is short or long, and the reorder settings."""

    use_days: int = 28
    short_days: float = 7.0
    long_days: float = 60.0
    lead_days: int = 7
    service_level: float = 0.95


@dataclass(frozen=True)
class SlowRules:
    """Smoothing of sales and gaps, and the limits of the classes."""

    alpha: float = 0.1
    absence_days: int = 14
    slow_gap_days: float = 30.0
    declining: float = -0.25
    dormant_gaps: float = 3.0


@dataclass(frozen=True)
class ChurnRules:
    horizon_days: int = 60


@dataclass(frozen=True)
class SettlementRules:
    tax_rate: float = 0.0825
    tip_rate: float = 0.15
    tipped_channels: tuple[str, ...] = ("Dine-in", "Delivery Direct")


@dataclass(frozen=True)
class WhatIfDefaults:
    price: float = 15.0
    cost: float = 6.0
    volume: int = 1000
    elasticity: float = -0.85
    waste_share: float = 0.05
    discount_pull: float = 0.5


@dataclass(frozen=True)
class ScaleRules:
    """Row bounds below which a single task is known to be enough.

    A column of at most `broadcast_values` different values sends their ranks to every task.
    """

    one_task_rows: int = 200_000
    broadcast_values: int = 50_000
    small_basket: int = 64
    block_items: int = 1024
