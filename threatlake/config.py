"""All tunables in one immutable value; operators take it as an argument."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class SkewConfig:
    """How keys that hold too many rows are cut into time slots.

    A key is *hot* when it holds at least ``min_rows`` rows and at least ``1/shares`` of the
    table, so there are never more than ``shares`` hot keys and a table of them is always
    small enough to broadcast. ``cell_us`` is the coarse time cell in which rows of hot keys
    are counted; a cell above the same share is cut again, evenly in time. Windows over tables of
    more than ``task_rows`` rows a task get more tasks.
    """

    shares: int = 20_000
    min_rows: int = 200_000
    cell_us: int = 3_600_000_000
    task_rows: int = 50_000


@dataclass(frozen=True)
class Config:
    # detection
    anomaly_gate: float = 0.65
    lookback_seconds: int = 300
    # safety
    shadow_mode: bool = True
    human_approval: bool = False
    high_confidence: float = 0.8
    medium_confidence: float = 0.5
    trusted_ips: tuple[str, ...] = ()
    cooldown_seconds: int = 600
    correlation_min_events: int = 3
    approval_expiry_seconds: int = 300
    auto_rollback_minutes: int = 30
    rollback_below: float = 0.65
    # streams: how late a row may be, and for how long a silent source is remembered
    watermark_seconds: int = 600
    memory_days: int = 30
    # impact model
    cost_per_blocked_request: float = 0.001
    requests_per_block: int = 500
    hours_per_threat: float = 0.083
    # adaptation
    ema_alpha: float = 0.1
    retrain_feedback_rows: int = 500
    retrain_fpr: float = 0.15
    true_negatives: int = 1000
    thresholds: dict[str, float] = field(
        default_factory=lambda: {"LOW": 0.30, "MEDIUM": 0.50, "HIGH": 0.65, "CRITICAL": 0.80}
    )
    bounds: dict[str, tuple[float, float]] = field(
        default_factory=lambda: {"LOW": (0.15, 0.45), "HIGH": (0.55, 0.90)}
    )
    # execution
    skew: SkewConfig = SkewConfig()
    # measured hot keys (operators.running.HotKeys); None lets each operator measure its own input
    hot: Any = None


DEFAULT = Config()
