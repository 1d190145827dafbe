"""Settings of a run as frozen dataclasses; thresholds live here and nowhere else."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

# Default thresholds.
BPS, PCT, ABSOLUTE = "relative_bps", "relative_pct", "absolute"


@dataclass(frozen=True)
class Tolerance:
    kind: str
    value: float


@dataclass(frozen=True)
class Source:
    """A feed: price feeds vote, reference feeds (``reference=True``) bypass the quorum."""

    source_id: str
    enabled: bool = True
    staleness_max_days: int = 1
    reference: bool = False


@dataclass(frozen=True)
class Reconciliation:
    min_agreeing_sources: int = 2
    tolerances: dict[str, Tolerance] = field(
        default_factory=lambda: {
            "OPEN": Tolerance(BPS, 25.0),
            "HIGH": Tolerance(BPS, 25.0),
            "LOW": Tolerance(BPS, 25.0),
            "CLOSE": Tolerance(BPS, 25.0),
            "ADJ_CLOSE": Tolerance(BPS, 50.0),
            "VOLUME": Tolerance(PCT, 5.0),
        }
    )
    #: Keep rows with a high-severity failure out of the vote; off by default, when they vote like any other.
    exclude_high_severity_rows: bool = False


@dataclass(frozen=True)
class Quality:
    range_min: float = 0.0
    severities: dict[str, str] = field(
        default_factory=lambda: {
            "null_check": "high",
            "range_check": "high",
            "staleness_check": "high",
            "monotonicity_check": "medium",
            "duplicate_check": "medium",
        }
    )
    enabled: tuple[str, ...] = ("null_check", "range_check", "staleness_check", "monotonicity_check", "duplicate_check")


@dataclass(frozen=True)
class CorporateActions:
    ratio_tolerance: float = 0.05
    candidates: tuple[float, ...] = (2.0, 3.0, 1.5, 4.0)
    window_days: int = 30


@dataclass(frozen=True)
class Anomaly:
    window_days: int = 20
    zscore_threshold: float = 4.0
    iqr_multiplier: float = 1.5
    volatility_aware: bool = True
    regime_window: int = 5
    regime_ratio: float = 2.0


@dataclass(frozen=True)
class Remediation:
    max_retries: int = 3
    lookback_steps: tuple[int, ...] = (5, 20, 60)


@dataclass(frozen=True)
class Config:
    sources: tuple[Source, ...] = (Source("s1"), Source("s2"), Source("s3"))
    reconciliation: Reconciliation = field(default_factory=Reconciliation)
    quality: Quality = field(default_factory=Quality)
    corporate_actions: CorporateActions = field(default_factory=CorporateActions)
    anomaly: Anomaly = field(default_factory=Anomaly)
    remediation: Remediation = field(default_factory=Remediation)

    @property
    def voters(self) -> tuple[str, ...]:
        """Enabled price sources, sorted."""
        return tuple(sorted(s.source_id for s in self.sources if s.enabled and not s.reference))


def load(settings: dict[str, Any] | str | None = None) -> Config:
    """A ``Config`` with the given settings over the defaults; a string is the path of a YAML file.

    Keys are the field names; unknown ones raise, so that a typing slip doesn't pass for a default.
    """
    if isinstance(settings, str):
        import yaml

        with open(settings) as file:
            settings = yaml.safe_load(file)
    given = dict(settings or {})
    if "sources" in given:
        given["sources"] = tuple(Source(name, **(own or {})) for name, own in given["sources"].items())
    if "tolerances" in (own := given.get("reconciliation") or {}):
        given["reconciliation"] = own | {"tolerances": {name: Tolerance(t["kind"], float(t["value"])) for name, t in own["tolerances"].items()}}
    return _over(Config(), given)


def _over(base: Any, given: dict[str, Any]) -> Any:
    known = {f.name for f in fields(base)}
    if unknown := set(given) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    changes = {}
    for name, value in given.items():
        old = getattr(base, name)
        changes[name] = _over(old, value) if is_dataclass(old) and isinstance(value, dict) else tuple(value) if isinstance(old, tuple) else value
    return replace(base, **changes)


_SECRET = re.compile(r"(^|_)(API_?KEY|SECRET|TOKEN|PASSWORD|PASSWD|CREDENTIALS?)$", re.IGNORECASE)


def refuse_secrets(environment: Mapping[str, str] | None = None, prefix: str = "TESSERA_") -> None:
    """The engine needs no secrets: one of its own variables that is named like one is a mistake and raises."""
    names = os.environ if environment is None else environment
    if found := sorted(n for n in names if n.upper().startswith(prefix) and _SECRET.search(n)):
        raise RuntimeError(f"no secrets are needed; unset {', '.join(found)}")
