"""Registries of sources and specialists, the briefs that specialists return, and claims about contributions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from ..guards import Refused

#: Claims that a specialist may not make about itself.
OWN_WEIGHT = {"weight", "ensembleweight", "specialistweight", "trust", "trustscore"}
CALIBRATED = {"calibrated", "calibrationclaim", "calibrationclaimed", "calibrationsupported"}
DECISIONS = ("KEEP", "DROP", "UNDECIDED")


def _named(**texts: object) -> None:
    blank = [k for k, v in texts.items() if not isinstance(v, str) or not v.strip()]
    if blank:
        raise Refused(f"blank: {', '.join(blank)}")


def _aware(**times: datetime) -> None:
    naive = [k for k, v in times.items() if not isinstance(v, datetime) or v.tzinfo is None]
    if naive:
        raise Refused(f"times without a zone: {', '.join(naive)}")


def _finite(name: str, value: object) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise Refused(f"{name} must be a finite number")


class Registry:
    """Named things: a name is given once, and must be known to be used."""

    def __init__(self, things: Iterable = ()) -> None:
        self.things: dict[str, object] = {}
        for t in things:
            self.register(t)

    def register(self, thing) -> None:
        if thing.id in self.things:
            raise Refused(f"{thing.id} is registered")
        self.things[thing.id] = thing

    def get(self, name: str):
        if name not in self.things:
            raise Refused(f"{name} is not registered")
        return self.things[name]

    def list(self, **wanted) -> list:
        """Things whose fields have these values, by name."""
        return [t for _, t in sorted(self.things.items()) if all(getattr(t, k) == v for k, v in wanted.items())]


@dataclass(frozen=True)
class Source:
    """A source's contract. Forecast sources need a horizon and a rule of when they are published."""

    id: str
    domain: str
    country: str
    units: tuple[str, ...]
    timezone: str = "UTC"
    cadence: timedelta = timedelta(hours=1)
    is_forecast: bool = False
    horizon: timedelta | None = None
    publication_rule: str | None = None

    def __post_init__(self) -> None:
        _named(id=self.id, domain=self.domain, country=self.country)
        if not self.units or len(set(self.units)) != len(self.units) or self.cadence <= timedelta(0):
            raise Refused(f"{self.id}: units must be named once and the cadence positive")
        try:
            ZoneInfo(self.timezone)
        except (ZoneInfoNotFoundError, ValueError) as error:
            raise Refused(f"{self.id}: no time zone {self.timezone!r}") from error
        if self.is_forecast and (self.horizon is None or not self.publication_rule):
            raise Refused(f"{self.id}: a forecast needs a horizon and a publication rule")

    @classmethod
    def from_config(cls, config: dict) -> Source:
        known = set(cls.__dataclass_fields__)
        if set(config) - known - {"cadence_seconds", "horizon_seconds"}:
            raise Refused(f"unknown fields: {sorted(set(config) - known)}")
        own = {k: v for k, v in config.items() if k in known}
        for name in ("cadence", "horizon"):
            if f"{name}_seconds" in config:
                own[name] = timedelta(seconds=float(config[f"{name}_seconds"]))
        return cls(**own | {"units": tuple(config.get("units", ()))})


@dataclass(frozen=True)
class Specialist:
    id: str
    family: str
    returns: tuple[str, ...] = ("evidence",)
    enabled: bool = True


@dataclass(frozen=True)
class Brief:
    """What a specialist says: ``kind`` evidence (with its known_at) or forecast (with its fit_cutoff)."""

    specialist: str
    kind: str
    family: str
    issue_time: datetime
    known_at: datetime
    horizons: tuple[timedelta, ...]
    values: dict = field(default_factory=dict)
    uncertainty: dict = field(default_factory=dict)
    flags: tuple[str, ...] = ()
    oof_folds: tuple[str, ...] = ()
    target_time: datetime | None = None

    def __post_init__(self) -> None:
        _named(specialist=self.specialist, family=self.family)
        _aware(issue_time=self.issue_time, known_at=self.known_at)
        if self.kind not in ("evidence", "forecast") or (self.kind == "forecast" and self.target_time is None):
            raise Refused("a brief is evidence, or a forecast of a time")
        if not self.horizons or any(h <= timedelta(0) for h in self.horizons) or len(set(self.horizons)) != len(self.horizons):
            raise Refused("horizons must be positive and differ")
        if self.known_at > self.issue_time:
            raise Refused("known after its issue time")
        for name, value in self.values.items():
            _finite(name, value)
        plain = lambda text: text.casefold().replace("_", "").replace("-", "")
        if any(plain(k) in OWN_WEIGHT for k in self.uncertainty):
            raise Refused("a specialist cannot give itself trust or weight")
        claims = [k for k, v in self.uncertainty.items() if plain(k) in CALIBRATED and v not in (False, None)] + [f for f in self.flags if plain(f) in CALIBRATED]
        if claims and not self.oof_folds:
            raise Refused("a claim of calibration needs out-of-fold evidence")


@dataclass(frozen=True)
class Context:
    issue_time: datetime
    horizon: timedelta | None = None
    target_time: datetime | None = None
    known_at_cutoff: datetime | None = None


def run(registry: Registry, name: str, specialist: Callable, context: Context) -> Brief:
    """Calls one specialist and accepts a brief that keeps to its definition and the context; all else is refused."""
    definition = registry.get(name)
    if not definition.enabled:
        raise Refused(f"{name} is disabled")
    act = getattr(specialist, "run", None) or getattr(specialist, "produce", None) or specialist
    if not callable(act):
        raise Refused(f"{name} cannot be called")
    try:
        brief = act(context)
    except Refused:
        raise
    except Exception as error:
        raise Refused(f"{name} failed: {error}") from error
    wrong = {
        "no brief": not isinstance(brief, Brief),
        "another specialist's": isinstance(brief, Brief) and brief.specialist != name,
        "kind not registered": isinstance(brief, Brief) and brief.kind not in definition.returns,
        "another family": isinstance(brief, Brief) and brief.family != definition.family,
        "another issue time": isinstance(brief, Brief) and brief.issue_time != context.issue_time,
        "horizon not covered": isinstance(brief, Brief) and context.horizon is not None and context.horizon not in brief.horizons,
        "another target time": isinstance(brief, Brief) and brief.kind == "forecast" and context.target_time is not None and brief.target_time != context.target_time,
        "beyond the cutoff": isinstance(brief, Brief) and context.known_at_cutoff is not None and brief.known_at > context.known_at_cutoff,
    }
    broken = [k for k, v in wrong.items() if v]
    if broken:
        raise Refused(f"{name}: {', '.join(broken)}")
    return brief


def run_many(registry: Registry, specialists: dict[str, Callable], context: Context) -> list[Brief]:
    """All specialists, by name; one refusal refuses them all."""
    if not specialists:
        raise Refused("no specialists")
    return [run(registry, name, specialists[name], context) for name in sorted(specialists)]


@dataclass(frozen=True)
class Contribution:
    """What a component adds, or an ablation takes away: a claim from out-of-fold evidence only."""

    baseline: str
    component: str
    kind: str
    metric: str
    delta: float
    folds: tuple[str, ...]
    horizon: timedelta
    uncertainty: float | None = None
    decision: str = "UNDECIDED"
    evidence: tuple[str, ...] = ()
    scope: str = "OOF"

    def __post_init__(self) -> None:
        _named(baseline=self.baseline, component=self.component, metric=self.metric)
        _finite("delta", self.delta)
        if self.kind not in ("model", "specialist") or self.decision not in DECISIONS or self.horizon <= timedelta(0):
            raise Refused("unknown kind or decision, or no horizon")
        if not self.folds or len(set(self.folds)) != len(self.folds):
            raise Refused("folds must be named once each")
        if self.uncertainty is not None:
            _finite("uncertainty", self.uncertainty)
        if (self.uncertainty or 0) < 0:
            raise Refused("uncertainty must not be negative")
        if self.decision != "UNDECIDED" and not any(e.strip() for e in self.evidence):
            raise Refused("KEEP and DROP need evidence")
        if self.scope != "OOF":
            raise Refused("a contribution is claimed from out-of-fold evidence only")


def bind_targets(targets: list[str], sources: Registry, binding: dict[str, str]) -> dict[str, Source]:
    """The source of each target, in the order of ``targets``; other targets, and targets without one, are refused."""
    if set(binding) != set(targets) or len(set(targets)) != len(targets):
        raise Refused("each target needs one source, and no other may have one")
    return {t: sources.get(binding[t]) for t in targets}
