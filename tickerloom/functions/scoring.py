"""Scores as pure column functions of (columns, now, lambda)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.functions import vocabulary as v
from tickerloom.sources.domain import lookup


def trust_score(level: Column) -> Column:
    """1, .75, .5 or .25 by level; .5 for others."""
    return F.coalesce(lookup(v.TRUST, F.lower(level)), F.lit(0.5))


def age_seconds(created: Column, now: Column) -> Column:
    """Whole seconds between two timestamps without time zone."""
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    return seconds(now) - seconds(created)


def recency30(created: Column, now: Column) -> Column:
    """2.718 ** (-0.023 days), days rounded down and at least 0; .5 without a date."""
    days = F.greatest(F.lit(0), F.floor(age_seconds(created, now) / 86400))
    return F.when(created.isNull(), 0.5).otherwise(F.pow(F.lit(2.718), days * F.lit(-0.023)))


def recency_breaking(created: Column, now: Column, half_life_minutes: float) -> Column:
    """A half-life in minutes; .5 without a date, 0 for a half-life of 0 or less."""
    if half_life_minutes <= 0:
        return F.lit(0.0)
    minutes = F.greatest(F.lit(0.0), age_seconds(created, now) / 60)
    return F.when(created.isNull(), 0.5).otherwise(F.exp(minutes * F.lit(-math.log(2) / half_life_minutes)))


def impact_norm(impact: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), impact / 100)), F.lit(0.0))


@dataclass(frozen=True)
class Bias:
    """Channel bases that move with the opportunity bias, clamped to 0..1."""

    opportunity: float = 0.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "opportunity", min(1.0, max(0.0, self.opportunity)))

    @property
    def bases(self) -> dict[str, float]:
        x = self.opportunity
        return {
            "DIRECT_HOLDING": 0.9 - 0.5 * x,
            "WATCHLIST": 0.8,
            "THEMATIC": 0.6 + 0.3 * x,
            "VECTOR": 0.5 + 0.4 * x,
            "COMPETITOR": 0.4 + 0.3 * x,
            "SUPPLY_CHAIN": 0.6 - 0.2 * x,
            "PEER": 0.4 + 0.2 * x,
        }

    @property
    def half_life_minutes(self) -> float:
        return 60 + 120 * self.opportunity


def weight(which: str, client_type: Column) -> Column:
    """A client type's weight of semantic, graph, impact or recency."""
    at = ("semantic", "graph", "impact", "recency").index(which)
    special = {k: w[at] for k, w in v.WEIGHTS.items() if k != "default"}
    return F.coalesce(lookup(special, client_type), F.lit(v.WEIGHTS["default"][at]))


def position_boost(percentile: Column) -> Column:
    """.3 at the largest holding, 0 at the smallest."""
    return F.log2(F.lit(1.0) + percentile) * 0.3


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def completeness(positions: Column, mandate_type: Column, mandate_text: Column, esg: Column, contact: Column, frequency: Column) -> Column:
    """.35 positions + .35 mandate (type and text, half each) + .2 constraints + .1 engagement, to 2 digits."""
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    mandate = 0.5 * one(mandate_type.isNotNull()) + 0.5 * one(F.trim(mandate_text) != "")
    return F.round(0.35 * one(positions) + 0.35 * mandate + 0.20 * one(esg.isNotNull()) + 0.10 * one(contact.isNotNull() & frequency.isNotNull()), 2)
