"""Composite scores. Halves round to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _whole(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(c, 0).cast("int")))


def freshness(at: Column, now: Column) -> Column:
    """100 for now or later, falling to 0 in a day; 35 without a time."""
    hours = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / 3.6e9)
    return F.coalesce(_whole(100 * (1 - hours / 24)), F.lit(35))


def novelty(hours: Column) -> Column:
    """Steps by the age in hours; null means new."""
    out = F.lit(25)
    for most, score in ((120, 40), (72, 60), (24, 82), (6, 95)):
        out = F.when(hours <= most, score).otherwise(out)
    return F.when(hours.isNull(), 100).otherwise(out)


def signal_priority(relevance: Column, severity: Column, hours: Column) -> Column:
    """Weighted whole number; freshness falls by 4 an hour from 100, and is 100 for later times and without one."""
    fresh = F.coalesce(_whole(100 - 4 * F.greatest(F.lit(0.0), hours)), F.lit(100))
    return _whole(0.50 * relevance + 0.35 * severity + 0.15 * fresh)


#: Severity labels and relation names with their scores; the relation tables differ on purpose.
SEVERITY = {"critical": 100, "high": 75, "medium": 50, "low": 25, "info": 0}
RELATION_BASE = {"direct": 100, "indirect": 82, "potential": 60}
RELATION_NAME = {"direct": 100, "indirect": 82, "potential": 58}


def _named(c: Column, table: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, score in table.items():
        out = F.when(F.lower(c) == name, score).otherwise(out)
    return out


def severity_value(label: Column) -> Column:
    return _named(label, SEVERITY, 25)


def relation_score(relation: Column, confidence: Column) -> Column:
    return F.bround(_named(relation, RELATION_BASE, 0) * (0.8 + 0.2 * confidence / 100), 0).cast("int")


def relation_name_score(relation: Column) -> Column:
    return _named(relation, RELATION_NAME, 0)


def corroboration(families: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(15), 20 * families)).cast("int")


def diversity(kinds: Column) -> Column:
    return F.least(F.lit(100), 34 * kinds).cast("int")


def exposure(weight: Column, entities: Column, relation: Column) -> Column:
    base = F.coalesce(F.nullif(weight, F.lit(0)), F.lit(55))
    return _whole(base + F.least(F.lit(8), 2 * entities) + F.when(relation >= 95, 5).otherwise(0))


def importance(severity: Column, source: Column, corroborated: Column, fresh: Column) -> Column:
    return _whole(0.50 * severity + 0.18 * source + 0.17 * corroborated + 0.15 * fresh)


def priority(relevance: Column, severity: Column, new: Column, momentum: Column, exposed: Column, fresh: Column, resolved: Column) -> Column:
    """Weighted whole number; a resolved event has .78 of it, rounded again."""
    whole = _whole(0.30 * relevance + 0.25 * severity + 0.15 * new + 0.15 * momentum + 0.10 * exposed + 0.05 * fresh)
    return F.when(resolved, _whole(whole * 0.78)).otherwise(whole)


def confidence(best: Column, corroborated: Column, diverse: Column) -> Column:
    return _whole(0.55 * best + 0.30 * corroborated + 0.15 * diverse)


def signal_confidence(given: Column, verified: Column, media: Column) -> Column:
    guess = F.coalesce(F.nullif(given, F.lit(0)), F.when(verified, 65).when(media > 0, 55).otherwise(35))
    return F.greatest(F.lit(5), F.least(F.lit(95), guess)).cast("int")


def momentum(is_new: Column, sources: Column, more_sources: Column, more_evidence: Column, official: Column, worse: Column, escalates: Column, recent: Column) -> Column:
    """Of new events by their sources; of known ones by what changed, 12 if nothing did."""
    flag = lambda c, n: F.when(c, n).otherwise(0)
    extra = lambda c, each, most: F.least(F.lit(most), each * F.greatest(F.lit(0), c))
    spread = (more_sources > 0) | (more_evidence > 0)
    gain = extra(more_sources, 15, 30) + extra(more_evidence, 5, 22) + flag(official, 14) + flag(worse, 12) + flag(escalates, 10)
    known = F.when(gain == 0, 12).otherwise(18 + gain + flag(recent & spread, 8))
    return _whole(F.when(is_new, 55 + extra(sources - 1, 8, 15) + flag(escalates, 10)).otherwise(known))


def engagement(counts: Column, keys: list[str] = fixed.ENGAGEMENT) -> Column:
    """min(8, whole part of 3 * log10(total + 1)) of a map of counts, of which the named ones are added up."""
    total = F.lit(0).cast("bigint")
    for key in keys:
        total = total + F.coalesce(F.try_element_at(counts, F.lit(key)).cast("bigint"), F.lit(0))
    return F.least(F.lit(8), (F.log10(total + 1) * 3).cast("int"))


def tier_score(tier: Column, other: int = 50, scores: dict[int, int] = fixed.TIER_SCORES) -> Column:
    out = F.lit(other)
    for t, n in scores.items():
        out = F.when(tier == t, n).otherwise(out)
    return out


def evidence_score(social: Column, confidence: Column, media: Column, counts: Column, tier: Column) -> Column:
    """Of a social post its confidence (35 without one) with media and engagement, 5 to 90; of news by the source's tier."""
    said = F.coalesce(F.nullif(confidence.cast("int"), F.lit(0)), F.lit(35)) + F.least(F.lit(12), 4 * F.coalesce(media.cast("int"), F.lit(0))) + F.coalesce(engagement(counts), F.lit(0))
    return F.when(social, F.greatest(F.lit(5), F.least(F.lit(90), said))).otherwise(tier_score(tier)).cast("int")


def representative(official: Column, news: Column, tier: Column, severity: Column, fresh: Column) -> Column:
    """What makes a row stand for its event: its origin, the source's tier, severity and freshness."""
    return F.when(official, 20).when(news, 12).otherwise(0) + (5 - tier) * 10 + severity + fresh
