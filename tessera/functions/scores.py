"""Confidence, risk and history signals as columns. Numbers are fixed values of the scoring rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.schema import CONFIDENCE, CONFIDENCE_FROM

LEVELS = ("low", "medium", "high", "exact")


def confidence_rank(name: Column) -> Column:
    """0 for low to 3 for exact."""
    return (F.array_position(F.array(*map(F.lit, LEVELS)), name) - 1).cast("int")


def confidence_of_rank(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), rank)


def lower_confidence(left: Column, right: Column) -> Column:
    return F.when(confidence_rank(left) <= confidence_rank(right), left).otherwise(right)


def minimum_confidence(name: Column, empty: str = "exact") -> Column:
    """Aggregate: the lowest level of a group; `empty` where there is none."""
    return F.coalesce(confidence_of_rank(F.min(confidence_rank(name))), F.lit(empty))


def confidence_value(name: Column) -> Column:
    out = F.lit(None).cast("double")
    for level, value in CONFIDENCE.items():
        out = F.when(name == level, value).otherwise(out)
    return out


def confidence_from(score: Column) -> Column:
    out = F.lit("low")
    for name, least in reversed(CONFIDENCE_FROM):
        out = F.when(score >= least, name).otherwise(out)
    return out


def freshness(now: Column, at: Column, days: int = 7, old: str = "stale", new: str = "fresh") -> Column:
    """Old if more than `days` have passed."""
    return F.when((F.unix_micros(now) - F.unix_micros(at)) / 86_400_000_000 > days, old).otherwise(new)


def evidence_confidence(best: Column) -> Column:
    """Of the best of several scores, at least nothing: to two places. It isn't held to one."""
    return F.round(F.greatest(best, F.lit(0.0)), 2)


def reconciled(breakdown: Column, score: Column, fallback: str) -> Column:
    """Components (signal, contribution) with one more that makes them add up to the score, if they are off by over 0.001;
    without components, one for the whole score."""
    delta = score - F.aggregate(breakdown, F.lit(0.0), lambda s, c: s + c["contribution"])
    one = lambda name, value: F.array(F.struct(F.lit(name).alias("signal"), value.cast("double").alias("contribution")))
    return F.when(F.size(breakdown) == 0, one(fallback, score)).when(F.abs(delta) > 0.001, F.concat(breakdown, one("score_reconciliation", delta))).otherwise(breakdown)


def signal_value(breakdown: Column, *names: str) -> Column:
    """The largest of the named components' raw values and contributions, without sign; null if there are none."""
    named = F.filter(breakdown, lambda c: c["signal"].isin(*names))
    return F.array_max(F.transform(named, lambda c: F.greatest(F.abs(c["raw"]), F.abs(c["contribution"]))))


def plan_confidence(primary: Column, evidence: Column, exact: Column, tests: Column, runnable: Column, negative: Column, allowed: Column, runtime: Column) -> Column:
    """The overall score from counts: seven parts by weight, held down where context, support or certainty is missing."""
    density = F.when(primary == 0, 0.0).otherwise(F.least(evidence / F.greatest(primary * 2, F.lit(4)), F.lit(1.0)))
    references = F.when(exact > 0, 1.0).otherwise(0.25)
    available = F.when(tests > 0, 1.0).otherwise(0.2)
    doubts = F.when(negative == 0, 1.0).when(negative <= 2, 0.3).otherwise(0.1)
    narrow = F.when(primary == 0, 0.0).when(allowed == 0, 0.3).when(allowed <= 3, 1.0).when((allowed <= 8) & (allowed <= F.greatest(primary, F.lit(1)) * 2), 0.85).otherwise(0.45)
    seen = F.when(runtime > 0, 1.0).otherwise(0.25)
    covered = F.when(tests == 0, 0.2).when(runnable > 0, 1.0).otherwise(0.6)
    total = density * 0.20 + references * 0.20 + available * 0.15 + doubts * 0.15 + narrow * 0.15 + seen * 0.05 + covered * 0.10
    caveat = (exact == 0) | (tests == 0) | (runnable == 0) | (runtime == 0) | (allowed == 0) | (allowed > 8) | (density < 0.5)
    total = F.when(primary == 0, F.least(total, F.lit(0.35))).otherwise(total)
    total = F.when((exact == 0) & (tests == 0) & (runtime == 0), F.least(total, F.lit(0.55))).otherwise(total)
    total = F.when(negative > 0, F.least(total, F.lit(0.60))).otherwise(total)
    return F.when(caveat, F.least(total, F.lit(0.94))).otherwise(total)


def churn_signal(touches: Column, hotspot: Column) -> Column:
    return F.when(touches == 0, 0.0).when(hotspot >= 3.0, 0.12).when(hotspot >= 1.5, 0.07).otherwise(0.03)


def ownership_signal(authors: Column, reviewers: Column, touches: Column) -> Column:
    return F.when(authors >= 4, 0.12).when(authors >= 2, 0.07).when((authors == 1) & (reviewers == 0) & (touches > 0), 0.04).otherwise(0.0)


def reviewer_signal(reviewers: Column) -> Column:
    return F.when(reviewers > 0, F.least(0.04 + F.least(reviewers, F.lit(3)) * 0.02, F.lit(0.10))).otherwise(0.0)


def cochange_signal(neighbors: Column) -> Column:
    return F.least(F.least(neighbors, F.lit(3)) * 0.04, F.lit(0.12))


def similar_signal(best: Column) -> Column:
    """Of the best similar change's score; nothing where there is none."""
    value = F.least(F.greatest(F.greatest(F.least(best, F.lit(1.0)), F.lit(0.0)) * 0.18, F.lit(0.05)), F.lit(0.18))
    return F.when(best.isNull(), 0.0).otherwise(value)


HISTORY_CAPS = {"similar_change_overlap": 0.18, "history_churn": 0.12, "ownership_risk": 0.12, "reviewer_affinity": 0.10}


def history_cap(signal: Column) -> Column:
    out = F.lit(0.0)
    for name, cap in HISTORY_CAPS.items():
        out = F.when(signal == name, cap).otherwise(out)
    return out


def history_risk(churn: Column, ownership: Column, similar: Column) -> Column:
    """The three signals together, 0.25 at most."""
    return F.least(F.greatest(churn, F.lit(0.0)) + F.greatest(ownership, F.lit(0.0)) + F.greatest(similar, F.lit(0.0)), F.lit(0.25))


def churn_risk(touches: Column, hotspot: Column) -> Column:
    return F.when(F.coalesce(touches, F.lit(0)) == 0, 0.0).when(hotspot >= 3.0, 0.15).when(hotspot >= 1.5, 0.08).otherwise(0.03)


def complexity_risk(high: Column, medium: Column, low: Column) -> Column:
    """Of the numbers of facts by level."""
    return F.least(high * 0.18 + medium * 0.08 + low * 0.02, F.lit(0.25))


def similar_confidence(score: Column, sources: Column) -> Column:
    """By how many kinds of evidence there are."""
    high = ((sources >= 4) & (score >= 0.75)) | ((sources >= 3) & (score >= 0.55))
    return F.when(high, "high").when((sources >= 2) & (score >= 0.35), "medium").otherwise("low")


def author_score(share: Column, touches: Column, stale: Column, base: float, by_share: float, most: float) -> Column:
    """A share of touches as a score: few touches and old ones count less."""
    score = (base + by_share * share) * (0.60 + 0.40 * F.least(touches / 3.0, F.lit(1.0))) * F.when(stale, 0.55).otherwise(1.0)
    return F.least(score, F.lit(most))


ROLES = {"approver": 0.78, "reviewer": 0.72, "owner": 0.50, "committer": 0.40, "author": 0.35}


def review_score(role: Column, confidence: Column, stale: Column) -> Column:
    base = F.lit(None).cast("double")
    for name, value in ROLES.items():
        base = F.when(role == name, value).otherwise(base)
    return F.least((base + 0.10 * confidence_value(confidence)) * F.when(stale, 0.65).otherwise(1.0), F.lit(0.92))


def inferred_cap(owner: Column, author: Column) -> Column:
    return F.when(owner & author, 0.78).when(owner, 0.68).when(author, 0.62).otherwise(0.0)


AVAILABILITY = ("unavailable", "inferred_from_authors", "inferred_from_ownership", "inferred_from_ownership_and_authors", "actual_review_evidence")


def availability(actual: Column, owner: Column, author: Column) -> Column:
    return F.when(actual, AVAILABILITY[4]).when(owner & author, AVAILABILITY[3]).when(owner, AVAILABILITY[2]).when(author, AVAILABILITY[1]).otherwise(AVAILABILITY[0])


def report_availability(each: Column) -> Column:
    """Aggregate: the best of the suggestions' classes."""
    rank = F.array_position(F.array(*map(F.lit, AVAILABILITY)), each)
    return F.coalesce(F.get(F.array(*map(F.lit, AVAILABILITY)), (F.max(rank) - 1).cast("int")), F.lit(AVAILABILITY[0]))


def owner_weight(codeowners: Column, history: Column) -> Column:
    return F.when(codeowners, 0.58).when(history, 0.46).otherwise(0.30)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, one where there is nothing to reach."""
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def success_probability(risk_level: Column) -> Column:
    return F.when(risk_level == "low", 0.85).when(risk_level == "medium", 0.6).when(risk_level == "high", 0.3).when(risk_level == "critical", 0.1).otherwise(0.5)


def merged_messages(a: Column, b: Column, most: int = 8) -> Column:
    """Lines of both, each once, in order of text, the first `most`."""
    lines = F.array_sort(F.array_distinct(F.concat(F.split(a, "\n"), F.split(b, "\n"))))
    return F.array_join(F.slice(F.filter(lines, lambda x: x != ""), 1, most), "\n")


def message_metric(message: Column, name: str) -> Column:
    """The number that follows a name in a message, if one does."""
    return F.regexp_extract(message, rf"(?:^|[\s,]){name}[\s,]([^\s,]*)", 1).try_cast("double")
