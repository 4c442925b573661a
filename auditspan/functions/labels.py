"""Severity ranks, finding labels, fingerprints and state expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import blank_to_null, lookup, safe_int, strip, truncate


def severity_rank(c: Column, unknown: int = 9) -> Column:
    """critical 0 ... info 4."""
    return lookup(c, {s: i for i, s in enumerate(fixed.SEVERITIES)}, unknown)


def severity_weight(c: Column) -> Column:
    """critical 4 ... info 0, unknown or missing 2."""
    low = F.lower(F.coalesce(c, F.lit("medium")))
    return lookup(low, {s: 4 - i for i, s in enumerate(fixed.SEVERITIES)}, 2)


def risk_rank(c: Column, unknown: int = 2) -> Column:
    return lookup(c, {r: i for i, r in enumerate(fixed.RISK_VALUES)}, unknown)


def risk_points(severity: Column) -> Column:
    return lookup(severity, fixed.RISK_WEIGHTS, 0.0)


def risk_score(points: Column) -> Column:
    return F.round(100 * (1 - 1 / (1 + points / 25)), 1)


def risk_band(score: Column) -> Column:
    return F.when(score >= 66, "high").when(score >= 33, "medium").otherwise("low")


def stage_order(stage: Column) -> Column:
    return lookup(stage, {s: i for i, s in enumerate(fixed.STAGES)}, 99)


def is_open(state: Column) -> Column:
    return state != "dismissed"


def truthy(c: Column) -> Column:
    """NULL for NULL and for the empty string."""
    return blank_to_null(c)


def cwe_prefix(cwe: Column) -> Column:
    return strip(F.split_part(cwe, F.lit(":"), F.lit(1)))


def cwe_number(cwe: Column) -> Column:
    return F.regexp_extract(F.coalesce(cwe, F.lit("")), r"(\d+)", 1)


def issue_type(cwe: Column, rule: Column, category: Column, title: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))),
                                 F.lit("[a-z0-9]{4,}"), F.lit(0))
    return F.coalesce(
        F.concat(F.lit("cwe:"), F.lower(cwe_prefix(truthy(cwe)))),
        F.concat(F.lit("rule:"), F.lower(truthy(rule))),
        F.concat(F.lit("cat:"), F.lower(truthy(category))),
        F.concat(F.lit("title:"), F.array_join(F.slice(words, 1, 6), " ")))


def issue_location(file_path: Column, endpoint: Column) -> Column:
    return F.coalesce(truthy(file_path), truthy(endpoint), F.lit(""))


def fingerprint(cwe, rule, category, title, file_path, endpoint) -> Column:
    """Stable identity of an issue across scans: type and place, no line."""
    return F.concat(issue_type(cwe, rule, category, title), F.lit("|"),
                    issue_location(file_path, endpoint))


def title_words(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(
        F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)))


def group_key(cwe, category, title) -> Column:
    return F.lower(strip(F.coalesce(truthy(cwe), truthy(category), truthy(title),
                                    F.lit("other"))))


def group_label(cwe, category, title) -> Column:
    return F.coalesce(truthy(category), truthy(title), truthy(cwe), F.lit("Other"))


def source_bucket(source: Column) -> Column:
    return F.when(source.isin("semgrep", "sonarqube", "access", "dast"), source) \
        .otherwise(F.lit("ai"))


def issue_severity(severity: Column) -> Column:
    return lookup(severity, fixed.ISSUE_SEVERITY, "Information")


def issue_confidence(confidence: Column) -> Column:
    return F.when(confidence > 0.8, "Certain").when(confidence > 0.5, "Firm") \
        .otherwise("Tentative")


def sarif_level(severity: Column) -> Column:
    return lookup(severity, fixed.SARIF_LEVEL, "note")


def sarif_rule_id(cwe: Column, title: Column) -> Column:
    return F.coalesce(truthy(cwe), F.replace(F.lower(title), F.lit(" "), F.lit("-")))


def serial_number(finding_id: Column) -> Column:
    return F.conv(F.substring(F.md5(finding_id.cast("binary")), 1, 12), 16, 10)


def probe_kind(rule: Column, cwe: Column) -> Column:
    """Which live check answers a finding; missing-authn, then idor, then bfla."""
    rule = F.coalesce(rule, F.lit(""))
    cwe = cwe_prefix(F.coalesce(cwe, F.lit("")))
    out = None
    for kind, keys in fixed.PROBE_RULES.items():
        hit = rule.isin(*keys) | cwe.isin(*keys)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def is_success(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def is_denied(status: Column) -> Column:
    return F.coalesce(status.isin(401, 403), F.lit(False))


def is_safe_method(method: Column) -> Column:
    return F.upper(method).isin(*fixed.SAFE_METHODS)


def choose(c: Column, allowed, default: str) -> Column:
    """Lower-cased value when it is one of *allowed*, else the default."""
    low = F.lower(c)
    return F.when(low.isin(*allowed), low).otherwise(F.lit(default))


def clamp01(c: Column, default: float | None = 0.5) -> Column:
    v = c.try_cast("double")
    v = F.when(F.isnan(v), None).otherwise(v)
    out = F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    return out if default is None else F.coalesce(out, F.lit(default))


def severity_at_least(c: Column, floor: str) -> Column:
    return severity_weight(c) >= 4 - fixed.SEVERITIES.index(floor)


def all_true(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


__all__ = [n for n in dir() if not n.startswith("_")] + ["safe_int", "truncate"]
