"""Severity, priority and label arithmetic (P-02, P-12…P-14, X-15…X-18, X-21…X-25)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import fixed_values as fv


def lookup(key: Column, table: dict, default=None) -> Column:
    """Literal-map lookup that stays inside code generation."""
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(mapping, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def severity_weight(severity: Column) -> Column:
    return lookup(F.lower(severity), fv.SEVERITY_WEIGHT)


def severity_rank(severity: Column, default: int = 2) -> Column:
    return lookup(severity, fv.SEVERITY_RANK, default)


def priority_score(severity: Column, confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), severity_weight(severity) * confidence * 100))


def priority(severity: Column, confidence: Column, context: Column | float = 1.0,
             intel: Column | float = 1.0, dampener: Column | float = 1.0) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    raw = (lookup(severity, fv.ALERT_WEIGHT, 0.1) * confidence * as_col(context) * as_col(intel)
           / F.greatest(as_col(dampener), F.lit(0.01))) * 100.0
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.round(raw, 2)))


def route_priority(score: Column) -> Column:
    return (F.when(score >= 80, "fullscreen").when(score >= 60, "toast")
            .when(score >= 30, "tray").otherwise("log"))


def anomaly_class(score: Column) -> Column:
    return F.when(score < 0.4, "normal").when(score < 0.6, "suspicious").otherwise("anomalous")


def reputation_label(score: Column) -> Column:
    return (F.when(score <= 30, "Malicious").when(score <= 60, "Suspicious")
            .when(score <= 80, "Neutral").otherwise("Clean"))


def sigmoid_confidence(n: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-0.05 * (n - 50)))


def platt_scale(p: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-4.0 * p + 2.0))


def infer_technique(name: Column, event_type: Column) -> Column:
    return F.coalesce(lookup(F.lower(name), fv.PROCESS_TECHNIQUE), lookup(event_type, fv.EVENT_TECHNIQUE))


def technique_tactic(technique: Column) -> Column:
    return lookup(technique, fv.TECHNIQUE_TACTIC)


def tactic_order(tactic: Column) -> Column:
    return lookup(tactic, fv.TACTIC_ORDER)


def critical_path(path: Column) -> Column:
    return F.lower(path).startswith(r"c:\windows\system32") | F.lower(path).startswith(r"c:\windows\startup")


def severity_of_file_change(change: Column, entropy: Column) -> Column:
    return (F.when(change == "created", "low")
            .when((change == "modified") & (entropy >= 7.0), "high").otherwise("medium"))


def payload_get(data: Column, path: str, default: str | None = None) -> Column:
    """Dotted-path read from a JSON payload."""
    value = F.get_json_object(data, f"$.{path}")
    return value if default is None else F.coalesce(value, F.lit(default))


def format_ts(ts: Column) -> Column:
    """UTC text of a timestamp (the session zone is UTC)."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
