"""Rules, signatures and stateless detections (R-01…R-26, T-07)."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as fv
from wardline.functions.scoring import lookup
from wardline.functions.text import (
    char_entropy, matched_names, obfuscation_confidence, sensitive_counts,
)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


# --- R-01, R-02 -----------------------------------------------------------------------
def condition(actual: Column, op: str, expected: Any) -> Column:
    """One rule condition as a Boolean column; a missing value never matches."""
    text = actual.cast("string")
    many = expected if isinstance(expected, (list, tuple)) else [expected]
    number = lambda: (actual.try_cast("double"), F.lit(float(expected)))
    low = F.lower(text)
    if op == "eq":
        test = actual == F.lit(expected)
    elif op == "neq":
        test = actual != F.lit(expected)
    elif op == "in":
        test = actual.isin(*many)
    elif op == "not_in":
        test = ~actual.isin(*many)
    elif op in ("gt", "lt", "gte", "lte"):
        a, b = number()
        test = {"gt": a > b, "lt": a < b, "gte": a >= b, "lte": a <= b}[op]
    elif op == "contains":
        test = text.contains(str(expected))
    elif op == "contains_any":
        test = _any([low.contains(str(v).lower()) for v in many])
    elif op == "startswith":
        test = _any([low.startswith(str(v).lower()) for v in many])
    elif op == "endswith":
        test = _any([low.endswith(str(v).lower()) for v in many])
    elif op == "regex":
        test = _any([text.rlike(str(v)) for v in many])
    else:
        return F.lit(False)
    return F.coalesce(test, F.lit(False))


def rule_predicate(rule: dict, columns: set[str]) -> Column:
    """A rule as one predicate, cheap equality tests first."""
    tests = []
    if rule.get("event_type"):
        tests.append(F.col("event_type") == rule["event_type"])
    if rule.get("sensor"):
        tests.append(F.col("sensor") == rule["sensor"])
    groups = rule.get("any_of") or [rule.get("conditions", [])]
    tests.append(_any([
        _all([condition(F.col(f), op, v) if f in columns else F.lit(False) for f, op, v in group])
        for group in groups
    ]))
    return F.coalesce(_all(tests), F.lit(False))


def _hits(columns: set[str], rules: list[dict] | None) -> list[Column]:
    return [F.when(rule_predicate(r, columns), F.struct(
        F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("rule_severity"),
        F.array(*map(F.lit, r["mitre"])).cast("array<string>").alias("rule_mitre"))) for r in (fv.BEHAVIOUR_RULES if rules is None else rules)]


def first_rule(columns: set[str], rules: list[dict] | None = None) -> Column:
    """The first rule that matches, as a struct (rule_id, rule_severity, rule_mitre) or NULL."""
    return F.coalesce(*_hits(columns, rules))


def apply_rules(events: DataFrame, rules: list[dict] | None = None, first_only: bool = False) -> DataFrame:
    """Rows (event columns + rule_id, rule_severity, rule_mitre) for each matching rule.

    All rules are tested in one pass over the events.  ``first_only`` keeps the
    first rule in list order (T-07).
    """
    hits = _hits(set(events.columns), rules)
    if first_only:
        found = events.withColumn("_hit", F.coalesce(*hits)).where("_hit IS NOT NULL")
    else:
        found = events.withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
    return found.select(*events.columns, "_hit.*")


# --- R-03 ---------------------------------------------------------------------------------
def compile_sigma(rule: dict) -> dict:
    """A Sigma selection as a rule for :func:`apply_rules`.

    A mapping is a conjunction, a list of mappings a disjunction; only the
    condition ``selection`` is accepted.
    """
    if rule.get("condition", "selection").strip() != "selection":
        raise ValueError(f"unsupported condition in {rule.get('id')}: {rule['condition']}")

    def conditions(selection: dict) -> list[tuple]:
        out = []
        for raw, value in selection.items():
            field, *modifiers = raw.split("|")
            if "re" in modifiers:
                op = "regex"
            elif "contains" in modifiers:
                op = "contains_any" if isinstance(value, list) else "contains"
            elif "startswith" in modifiers or "endswith" in modifiers:
                op = "startswith" if "startswith" in modifiers else "endswith"
            else:
                op = "in" if isinstance(value, list) else "eq"
            cast = [str(v) for v in value] if isinstance(value, list) else value
            out.append((fv.SIGMA_FIELDS.get(field, field.lower()), op, cast))
        return out

    selection = rule["selection"]
    groups = [conditions(s) for s in (selection if isinstance(selection, list) else [selection])]
    sensor, event_type = fv.SIGMA_LOGSOURCES.get(tuple(rule["logsource"]), ("", ""))
    found = [re.search(r"t(\d{4}(?:\.\d{3})?)", t, re.I) for t in rule.get("tags", [])]
    return dict(
        id=f"sigma_{rule['id'] or rule['title']}", severity=fv.SIGMA_LEVELS.get(rule.get("level"), "medium"),
        mitre=[f"T{m.group(1)}" for m in found if m], sensor=sensor, event_type=event_type, any_of=groups,
    )


def apply_sigma_rules(events: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    return apply_rules(events, [compile_sigma(r) for r in (fv.SIGMA_RULES if rules is None else rules)])


# --- R-04 … R-06 -----------------------------------------------------------------------------
def _finding(name, severity, technique, description, check, confidence) -> Column:
    return F.struct(
        F.lit(check).alias("check"), F.lit(name).alias("matched_rule"), F.lit(severity).alias("severity"),
        F.lit(technique).alias("mitre_id"), F.lit(description).alias("finding"),
        F.lit(confidence).alias("confidence"))


def parent_child_finding(parent: Column, child: Column, rules=None) -> Column:
    """First parent/child rule that matches, as a struct, else NULL."""
    arms = [
        F.when(F.lower(parent).isin(*parents) & F.lower(child).isin(*children),
               _finding(name, sev, tid, text, "parent_child", 0.8))
        for name, parents, children, sev, tid, text in (rules or fv.PARENT_CHILD_RULES)
    ]
    return F.coalesce(*arms)


def command_line_finding(binary: Column, command: Column, rules=None) -> Column:
    """First command-line pattern of the binary that matches, as a struct, else NULL."""
    arms = [
        F.when((F.lower(binary) == exe) & command.rlike(f"(?i){rx}"),
               _finding(f"{exe}_{tid}", sev, tid, text, "command_line", 0.85))
        for exe, rx, sev, tid, text in (rules or fv.COMMAND_LINE_RULES)
    ]
    return F.coalesce(*arms)


def lolbin_findings(events: DataFrame, parent: str = "parent_name", child: str = "name",
                    command: str = "cmdline") -> DataFrame:
    """Both checks in one pass: at most two findings per event, none lost."""
    pair = F.when((F.length(parent) > 0) & (F.length(child) > 0), parent_child_finding(F.col(parent), F.col(child)))
    line = F.when((F.length(child) > 0) & (F.length(command) > 0),
                  command_line_finding(F.col(child), F.col(command)))
    return (events.withColumn("_f", F.explode(F.array_compact(F.array(pair, line))))
            .select(*events.columns, F.col("_f.check"), F.col("_f.matched_rule"),
                    F.col("_f.severity").alias("finding_severity"), F.col("_f.mitre_id"),
                    F.col("_f.finding"), F.col("_f.confidence")))


def lolbin_parent_child(events: DataFrame, parent: str = "parent_name", child: str = "name") -> DataFrame:
    found = parent_child_finding(F.col(parent), F.col(child))
    return events.withColumn("_f", found).where("_f IS NOT NULL").select(*events.columns, "_f.matched_rule", "_f.mitre_id")


def lolbin_cmdline(events: DataFrame, child: str = "name", command: str = "cmdline") -> DataFrame:
    found = command_line_finding(F.col(child), F.col(command))
    return events.withColumn("_f", found).where("_f IS NOT NULL").select(*events.columns, "_f.matched_rule", "_f.mitre_id")


# --- R-07, R-08 --------------------------------------------------------------------------------
def powershell_patterns(script: Column) -> Column:
    return matched_names(script, fv.SCRIPT_PATTERNS)


def powershell_obfuscation(df: DataFrame, script: str) -> DataFrame:
    """Entropy, pattern names, the obfuscation flag and its confidence."""
    scored = df.withColumn("entropy", char_entropy(F.col(script))).withColumn(
        "matched_patterns", powershell_patterns(F.col(script)))
    return scored.withColumn(
        "is_obfuscated", (F.col("entropy") > 5.0) | (F.size("matched_patterns") >= 2)
    ).withColumn("confidence", obfuscation_confidence(F.col("entropy"), F.size("matched_patterns")))


# --- R-09 … R-16 -------------------------------------------------------------------------------
def dotnet_injection(df: DataFrame, il_path: str = "module_il_path", dynamic: str = "is_dynamic") -> DataFrame:
    return df.where(F.col(dynamic) & (F.coalesce(F.col(il_path), F.lit("")) == ""))


def wmi_namespace_persistence(df: DataFrame, namespace: str = "namespace") -> DataFrame:
    return df.where(F.lower(namespace).contains("subscription"))


def wmi_consumer_findings(df: DataFrame) -> DataFrame:
    """Persistence consumers with their risk and payload."""
    kind = F.col("consumer_type")
    payload = F.when(kind == "CommandLineEventConsumer", F.col("command_line_template")).otherwise(F.col("script_text"))
    return df.withColumn("risk", lookup(kind, fv.WMI_CONSUMER_RISK)).where("risk IS NOT NULL").withColumn(
        "command_or_script", F.coalesce(payload, F.lit("<unavailable>"))).withColumn("mitre_id", F.lit(fv.WMI_TECHNIQUE))


def masquerading(name: Column, exe: Column) -> Column:
    """A well-known system binary name started from another place."""
    allowed = F.try_element_at(F.create_map(*[
        x for n, paths in fv.SYSTEM_BINARY_PATHS.items() for x in (F.lit(n), F.array(*map(F.lit, paths)))]), F.lower(name))
    actual = F.lower(F.replace(exe, F.lit("/"), F.lit("\\")))
    return F.coalesce((F.length(exe) > 0) & ~F.array_contains(allowed, actual), F.lit(False))


def process_event_severity(name: Column, exe: Column, cmdline: Column) -> Column:
    return (F.when(masquerading(name, exe), "high")
            .when(char_entropy(cmdline) > 5.0, "medium").otherwise("info"))


def badusb_reasons(vendor: Column, device_class: Column, description: Column) -> Column:
    """Reasons to distrust a USB device; an empty array means none."""
    text = F.lower(F.coalesce(description, F.lit("")))
    hid = device_class.isin(*fv.HID_CLASSES)
    composite = (hid | text.contains("keyboard")) & (
        device_class.isin(*fv.STORAGE_CLASSES) | text.contains("mass storage"))
    first_of = lambda words, head: F.coalesce(*[
        F.when(text.contains(w), F.lit(f"{head}{w}")) for w in words])
    return F.array_compact(F.array(
        F.when(F.upper(vendor).isin(*fv.BADUSB_VENDORS), F.concat(F.lit("vendor:"), F.upper(vendor))),
        F.when(composite, F.lit("composite:hid+storage")),
        F.when(hid, first_of(fv.STORAGE_HINTS, "hint:")),
        first_of(fv.USB_ATTACK_WORDS, "keyword:"),
    ))


def badusb_suspects(df: DataFrame) -> DataFrame:
    return df.withColumn("reasons", badusb_reasons(F.col("vendor_id"), F.col("device_class"), F.col("description"))) \
        .where(F.size("reasons") > 0)


def doh_evasion(address: Column, port: Column, process: Column) -> Column:
    return F.coalesce(
        address.isin(*fv.DOH_PROVIDERS) & port.isin(*fv.DOH_PORTS) & (F.length(process) > 0)
        & ~F.lower(process).isin(*fv.DOH_BROWSERS), F.lit(False))


# --- R-17 … R-19 --------------------------------------------------------------------------------
def _group_hits(low: Column, words: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in words]))


def content_signatures(df: DataFrame, text: str, signatures: list[dict] | None = None) -> DataFrame:
    """Signature matches over whole texts with the strings that matched."""
    low = F.col("_low")
    matches = []
    for sig in signatures or fv.CONTENT_SIGNATURES:
        parts = [_group_hits(low, words) for _, words in sig["groups"]]
        tests = [F.size(p) >= k for p, (k, _) in zip(parts, sig["groups"])]
        if sig.get("regex"):
            tests.append(F.col(text).rlike(sig["regex"]))
        matches.append(F.when(_all(tests), F.struct(
            F.lit(sig["name"]).alias("signature"), F.lit(sig["severity"]).alias("signature_severity"),
            F.lit(sig["mitre"]).alias("mitre_id"), F.flatten(F.array(*parts)).alias("strings"))))
    staged = df.withColumn("_low", F.lower(text))  # lower-cased once
    return (staged.withColumn("_m", F.explode(F.array_compact(F.array(*matches))))
            .select(*df.columns, "_m.*"))


def sensitive_data_scan(df: DataFrame, text: str) -> DataFrame:
    """Counts of personal-data patterns per row; the text column is dropped."""
    found = df.withColumn("patterns_found", sensitive_counts(F.col(text)))
    return found.where(F.size("patterns_found") > 0).drop(text)


def screen_capture_fragment(name: Column) -> Column:
    """First capture-tool fragment in a process name, else NULL."""
    return F.coalesce(*[F.when(F.lower(name).contains(w), F.lit(w)) for w in fv.SCREEN_CAPTURE_FRAGMENTS])


# --- R-20 ----------------------------------------------------------------------------------------
WHITELIST_KEYS = {
    "process": ["exe", "process_path", "name"], "file": ["path", "file_path"],
    "ip": ["dst_ip", "src_ip", "remote_addr", "remote_ip", "ip"],
    "domain": ["domain", "query_name", "hostname"], "device": ["device_id", "device_name"],
}


def typed_values(df: DataFrame) -> Column:
    """ARRAY of (entry_type, value) for the whitelist keys the table has."""
    pairs = [
        F.when(F.length(F.col(c).cast("string")) > 0,
               F.struct(F.lit(kind).alias("entry_type"), F.col(c).cast("string").alias("value")))
        for kind, names in WHITELIST_KEYS.items() for c in names if c in df.columns
    ]
    return F.array_compact(F.array(*pairs))


def whitelist_suppress(events: DataFrame, whitelist: DataFrame, id_col: str, ts_us: str = "ts_us") -> DataFrame:
    """Drop events that carry a value allowed, enabled and unexpired at event time."""
    from wardline.operators.segmented import dimension_join

    allowed = whitelist.where("enabled").groupBy("entry_type", "value").agg(
        F.max(F.when(F.col("expires_us") == 0, F.lit(2**62)).otherwise(F.col("expires_us"))).alias("_until"))
    carried = events.select(id_col, F.col(ts_us).alias("_at"), F.explode(typed_values(events)).alias("_p")).select(
        id_col, "_at", "_p.entry_type", "_p.value")
    hits = dimension_join(carried, allowed, ["entry_type", "value"], "inner").where("_until > _at")
    return events.join(hits.select(id_col).distinct(), id_col, "left_anti")


# --- R-21 … R-26 -----------------------------------------------------------------------------------
def cert_anomaly_score(issuer: Column, subject: Column, validity_days: Column, has_san: Column,
                       key_type: Column, key_bits: Column) -> Column:
    """Weighted sum of certificate weaknesses; over 0.5 is an alert."""
    weak = F.when(key_type == "RSA", key_bits < 2048).when(key_type == "EC", key_bits < 256).otherwise(F.lit(True))
    w = fv.CERT_WEIGHTS
    part = lambda test, weight: F.when(test, weight).otherwise(0.0)
    return F.round(part(issuer == subject, w["self_signed"]) + part(validity_days <= 30, w["short_lived"])
                   + part(~has_san, w["no_san"]) + part(weak, w["weak_key"]), 4)


def external_address(address: Column) -> Column:
    """Not a private, loopback or link-local address; blank counts as external."""
    return (F.coalesce(address, F.lit("")) == "") | ~F.coalesce(address, F.lit("")).rlike(fv.PRIVATE_ADDRESS)


def is_executable(path: Column) -> Column:
    return F.lower(path).rlike("(" + "|".join(re.escape(e) for e in fv.EXECUTABLE_EXTENSIONS) + ")$")


def _contains_any(path: Column, words: list[str]) -> Column:
    """Any of the words in the lower-cased text; one alternation evaluates the text once."""
    return F.coalesce(F.lower(path).rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def is_credential_path(path: Column) -> Column:
    return _contains_any(path, fv.CREDENTIAL_PATHS)


def is_persistence_path(path: Column) -> Column:
    return _contains_any(path, fv.PERSISTENCE_PATHS)


def suspicious_origin(signature: Column, path: Column) -> Column:
    unsigned = F.lower(F.coalesce(signature, F.lit(""))).isin("unsigned", "invalid", "")
    return unsigned | _contains_any(path, fv.TEMP_PATHS)


def has_encoded_flag(cmdline: Column) -> Column:
    return _contains_any(cmdline, fv.ENCODED_FLAGS)


def entropy_increase(before: Column, after: Column) -> Column:
    return F.coalesce((after > before) & (after > 6.0), F.lit(False))


def persistence_event(code: Column, event_type: Column, registry_key: Column | None = None) -> Column:
    kind = F.lower(F.coalesce(event_type, F.lit("")))
    test = (F.coalesce(code.cast("string"), F.lit("")).isin("4698", "7045", "4697")
            | kind.contains("scheduled_task") | kind.contains("service_install"))
    return test if registry_key is None else test | is_persistence_path(registry_key)


def search_processes(df: DataFrame, needle: str, columns=("pid", "name", "user", "exe")) -> DataFrame:
    """Case-insensitive substring search over the listed columns."""
    return df.where(_any([
        F.coalesce(F.lower(F.col(c).cast("string")).contains(needle.lower()), F.lit(False)) for c in columns]))


def process_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.lower("risk_level").isin("medium", "high")).alias("suspicious"),
        F.count_if(F.coalesce(F.col("exe"), F.lit("")) == "").alias("pathless"),
        F.count_if(F.coalesce(F.col("cpu_percent"), F.lit(0.0)) > 80).alias("high_cpu"))


def filter_connections(df: DataFrame, protocol: str = "All") -> DataFrame:
    return df if protocol.lower() == "all" else df.where(F.upper("protocol") == protocol.upper())
