"""Rule language and stateless detections."""

import pytest
from pyspark.sql import functions as F

from wardline.operators import joins, rules
from wardline.operators.correlate import extract_entities
from wardline.sources import feeds


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([("PowerShell", 5, None)], "name string, n int, gone string")


@pytest.mark.parametrize("field,op,value,want", [
    ("name", "contains", "powershell", False), ("name", "contains_any", ["powershell"], True), ("gone", "neq", "x", False),
    ("gone", "not_in", ["x"], False), ("n", "gt", 4.5, True), ("n", "lte", "5", True), ("name", "gt", 1, False),
    ("name", "startswith", "power", True), ("name", "endswith", ["x", "SHELL"], True), ("name", "regex", "^Power", True),
    ("name", "like", "x", False), ("n", "in", [5, 6], True), ("name", "neq", "x", True)])
def test_conditions(row, field, op, value, want):
    assert row.select(rules.condition(F.col(field), op, value)).first()[0] is want


def test_empty_rule_matches_all_and_first_wins(spark):
    ev = spark.createDataFrame([("e1", "process", "x")], "event_id string, sensor string, event_type string")
    rs = [dict(id="a", severity="low", mitre=[], sensor="", event_type="", conditions=[]), dict(id="b", severity="high", mitre=["T1"], sensor="process", event_type="", conditions=[])]
    assert [r.rule_id for r in rules.apply_rules(ev, rs).orderBy("rule_id").collect()] == ["a", "b"]
    assert [r.rule_id for r in rules.apply_rules(ev, rs, first_only=True).collect()] == ["a"]


def test_sigma_list_is_or_and_other_conditions_are_refused(spark):
    ev = spark.createDataFrame([("1", "process", "process_snapshot", "c:\\a.exe", "x"), ("2", "process", "process_snapshot", "c:\\b.exe", "y"), ("3", "process", "process_snapshot", "c:\\c.exe", "z")],
                               "event_id string, sensor string, event_type string, exe string, cmdline string")
    rule = dict(id="r", title="t", level="high", logsource=("windows", "process_creation"), tags=["attack.t1059.001"], selection=[{"Image|endswith": "\\A.exe"}, {"CommandLine": ["y"]}])
    out = rules.apply_sigma_rules(ev, [rule]).orderBy("event_id").collect()
    assert [r.event_id for r in out] == ["1", "2"] and out[0].rule_mitre == ["T1059.001"]
    with pytest.raises(ValueError):
        rules.compile_sigma({**rule, "condition": "selection and not filter"})


def test_lolbins(spark):
    ev = spark.createDataFrame([("1", "WINWORD.EXE", "PowerShell.exe", "certutil -decode"), ("2", "a.exe", "Certutil.exe", "CERTUTIL -DECODE a"), ("3", "excel.exe", "mshta.exe", "mshta HTTP://x")],
                               "event_id string, parent_name string, name string, cmdline string")
    out = {(r.event_id, r.check): r.matched_rule for r in rules.lolbin_findings(ev).collect()}
    assert out == {("1", "parent_child"): "office_spawns_scripting", ("2", "command_line"): "certutil.exe_T1140",
                   ("3", "parent_child"): "office_spawns_scripting", ("3", "command_line"): "mshta.exe_T1218.005"}


def test_signatures(spark):
    df = spark.createDataFrame([(1, "Your files have been ENCRYPTED. Pay the ransom."), (2, "pay the ransom"), (3, "powershell -e " + "A" * 40), (4, "eval(system($_POST))")], "id int, body string")
    assert {(r.id, r.signature) for r in rules.content_signatures(df, "body").collect()} == {(1, "Ransomware_Note_Generic"), (3, "Powershell_Encoded_Command"), (4, "WebShell_Generic_PHP")}


def test_whitelist_expiry(spark):
    ev = spark.createDataFrame([("1", 100, "a.exe"), ("2", 100, "b.exe"), ("3", 100, "c.exe")], "event_id string, ts_us bigint, name string")
    wl = spark.createDataFrame([("process", "a.exe", 50, True), ("process", "b.exe", 0, False), ("process", "c.exe", 0, True)], "entry_type string, value string, expires_us bigint, enabled boolean")
    assert sorted(r.event_id for r in rules.whitelist_suppress(ev, wl, "event_id").collect()) == ["1", "2"]


def test_badusb(spark):
    df = spark.createDataFrame([("2341", "Ports", "Arduino"), ("8087", "Keyboard", "Flash disk mass storage"), ("8087", "Net", "adapter")], "vendor_id string, device_class string, description string")
    out = rules.badusb_suspects(df).collect()
    assert [len(r.reasons) for r in out] == [1, 2]


def test_entities(spark):
    df = spark.createDataFrame([(7, "10.0.0.1", "::1", "c:\\x", "d.com")], "pid int, ip string, ip2 string, path string, domain string")
    got = df.select(extract_entities(pid="pid", ip="ip", ip2="ip2", path="path", domain="domain")).first()[0]
    assert got == ["pid:7", "ip:10.0.0.1", "file:c:\\x", "domain:d.com"]


def test_stix_severity_order(spark):
    df = spark.createDataFrame([(["low-x", "critical"], []), ([], ["tlp:amber"]), (["Malicious-Activity"], None), (None, None)], "l array<string>, m array<string>")
    assert [r[0] for r in df.select(feeds.stix_severity(F.col("l"), F.col("m"))).collect()] == ["low", "high", "high", "medium"]


def test_enrich_large_dimension_path_equals_broadcast(spark, monkeypatch):
    ev = spark.createDataFrame([(f"e{i}", f"1.1.1.{i % 5}", f"1.1.1.{i % 3 + 10}") for i in range(60)], "event_id string, dst_ip string, src_ip string")
    ioc = spark.createDataFrame([("ip", f"1.1.1.{i}", f"s{i}", "high", i) for i in (1, 3, 11)] + [("domain", "1.1.1.1", "old", "low", 0)], "ioc_type string, value string, source string, severity string, first_us bigint")
    small = sorted(map(tuple, joins.enrich_network(ev, ioc, "event_id").collect()))
    monkeypatch.setattr(joins, "bounded_broadcast", lambda df, max_rows=0: (df, False))
    assert sorted(map(tuple, joins.enrich_network(ev, ioc, "event_id").collect())) == small
