"""Readers, writers, reports and state views on files."""

import json

from pyspark.sql import functions as F

from wardline.operators import models, reports
from wardline.plans.hunts import HUNTS
from wardline.sources import feeds, sinks, tables


def test_feed_files(spark, tmp_path):
    (tmp_path / "ja3.csv").write_text("# head\n\n2024-01-01, abc ,Family,why, not\nshort,line\n")
    out = feeds.read_ioc_csv_ja3(spark, str(tmp_path / "ja3.csv")).collect()
    assert [(r.value, json.loads(r.metadata)["family"]) for r in out] == [("abc", "Family")]
    (tmp_path / "ip.json").write_text(json.dumps({"data": [{"ipAddress": "1.1.1.1", "abuseConfidenceScore": 95, "countryCode": "X"}, {"ipAddress": ""}, {"ipAddress": "2.2.2.2", "abuseConfidenceScore": 90}]}))
    assert {(r.value, r.severity) for r in feeds.read_ioc_json_ip(spark, str(tmp_path / "ip.json")).collect()} == {("1.1.1.1", "critical"), ("2.2.2.2", "high")}
    (tmp_path / "url.json").write_text(json.dumps([{"url": "http://a", "phish_id": "1", "target": "T"}, {"url": ""}]))
    assert [r.value for r in feeds.read_ioc_json_url(spark, str(tmp_path / "url.json")).collect()] == ["http://a"]
    (tmp_path / "hash.json").write_text(json.dumps({"data": [{"id": "h1", "attributes": {"last_analysis_stats": {"malicious": 20}}}, {"id": "h2", "attributes": {}}]}))
    assert {(r.value, r.severity) for r in feeds.read_ioc_json_hash(spark, str(tmp_path / "hash.json")).collect()} == {("h1", "critical"), ("h2", "high")}
    (tmp_path / "block.json").write_text(json.dumps([{"ip_address": "3.3.3.3", "status": "on"}, {"ip": "4.4.4.4"}, {"status": "x"}]))
    (tmp_path / "block.csv").write_text("url,target\nhttp://" + "b" * 600 + ",t\n,x\n")
    got = feeds.read_ioc_blocklists(spark, str(tmp_path / "block.json"), str(tmp_path / "block.csv")).collect()
    assert sorted(len(r.value) for r in got) == [7, 7, 607]  # kept whole
    (tmp_path / "stix.json").write_text(json.dumps({"type": "bundle", "objects": [
        {"type": "indicator", "id": "i1", "pattern": "[file:hashes.'sha-256' = 'ff'] AND [url:value = 'u']", "labels": ["x"], "name": "n"}, {"type": "malware", "id": "m"}, {"type": "indicator", "id": "i2", "pattern": "[mutex:name = 'q']"}]}))
    assert [(r.ioc_type, r.value) for r in feeds.read_stix_bundle(spark, str(tmp_path / "stix.json")).collect()] == [("url", "u")]


def test_technique_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"techniques": [{"technique_id": "T1", "name": "N", "tactic": "execution", "description": "d"}]}))
    assert feeds.read_mitre_techniques(spark, str(tmp_path / "t.json")).count() == 1
    assert feeds.read_mitre_techniques(spark).count() == 14
    (tmp_path / "c.json").write_text(json.dumps({"chains": [{"name": "a", "techniques": ["T1", "T2"]}]}))
    assert [(r.pos, r.technique_id) for r in feeds.read_attack_chains(spark, str(tmp_path / "c.json")).orderBy("pos").collect()] == [(0, "T1"), (1, "T2")]
    assert feeds.read_attack_chains(spark).select("chain_id").distinct().count() == 20


def test_writers(spark, tmp_path):
    ev = spark.createDataFrame([("e1", 86_400_000_000 * 3, 1, "network", "t", "low")], "event_id string, ts_us bigint, seq int, source string, type string, severity string").withColumn("ts", F.timestamp_micros("ts_us"))
    sinks.write_partitioned(ev, str(tmp_path / "ev"))
    sinks.write_partitioned(ev, str(tmp_path / "ev"))
    back = spark.read.parquet(str(tmp_path / "ev"))
    assert back.count() == 2 and str(back.first().day) == "1970-01-04"
    sinks.export_timeline_json(ev, str(tmp_path / "tl"))
    assert spark.read.json(str(tmp_path / "tl")).first().event_id == "e1"
    sinks.export_csv(ev, str(tmp_path / "csv"), ["ts_us", "severity", "source", "type"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["ts_us", "severity", "source", "type"]
    audit = spark.createDataFrame([(1, 5, "detection", "alert_raised", '{"log_type":"alert","alert_type":"dns_x","title":"DNS threat: a.com","mitre_ids":["T1","T2"]}'), (2, 9, "response", "action_executed", "oops")],
                                  "log_id int, ts_us bigint, component string, action string, detail string")
    rep = reports.incident_report(audit)
    row = rep.first()
    assert (row.total_events, row.total_alerts, row.n_techniques, row.start_us, row.end_us) == (2, 1, 2, 5, 9)
    assert row.summary == "1 alert(s) generated. 2 MITRE ATT&CK technique(s) observed."
    sinks.export_report_json(rep, str(tmp_path / "rep"))
    assert json.loads(spark.read.text(str(tmp_path / "rep")).first()[0])["total_alerts"] == 1
    assert [(r.type, r.value) for r in reports.report_iocs(audit).collect()] == [("domain", "a.com")]
    assert reports.audit_query(audit, "action_executed").first().raw == "oops"
    wl = spark.createDataFrame([("ip", "1.1.1.1", None, None, None), ("bogus", "x", None, None, None)], "entry_type string, value string, reason string, added_by string, expires_us bigint")
    sinks.export_whitelist(wl, str(tmp_path / "wl"), "ip")
    assert sinks.import_whitelist(wl).count() == 1 and spark.read.json(str(tmp_path / "wl")).count() == 1
    sinks.overwrite(wl, str(tmp_path / "ow"))
    assert spark.read.parquet(str(tmp_path / "ow")).count() == 2


def test_upsert_keeps_first_source(spark):
    row = lambda s, sev, at: ("ip", "x", s, sev, at, at)
    schema = "ioc_type string, value string, source string, severity string, first_us bigint, updated_us bigint"
    one = sinks.upsert_ioc(None, spark.createDataFrame([row("s1", "low", 1)], schema))
    got = sinks.upsert_ioc(one, spark.createDataFrame([row("s2", "high", 2)], schema)).first()
    assert (got.source, got.severity, got.first_us, got.updated_us) == ("s1", "high", 1, 2)


def test_wire_format(spark):
    good = {"event_id": "e", "timestamp": 1.5, "host": "h", "sensor": "NETWORK", "event_type": "t", "severity": "High", "data": {"process_id": "7", "dst_ip": "1.2.3.4", "extra": [1]}}
    df = spark.createDataFrame([(json.dumps(good),), ("{broken",), ('{"event_id": null}',)], "value string")
    parsed = tables.parse_events(df)
    assert tables.corrupt_events(parsed).count() == 2
    row = tables.normalize_events(tables.valid_events(parsed)).first()
    assert (row.sensor, row.severity, row.pid, row.remote_ip) == ("network", "high", 7, "1.2.3.4")
    assert json.loads(row.data)["extra"] == [1]


def test_model_registry_rolls_back(spark, tmp_path):
    path = str(tmp_path / "reg")
    assert [models.register_model(spark, path, "iforest", {"n": i}, f"p{i}", i) for i in (1, 2, 3)] == [1, 2, 3]
    assert models.rollback_model(spark, path) == 2
    assert models.register_model(spark, path, "iforest", {}, "p4", 4) == 4
    assert models.rollback_model(spark, path) == 2 and models.rollback_model(spark, path) == 1


def test_forest_ranks_outliers_first(spark):
    import random
    r = random.Random(4)
    data = [(i, [r.gauss(0, 1), r.gauss(0, 1)]) for i in range(300)] + [(1000 + i, [12.0 + i, -12.0]) for i in range(3)]
    df = spark.createDataFrame(data, "id bigint, v array<double>")
    fit = lambda: models.IsolationForest.fit(df, "v", "id", trees=40, contamination=0.01).score(df, "v")
    a = fit()
    assert {x.id for x in a.orderBy(F.desc("score")).limit(3).collect()} == {1000, 1001, 1002}
    assert a.agg(F.min("score") >= 0, F.max("score") <= 1).first()[:] == (True, True)
    assert sorted(map(tuple, a.select("id", "score").collect())) == sorted(map(tuple, fit().select("id", "score").collect()))


def test_reconstruction_flags_what_leaves_the_line(spark):
    data = [(i, [i / 10.0, i / 10.0 + (i % 3) * 0.01]) for i in range(200)] + [(1000, [10.0, 16.0])]
    df = spark.createDataFrame(data, "id bigint, v array<double>")
    v = models.ReconstructionVerifier.fit(df, "v", 2, latent=1)
    assert [r.id for r in v.verify(df, "v").where("verified").collect()] == [1000]


def test_hunts_are_selects():
    assert len(HUNTS) == 24 and all(t.startswith("SELECT") for t in HUNTS.values())


def test_execution_state(spark):
    ex = spark.createDataFrame([("x", "running"), ("y", "aborted")], "execution_id string, status string")
    log = spark.createDataFrame([("x", 0, "pending", 1, 0), ("x", 0, "executed", 2, 0), ("x", 1, "pending", 1, 0), ("y", 0, "pending", 1, 0)], "execution_id string, step_index int, status string, ts_us bigint, tie int")
    got = {r.execution_id: (r.state, r.current_step, r.n_skipped) for r in reports.execution_state(ex, log).collect()}
    assert got == {"x": ("running", 1, 0), "y": ("aborted", None, 1)}
