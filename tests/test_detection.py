"""Substring joins, campaigns along chains and the one-scan dispatch."""

import random

from pyspark.sql import functions as F

from wardline.operators import correlate, detect, graph
from wardline.operators.substrings import containing_pairs

S = 1_000_000


def test_containing_pairs_match_a_double_loop(spark):
    r = random.Random(4)
    part = lambda: "".join(r.choice("ab.\\é") for _ in range(r.randrange(0, 7)))
    a = [(f"h{i % 3}" if i % 11 else None, part() + r.choice(["", "tool.exe", "setup_tool.exe"])) for i in range(90)] + [("h0", None), ("h0", "")]
    b = [(f"h{i % 3}", part() + r.choice(["", "tool.exe", "c:\\x\\setup_tool.exe"])) for i in range(90)] + [("h0", None), ("h0", "a"), (None, "tool.exe")]
    got = containing_pairs(spark.createDataFrame(a, "host string, x string"), spark.createDataFrame(b, "host string, y string"), ["host"], "x", "y")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    want = {(h, x, y) for h, x in a for g, y in b if h and h == g and x and y and (x in y or y in x)}
    rows = [tuple(t) for t in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_drive_by_meets_names_inside_paths_and_paths_inside_names(spark):
    rows = [("e1", "h", 1, 1, "process", 10, None, "chrome.exe", None), ("e2", "h", 2, 2, "file", 10, None, None, "D:\\dl\\setup_tool.exe"),
            ("e3", "h", 3, 3, "process", 11, None, "tool.exe", None), ("e4", "h", 4, 4, "process", 12, None, "x:\\d:\\dl\\setup_tool.exe", None),
            ("e5", "g", 5, 5, "process", 12, None, "tool.exe", None), ("e6", "h", 6, 6, "file", 10, None, None, "chrome.exe")]
    ev = spark.createDataFrame(rows, "event_id string, host string, ts_us long, seq long, sensor string, pid long, ppid long, name string, path string")
    ev = ev.withColumns({"exe": F.lit(None).cast("string"), "cmdline": F.lit(None).cast("string"), "event_type": F.lit("x")})
    nodes = graph.build_nodes(ev)
    got = graph.chain_drive_by(nodes, graph.build_edges(nodes)).collect()
    assert {(m.node_id, m.target_id, m.evidence["executions"]) for m in got} == {("e1", "e2", 2)}  # the browser is no execution of e6


def greedy(order, ent):
    taken, seed = set(), {}
    for i in order:
        hit = [s for s in seed if seed[s] == s and ent[s] & ent[i]]
        seed[i] = hit[0] if hit else i
        taken |= ent[i] if not hit else set()
    return seed


def members(spark, ent, replay):
    inc = spark.createDataFrame([(i, n, "closed") for n, i in enumerate(ent)], "incident_id string, ord int, status string")
    ents = spark.createDataFrame([(i, e) for i, es in ent.items() for e in es], "incident_id string, entity string")
    return {r.incident_id: r.seed_id for r in correlate.campaign_members(inc, ents, replay).collect()}


def test_campaigns_agree_with_and_without_the_replay(spark):
    r = random.Random(9)
    ent = {f"i{i:03}": {f"e{r.randrange(60)}" for _ in range(r.randrange(1, 4))} for i in range(90)}
    want = greedy(list(ent), ent)
    assert members(spark, ent, 0) == want and members(spark, ent, 10**6) == want


def test_a_chain_of_incidents_settles_in_few_rounds(spark, monkeypatch):
    rounds = []
    real = correlate._forced
    monkeypatch.setattr(correlate, "_forced", lambda undecided: rounds.append(1) or real(undecided))
    chain = {f"i{i:05}": {f"e{i}", f"e{i + 1}"} for i in range(10_000)}
    assert members(spark, chain, 0) == {f"i{i:05}": f"i{i - i % 2:05}" for i in range(10_000)}
    assert len(rounds) <= 3


EVENT = "event_id string, host string, ts_us long, seq long, sensor string, event_type string, domain string, url string, remote_ip string, remote_port long, name string, pid long, path string, change_type string, score double, verified boolean"


def events(spark, folder):
    rows = [("e1", "h", 1 * S, 1, "process", "process_new", None, None, None, None, "evil.exe", 7, None, None, 0.1, True),
            ("e2", "h", 2 * S, 2, "network", "dns_query", "bad.example.com", None, "10.0.0.1", 53, "x.exe", 7, None, None, 0.5, False),
            ("e3", "h", 3 * S, 3, "network", "http", None, "http://bad/", None, None, "x.exe", 7, None, None, 0.7, True),
            ("e4", "h", 4 * S, 4, "file", "file_change", None, None, None, None, None, 7, "c:\\a", "created", 0.7, False),
            ("e5", "h", 5 * S, 5, "file", "file_change", None, None, None, None, None, 7, "c:\\a", "deleted", None, None),
            ("e6", "h", 6 * S, 6, "etw", detect.IMAGE_LOAD, None, None, None, None, None, 7, None, None, None, None),
            ("e7", "h", 7 * S, 7, "network", "dns_query", "x.xyz", None, "10.0.0.1", 53, "x.exe", 8, None, None, None, None)]
    path = f"{folder}/events"
    spark.createDataFrame(rows, EVENT).write.parquet(path)
    return spark.read.parquet(path)


RULES = [dict(id="evil", severity="high", mitre=["T1"], sensor="process", event_type="", conditions=[("name", "eq", "evil.exe")]),
         dict(id="later", severity="low", mitre=["T2"], sensor="", event_type="", conditions=[("pid", "eq", 7)])]


def given(spark):
    memory = spark.createDataFrame([(7, "shellcode", 16, 4, 0.9, "T1055", "high"), (7, "shellcode", 32, 4, 0.8, "T1055", "high"), (9, "rwx_region", 1, 1, 0.6, "T1", "medium")],
                                   "pid long, finding string, address long, size long, confidence double, mitre_id string, severity string")
    return [detect.url_findings(spark.createDataFrame([("http://bad/", "malicious", 0.91), ("x.xyz", "benign", 0.99)], "url string, label string, confidence double")),
            detect.domain_findings(spark.createDataFrame([("bad.example.com",), ("bad.example.com",)], "value string")),
            detect.memory_alert_findings(memory),
            detect.content_findings(spark.createDataFrame([("c:\\a", "note", None, "T1486"), ("c:\\a", "key", "low", None)], "path string, rule string, severity string, mitre string")),
            detect.chain_findings(spark.createDataFrame([("e1", "fileless_attack", "e3", 0.8512, ["T9"])], "node_id string, chain_name string, target_id string, confidence double, mitre_ids array<string>")),
            detect.pattern_findings(spark.createDataFrame([("e7", None, None)], "event_id string, description string, confidence double"))]


def test_every_stage_in_one_scan(spark, tmp_path):
    ev = events(spark, tmp_path)
    out = detect.dispatch(ev, *given(spark), rule_set=RULES)
    got = sorted((r.event_id, r.stage, r.alert_type, r.severity, r.confidence, ",".join(r.mitre_ids)) for r in out.collect())
    assert got == sorted([
        ("e1", "rule", "rule_evil", "high", 0.95, "T1"), ("e1", "chain", "chain_fileless_attack", "critical", 0.851, "T9"),
        *[(f"e{i}", "rule", "rule_later", "low", 0.95, "T2") for i in range(2, 7)],
        ("e2", "cascade", "statistical_anomaly", "medium", 0.5, ""), ("e2", "dns", "dns_known_malicious", "critical", 0.95, "T1071.004"),
        ("e3", "cascade", "confirmed_anomaly", "high", 0.8, ""), ("e3", "url", "url_malicious", "high", 0.91, ""),
        ("e4", "content", "yara_note", "high", 0.9, "T1486"), ("e4", "content", "yara_key", "low", 0.9, ""),
        ("e6", "memory", "shellcode", "high", 0.9, "T1055"), ("e6", "memory", "shellcode", "high", 0.8, "T1055"),
        ("e7", "dns", "dns_suspicious_tld", "low", 0.4, ""), ("e7", "pattern", "temporal_pattern", "high", 0.75, "")])
    ids = [r.alert_id for r in out.collect()]
    assert len(ids) == len(set(ids))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and plan.count("Generate explode") == 1


def test_stages_without_given_findings_and_without_a_verifier(spark, tmp_path):
    out = detect.dispatch(events(spark, tmp_path), rule_set=RULES[:1], verifier=False)
    got = sorted((r.event_id, r.stage, r.alert_type, r.engine) for r in out.collect())
    anomaly = [(e, "cascade", "statistical_anomaly", "isolation_forest") for e in ("e2", "e3", "e4")]
    assert got == sorted([("e1", "rule", "rule_evil", "rule_engine"), ("e7", "dns", "dns_suspicious_tld", "dns_analyzer"), *anomaly])
