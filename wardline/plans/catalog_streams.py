"""Streaming queries: each replays the events table as a stream to completion.

In append mode a window is written once the watermark (newest row minus the
delay) has passed its end; the oracles leave the open windows out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions.names import base_domain
from wardline.operators import correlate
from wardline.operators.windows import prediction_table
from wardline.plans.catalog_rules import _DEMO_SQL, DEMO_RULES
from wardline.plans.catalog_graph import FOLD_SQL
from wardline.plans.catalog_tables import _BEST, MITRE_LIST, mitre
from wardline.plans.catalog_windows import CHAIN_SQL, NEXT_CTE
from wardline.plans.registry import query
from wardline.sources import feeds
from wardline.streaming import streams
from wardline.streaming.replay import run_to_table

_CUT = "(SELECT (max(ts_us) - 600000000) // 1000 * 1000 FROM {})"


def _timed(df, delay="10 minutes"):
    return streams.with_event_time(df.withColumn("ts", F.timestamp_micros("ts_us")), delay)


@query("s02_dedup_alert_stream", "S-01 S-02", f"""
    WITH g AS (SELECT *, lag(ts_us) OVER (PARTITION BY host, sensor, alert_type ORDER BY ts_us, seq) AS p FROM alerts),
    r AS (SELECT *, sum(CASE WHEN p IS NULL OR ts_us - p >= 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY host, sensor, alert_type ORDER BY ts_us, seq) AS run FROM g)
    SELECT arg_min(alert_id, ts_us) AS alert_id, count(*) AS run_count FROM r GROUP BY host, sensor, alert_type, run HAVING max(ts_us) + 59999999 <= {_CUT.format('alerts')}""")
def _(t):
    return run_to_table(streams.dedup_alert_stream(_timed(t.stream("alerts"))), "dedup").select("alert_id", "run_count")


@query("s03_flow_stats_stream", "S-03", f"""
    SELECT * FROM (SELECT host, CAST(floor(ts_us / 30000000.0) AS BIGINT) * 30000000 AS window_us, count(*) AS total_connections, count(DISTINCT remote_ip) AS unique_remote_ips,
        count(DISTINCT remote_port) AS unique_remote_ports, count(*) FILTER (protocol = 'TCP') AS tcp, count(*) FILTER (protocol = 'UDP') AS udp FROM tele WHERE event_type = 'connection' GROUP BY ALL)
    WHERE window_us + 30000000 <= {_CUT.format("tele WHERE event_type = 'connection'")}""")
def _(t):
    out = run_to_table(streams.flow_stats_stream(_timed(t.stream("tele").where("event_type = 'connection'"))), "flow")
    return out.select("host", F.unix_micros("window_start").alias("window_us"), "total_connections", "unique_remote_ips", "unique_remote_ports", "tcp", "udp")


@query("s04_failed_login_stream", "S-04", f"""
    SELECT * FROM (SELECT host, CAST(floor(ts_us / 900000000.0) AS BIGINT) * 900000000 AS window_us, count(*) AS failed_logins FROM tele WHERE sensor = 'eventlog' AND code = 4625 GROUP BY ALL)
    WHERE failed_logins >= 2 AND window_us + 900000000 <= {_CUT.format("tele WHERE sensor = 'eventlog'")}""")
def _(t):
    out = run_to_table(streams.failed_login_stream(_timed(t.stream("tele").where("sensor = 'eventlog'")), "15 minutes", threshold=2), "logins")
    return out.select("host", F.unix_micros("window_start").alias("window_us"), "failed_logins")


@query("s05_chain_stream", "S-05", CHAIN_SQL)
def _(t):
    return run_to_table(streams.chain_stream(_timed(t.stream("tele").where("sensor = 'eventlog'")), 3_000_000_000), "chains")


@query("s06_beacon_stream", "S-06")
def _(t):
    steady = F.col("seq") % 10 < 5
    ev = t.stream("tele").select(
        F.concat(F.lit("h"), F.col("seq") % 10).alias("host"), F.when(steady, F.concat(F.lit("srv"), F.col("seq") % 5)).otherwise(F.col("remote_ip")).alias("dest"), "seq",
        F.when(steady, 1704067200000000 + F.col("seq") * 30_000_000 + F.col("k") % 5 * 1_000_000).otherwise(F.col("ts_us")).alias("ts_us"))
    return run_to_table(streams.beacon_stream(_timed(ev)), "beacons").select("host", "dest", F.round("score", 6).alias("score"), "n_events")


@query("s07_dns_rate_stream", "S-07", """
    SELECT seq, (count(*) OVER (PARTITION BY base ORDER BY ts_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW))::INTEGER AS rate
    FROM (SELECT seq, ts_us, array_to_string(string_split(domain, '.')[-2:], '.') AS base FROM tele WHERE event_type = 'dns_query')""")
def _(t):
    q = t.stream("tele").where("event_type = 'dns_query'").withColumn("base", base_domain(F.col("domain")))
    return run_to_table(streams.dns_rate_stream(_timed(q)), "rates").select("seq", "rate")


@query("s08_correlate_stream", "S-08 W-16", FOLD_SQL)
def _(t):
    a = t.stream("alerts").withColumn("mitre_ids", mitre()).withColumn(
        "entities", correlate.extract_entities(pid="a_pid", ip="a_ip", path="a_path", domain="a_domain"))
    return run_to_table(streams.correlate_stream(_timed(a)), "incidents").select("alert_id", "incident_id", "rule")


@query("s09_reputation_stream", "S-09", """
    WITH RECURSIVE d AS (SELECT remote_ip AS address, row_number() OVER (PARTITION BY remote_ip ORDER BY ts_us, seq) AS r, CASE WHEN value > 100 THEN 10.0 ELSE -3.0 END AS delta FROM tele WHERE sensor = 'network'),
    f(address, r, score) AS (SELECT address, r, greatest(0.0, least(100.0, 50.0 + delta))::DOUBLE FROM d WHERE r = 1
        UNION ALL SELECT d.address, d.r, greatest(0.0, least(100.0, f.score + d.delta))::DOUBLE FROM f JOIN d ON d.address = f.address AND d.r = f.r + 1)
    SELECT address, r AS total_connections, score FROM f""")
def _(t):
    o = t.stream("tele").where("sensor = 'network'").select(F.col("remote_ip").alias("address"), "ts_us", "seq", F.when(F.col("value") > 100, 10.0).otherwise(-3.0).alias("delta"))
    return run_to_table(streams.reputation_stream(_timed(o)), "reputation").select("address", "total_connections", "score")


# edges meet the latest process of the last 30 minutes; a minute closes once the watermark is as far past it
@query("s10_graph_window_stream", "S-10 J-15", f"""
    WITH n AS (SELECT *, CASE sensor WHEN 'eventlog' THEN 'log' ELSE sensor END AS node_type FROM tele),
    l AS (SELECT event_id AS dst, host, ts_us, seq, 'spawned' AS edge_type, ppid AS lp FROM n WHERE ppid <> 0 UNION ALL
          SELECT event_id, host, ts_us, seq, CASE node_type WHEN 'file' THEN 'modified' WHEN 'network' THEN 'opened' ELSE 'triggered' END, pid FROM n WHERE node_type <> 'process')
    SELECT l.host, arg_max(p.event_id, (p.ts_us, p.seq)) AS src, l.dst, l.edge_type FROM l JOIN n p ON p.node_type = 'process' AND p.host = l.host AND p.pid = lp AND (p.ts_us, p.seq) < (l.ts_us, l.seq) AND p.ts_us >= l.ts_us - 1800000000
    WHERE (l.ts_us // 60000000 + 1) * 60000000 <= {_CUT.format('tele')} - 1800000000 GROUP BY l.host, l.dst, l.edge_type""")
def _(t):
    from wardline.operators.graph import build_nodes
    side = lambda: _timed(build_nodes(t.stream("tele")))
    edges = run_to_table(streams.edge_stream(side(), side()), "edges")
    return streams.latest_edges(edges).select("host", "src", "dst", "edge_type")


@query("s11_ioc_enrich_stream", "S-11", f"SELECT seq, b.source AS ioc_source FROM tele LEFT JOIN {_BEST.format(chr(39) * 2)} b ON tele.remote_ip = b.value")
def _(t):
    return run_to_table(streams.ioc_enrich_stream(t.stream("tele"), t.ioc, "remote_ip").select("seq", "ioc_source"), "enriched")


@query("s12_rule_stream", "S-12", _DEMO_SQL)
def _(t):
    return run_to_table(streams.rule_stream(t.stream("tele"), DEMO_RULES).select("seq", "rule_id"), "rules")


@query("s13_prediction_enrich_stream", "S-13 W-15", f"""{NEXT_CTE}
    SELECT alert_id, last AS technique_id, d AS next_technique, probability, CAST(rank AS INTEGER) AS rank
    FROM (SELECT alert_id, {MITRE_LIST}[-1] AS last FROM alerts) LEFT JOIN (SELECT * FROM r WHERE rank <= 5) ON last = s""")
def _(t):
    alerts = t.stream("alerts").withColumn("mitre_ids", mitre()).select("alert_id", "mitre_ids")
    out = run_to_table(streams.prediction_enrich(alerts, prediction_table(feeds.read_attack_chains(t.spark))), "predicted")
    return out.select("alert_id", "technique_id", "next_technique", F.round("probability", 9).alias("probability"), "rank")
