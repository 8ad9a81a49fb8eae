"""Queries for windows, sequences, snapshots and composite DNS/traffic detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline import fixed_values as fv
from wardline.operators import snapshots as sets
from wardline.operators import windows as win
from wardline.plans.catalog_tables import MITRE_LIST, mitre
from wardline.plans.catalog_text import sql_case
from wardline.plans.registry import query
from wardline.sources import feeds


@query("w01_dedup_alerts", "W-01", """
    WITH g AS (SELECT *, lag(ts_us) OVER (PARTITION BY host, sensor, alert_type ORDER BY ts_us, seq) AS p FROM alerts),
    r AS (SELECT *, sum(CASE WHEN p IS NULL OR ts_us - p >= 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY host, sensor, alert_type ORDER BY ts_us, seq) AS run FROM g)
    SELECT arg_min(alert_id, ts_us) AS alert_id, host, sensor, alert_type, min(ts_us) AS ts_us, count(*) AS run_count FROM r GROUP BY host, sensor, alert_type, run""")
def _(t):
    return win.dedup_alerts(t.alerts).select("alert_id", "host", "sensor", "alert_type", "ts_us", "run_count")


@query("w02_query_rate_60s", "W-02", """
    SELECT seq, count(*) OVER (PARTITION BY base ORDER BY ts_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS rate
    FROM (SELECT seq, ts_us, array_to_string(string_split(domain, '.')[-2:], '.') AS base FROM tele WHERE event_type = 'dns_query')""")
def _(t):
    from wardline.functions.names import base_domain
    q = t.tele.where("event_type = 'dns_query'").select("seq", "ts_us", base_domain(F.col("domain")).alias("base"))
    return win.query_rate_60s(q, ["base"]).select("seq", F.col("rate").cast("bigint").alias("rate"))


_BEACON = """
    WITH g AS (SELECT {keys}, ts_us - lag(ts_us) OVER (PARTITION BY {keys} ORDER BY ts_us, seq) AS gap FROM {src}),
    s AS (SELECT {keys}, count(*) AS n, median(gap) AS med, stddev_pop(gap) AS std FROM g WHERE gap IS NOT NULL GROUP BY {keys}),
    w AS (SELECT {keys}, count(*) FILTER (gap >= med * 0.8::DOUBLE AND gap <= med * 1.2::DOUBLE) / any_value(n) AS share FROM g JOIN s USING ({keys}) WHERE gap IS NOT NULL GROUP BY {keys}),
    f AS (SELECT *, CASE WHEN med = 0 THEN 0.0 ELSE std / med END AS cv0, CASE WHEN med = 0 THEN 0.0 ELSE share END AS share0,
          CASE WHEN med = 0 THEN 0.0 ELSE 0.4 * (1.0 - least(std / med, 1.0)) + 0.6 * share END AS score0 FROM s JOIN w USING ({keys}) WHERE n + 1 >= {min})"""


@query("w03_beacon_stats", "W-03", _BEACON.format(keys="host", src="(SELECT host, ts_us, seq FROM tele WHERE sensor = 'network')", min=10) + """
    SELECT host, n + 1 AS n_events, round(med / 1e6, 7) AS median_interval, round(cv0, 6) AS cv, round(share0, 6) AS share, round(score0, 6) AS score, score0 >= 0.5 AS is_beacon FROM f""")
def _(t):
    out = win.beacon_stats(t.tele.where("sensor = 'network'").select("host", "ts_us", "seq"), ["host"])
    return out.select("host", "n_events", "is_beacon", F.round("median_interval", 7).alias("median_interval"),
                      *[F.round(c, 6).alias(c) for c in ("cv", "share", "score")])


@query("w03_beacon_orders", "W-03", _BEACON.format(keys="o_custkey", src="(SELECT o_custkey, epoch_us(o_orderdate) AS ts_us, o_orderkey AS seq FROM orders)", min=10) + """
    SELECT o_custkey, n + 1 AS n_events, round(med / 1e6, 6) AS median_interval, round(score0, 6) AS score FROM f""")
def _(t):
    ev = t.orders.select("o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts_us"), F.col("o_orderkey").alias("seq"))
    return win.beacon_stats(ev, ["o_custkey"]).select("o_custkey", "n_events", F.round("median_interval", 6).alias("median_interval"), F.round("score", 6).alias("score"))


# half of the destinations are contacted every 300 s with up to 4 s of jitter, the rest irregularly
_W04_SRC = """(SELECT 'h' || seq % 10 AS host, CASE WHEN seq % 10 < 5 THEN 'srv' || seq % 5 ELSE remote_ip END AS dest,
    CASE WHEN seq % 10 < 5 THEN 1704067200000000 + seq * 30000000 + k % 5 * 1000000 ELSE ts_us END AS ts_us, seq FROM tele)"""


@query("w04_beacon_alerts", "W-04", _BEACON.format(keys="host, dest", src=_W04_SRC, min=15) + """
    SELECT host, dest, n + 1 AS n_events, round(least(score0, 1.0), 6) AS confidence, round(med / 1e6, 7) AS median_interval FROM f WHERE score0 >= 0.5""")
def _(t):
    steady = F.col("seq") % 10 < 5
    ev = t.tele.select(
        F.concat(F.lit("h"), F.col("seq") % 10).alias("host"), F.when(steady, F.concat(F.lit("srv"), F.col("seq") % 5)).otherwise("").alias("server_name"),
        F.col("remote_ip").alias("destination"), "seq",
        F.when(steady, 1704067200000000 + F.col("seq") * 30_000_000 + F.col("k") % 5 * 1_000_000).otherwise(F.col("ts_us")).alias("ts_us"))
    return win.beacon_alerts(ev).select("host", "dest", "n_events", F.round("confidence", 6).alias("confidence"), F.round("median_interval", 7).alias("median_interval"))


@query("w05_fft_periodicity", "W-05")
def _(t):
    out = win.fft_periodicity(t.tele.where("sensor = 'network'").select("host", "ts_us"), ["host"])
    return out.select("host", "periodic", F.round("dominant_period", 6).alias("dominant_period"), F.round("snr", 6).alias("snr"))


@query("w06_new_values", "W-06", """
    SELECT host, remote_ip, cycle FROM (SELECT DISTINCT host, remote_ip, CAST(floor((ts_us - 1704067200000000) / 3600000000.0) AS BIGINT) AS cycle FROM tele WHERE sensor = 'network') a
    WHERE NOT EXISTS (SELECT 1 FROM tele b WHERE sensor = 'network' AND a.host = b.host AND a.remote_ip = b.remote_ip AND floor((b.ts_us - 1704067200000000) / 3600000000.0) < a.cycle)""")
def _(t):
    rows = t.tele.where("sensor = 'network'").select("host", "remote_ip", F.floor((F.col("ts_us") - 1704067200000000) / 3600000000).alias("cycle")).distinct()
    return win.new_values(rows, ["host"], "remote_ip")


@query("w07_interval_regularity", "W-07", """
    WITH g AS (SELECT uid, (ts_us - lag(ts_us) OVER (PARTITION BY uid ORDER BY ts_us, seq)) / 1e6 AS gap FROM tele),
    s AS (SELECT uid, count(*) AS n_events, avg(gap) AS m, stddev_pop(gap) AS d FROM g GROUP BY uid)
    SELECT uid, n_events, round(m, 5) AS interval_mean, round(d, 5) AS interval_std, CASE WHEN m > 0 THEN d / m ELSE 0 END < 0.15 AND m > 0 AS is_beaconing FROM s WHERE n_events >= 3""")
def _(t):
    out = win.interval_regularity(t.tele.select("uid", "ts_us", "seq"), ["uid"])
    return out.select("uid", "n_events", F.round("interval_mean", 5).alias("interval_mean"), F.round("interval_std", 5).alias("interval_std"), "is_beaconing")


@query("w08_brute_force", "W-08", """
    SELECT host, hour, failed_count, round(span, 2) AS window_seconds, round(CASE WHEN span > 0 THEN failed_count / span * 60.0 ELSE 0.0 END, 2) AS rate_per_minute, failed_count >= 10 AS is_brute_force
    FROM (SELECT host, CAST(floor(ts_us / 3600000000.0) AS BIGINT) AS hour, count(*) FILTER (CASE WHEN code = 4625 THEN true ELSE lower(auth_status) LIKE '%fail%' END) AS failed_count, (max(ts_us) - min(ts_us)) / 1e6 AS span
        FROM tele WHERE sensor = 'eventlog' GROUP BY ALL)""")
def _(t):
    ev = t.tele.where("sensor = 'eventlog'").select("host", F.floor(F.col("ts_us") / 3600000000).alias("hour"), "ts_us",
                                                    F.when(F.col("code") == 4625, "Failed_Login").otherwise("other").alias("event_type"), F.col("auth_status").alias("status"))
    return win.brute_force(ev, ["host", "hour"])


_ENC = {"type_numeric": "CAST('0x' || substr(sha256(event_type), 1, 8) AS BIGINT) % 100000 / 100000.0::DOUBLE",
        "sensor_ordinal": sql_case("sensor", {v: float(i) for i, v in enumerate(fv.SENSORS)}) + "::DOUBLE",
        "severity_ordinal": sql_case("severity", {v: float(i) for i, v in enumerate(fv.SEVERITIES)}) + "::DOUBLE",
        "severity_weight": sql_case("severity", fv.SEVERITY_WEIGHT) + "::DOUBLE", "field_count": "(CASE WHEN sensor = 'network' THEN 3 ELSE 2 END)::DOUBLE",
        "text_length": "(length(CAST(pid AS VARCHAR)) + length(name) + CASE WHEN sensor = 'network' THEN length(remote_ip) ELSE 0 END)::DOUBLE",
        "has_pid": "1.0::DOUBLE", "has_ip": "CASE WHEN sensor = 'network' THEN 1.0 ELSE 0.0 END::DOUBLE"}
_ENC_SELECT = ", ".join(f"{e} AS {n}" for n, e in _ENC.items())
_ENC_AGG = ", ".join(f"round({fn}({n}), 8) AS {n}_{s}" for n in _ENC for s, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))


@query("w09_sequence_features", "W-09 X-19", f"""
    WITH e AS (SELECT host, ts_us / 1e6 AS timestamp, CAST(row_number() OVER (PARTITION BY host ORDER BY ts_us, seq) - 1 AS BIGINT) AS rn, {_ENC_SELECT} FROM tele),
    c AS (SELECT *, rn // 20 AS chunk, rn % 20 AS i FROM e), z AS (SELECT host, chunk, count(*) AS n FROM c GROUP BY ALL HAVING count(*) < 20),
    a AS (SELECT host, chunk, i, timestamp, {', '.join(_ENC)} FROM c UNION ALL SELECT host, chunk, unnest(range(n, 20)), 0.0, {', '.join('0.0' for _ in _ENC)} FROM z),
    d AS (SELECT *, abs(timestamp - lag(timestamp) OVER (PARTITION BY host, chunk ORDER BY i)) AS gap FROM a)
    SELECT host, chunk, {_ENC_AGG}, round(avg(gap), 3) AS gap_mean, round(max(gap), 3) AS gap_max FROM d GROUP BY host, chunk""")
def _(t):
    data = F.to_json(F.struct("pid", "name", F.when(F.col("sensor") == "network", F.col("remote_ip")).alias("ip")))
    out = win.sequence_features(t.tele.select("host", "ts_us", "seq", "event_type", "sensor", "severity", data.alias("data")), ["host"])
    return out.select("host", "chunk", *[F.round(f"{n}_{s}", 8).alias(f"{n}_{s}") for n in _ENC for s in ("mean", "std", "min", "max")],
                      F.round("gap_mean", 3).alias("gap_mean"), F.round("gap_max", 3).alias("gap_max"))


_PATTERNS = ", ".join(f"('{k}', {v[0]})" for k, v in fv.LOG_CHAINS.items())


CHAIN_SQL = f"""
    WITH RECURSIVE pat AS (SELECT * FROM (VALUES {_PATTERNS}) v(chain, p)),
    ev AS (SELECT host, chain, p, code, ts_us, row_number() OVER (PARTITION BY host, chain ORDER BY ts_us, seq) AS r FROM (SELECT * FROM tele WHERE sensor = 'eventlog') JOIN pat ON list_contains(p, code)),
    f(host, chain, r, idx, first_us, a, b) AS (SELECT DISTINCT host, chain, 0::BIGINT, 0, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM ev
        UNION ALL SELECT f.host, f.chain, ev.r, CASE WHEN p[idx + 1] <> code THEN idx WHEN idx + 1 = len(p) THEN 0 ELSE idx + 1 END::INTEGER,
            CASE WHEN p[idx + 1] <> code THEN first_us WHEN idx + 1 = len(p) THEN NULL WHEN idx = 0 THEN ts_us ELSE first_us END,
            CASE WHEN p[idx + 1] = code AND idx + 1 = len(p) THEN first_us END, CASE WHEN p[idx + 1] = code AND idx + 1 = len(p) THEN ts_us END
        FROM f JOIN ev ON f.host = ev.host AND f.chain = ev.chain AND ev.r = f.r + 1)
    SELECT host, chain, a AS first_us, b AS last_us FROM f WHERE b IS NOT NULL AND b - a <= 3000000000"""


@query("w10_eventlog_chains", "W-10", CHAIN_SQL)
def _(t):
    return win.eventlog_chains(t.tele.where("sensor = 'eventlog'"), window_us=3_000_000_000).select("host", "chain", "first_us", "last_us")


@query("w11_clipboard_hijack", "W-11", """
    SELECT seq, n AS changes_in_window FROM (SELECT seq, count(*) OVER (PARTITION BY h ORDER BY ts_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS n FROM (SELECT seq, ts_us, uid % 4 AS h FROM tele)) WHERE n > 5""")
def _(t):
    return win.clipboard_hijack(t.tele.select("seq", "ts_us", (F.col("uid") % 4).alias("h")), ["h"]).select("seq", "changes_in_window")


@query("w12_drift_check", "W-12", """
    WITH r AS (SELECT host AS feature, value, row_number() OVER (PARTITION BY host ORDER BY ts_us, seq) AS a, row_number() OVER (PARTITION BY host ORDER BY ts_us DESC, seq DESC) AS b, count(*) OVER (PARTITION BY host) AS n FROM tele),
    s AS (SELECT feature, avg(value) FILTER (a <= 50) AS bm, stddev_pop(value) FILTER (a <= 50) AS bs, avg(value) FILTER (b <= 50) AS rm FROM r WHERE n >= 100 GROUP BY feature)
    SELECT feature, round(bm, 6) AS baseline_mean, round(bs, 6) AS baseline_std, round(rm, 6) AS recent_mean, abs(rm - bm) > 0.1 * bs AS drifted FROM s""")
def _(t):
    out = win.drift_check(t.tele.select(F.col("host").alias("feature"), "value", "ts_us", "seq"), 50, 0.1)
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("baseline_mean", "baseline_std", "recent_mean")], "drifted")


_CH = ", ".join(f"({i}, {c})" for i, c in enumerate(fv.ATTACK_CHAINS))


NEXT_CTE = f"""
    WITH c AS (SELECT i, p FROM (VALUES {_CH}) v(i, p)), m AS (SELECT p[j] AS s, p[j + 1] AS d FROM (SELECT p, unnest(range(1, len(p))) AS j FROM c)),
    n AS (SELECT s, d, count(*) AS k, sum(count(*)) OVER (PARTITION BY s) AS t FROM m GROUP BY s, d),
    r AS (SELECT s, d, round(1.0 / (1.0 + exp(-4.0 * (k / t) + 2.0)), 9) AS probability, row_number() OVER (PARTITION BY s ORDER BY k DESC, d) AS rank FROM n)"""


@query("w15_next_technique", "W-15 SC-15 S-13", f"""{NEXT_CTE}
    SELECT alert_id, s AS technique_id, d AS next_technique, probability, CAST(rank AS INTEGER) AS rank FROM (SELECT alert_id, {MITRE_LIST}[-1] AS last FROM alerts) JOIN r ON last = s WHERE rank <= 5""")
def _(t):
    out = win.next_technique(t.alerts.withColumn("mitre_ids", mitre()), feeds.read_attack_chains(t.spark))
    return out.select("alert_id", "technique_id", "next_technique", F.round("probability", 9).alias("probability"), "rank")


# --- snapshots ------------------------------------------------------------------------------------
_CYC = "c AS (SELECT host, cycle, lag(cycle) OVER (PARTITION BY host ORDER BY cycle) AS prev, lead(cycle) OVER (PARTITION BY host ORDER BY cycle) AS nxt FROM (SELECT DISTINCT host, cycle FROM snap)), s AS (SELECT snap.*, prev, nxt FROM snap JOIN c USING (host, cycle))"


@query("set01_diff_connections", "SET-01", f"""
    WITH {_CYC} SELECT a.host, a.cycle, a.pid, 'connection_new' AS event_type, 'low' AS severity FROM s a LEFT JOIN s b ON a.host = b.host AND b.cycle = a.prev AND a.pid = b.pid WHERE a.prev IS NOT NULL AND b.pid IS NULL
    UNION ALL SELECT b.host, b.nxt, b.pid, 'connection_closed', 'info' FROM s b LEFT JOIN s a ON a.host = b.host AND a.cycle = b.nxt AND a.pid = b.pid WHERE b.nxt IS NOT NULL AND a.pid IS NULL""")
def _(t):
    return sets.diff_connections(t.snap, ["pid"])


@query("set02_diff_processes", "SET-02", f"""
    WITH {_CYC} SELECT a.host, a.cycle, a.pid, 'process_new' AS event_type, 'low' AS severity, a.name, a.exe FROM s a LEFT JOIN s b ON a.host = b.host AND b.cycle = a.prev AND a.pid = b.pid WHERE a.prev IS NOT NULL AND b.pid IS NULL
    UNION ALL SELECT b.host, b.nxt, b.pid, 'process_gone', 'info', NULL, NULL FROM s b LEFT JOIN s a ON a.host = b.host AND a.cycle = b.nxt AND a.pid = b.pid WHERE b.nxt IS NOT NULL AND a.pid IS NULL""")
def _(t):
    return sets.diff_processes(t.snap)


_DIFF = f"""WITH {_CYC}, d AS (SELECT coalesce(a.host, b.host) AS host, coalesce(a.cycle, b.nxt) AS cycle, coalesce(a.pid, b.pid) AS pid,
        CASE WHEN b.pid IS NULL THEN 'created' WHEN a.pid IS NULL THEN 'deleted' WHEN a.{{v}} <> b.{{v}} THEN 'modified' END AS change, coalesce(a.{{v}}, b.{{v}}) AS val
    FROM (SELECT * FROM s WHERE prev IS NOT NULL) a FULL JOIN (SELECT * FROM s WHERE nxt IS NOT NULL) b ON a.host = b.host AND a.prev = b.cycle AND a.pid = b.pid)"""


@query("set03_diff_registry", "SET-03", _DIFF.format(v="exe") + """
    , ch AS (SELECT host, cycle, pid, length(val) AS n, unnest(regexp_extract_all(val, '(?s).')) AS x FROM d WHERE change IS NOT NULL), k AS (SELECT host, cycle, pid, n, x, count(*) AS c FROM ch GROUP BY ALL),
    e AS (SELECT host, cycle, pid, round(sum(-(c / n) * log2(c / n)), 4) AS entropy FROM k GROUP BY ALL)
    SELECT host, cycle, pid, change, CASE WHEN change = 'created' THEN 'high' ELSE 'medium' END AS severity, entropy FROM d JOIN e USING (host, cycle, pid) WHERE change IS NOT NULL""")
def _(t):
    return sets.diff_registry(t.snap, ["pid"], "exe").select("host", "cycle", "pid", "change", "severity", "entropy")


@query("set04_diff_devices", "SET-04", _DIFF.format(v="name").replace("coalesce(a.name, b.name) AS val", "coalesce(a.name, b.name) AS val") + """
    SELECT host, cycle, pid, CASE change WHEN 'created' THEN 'usb_inserted' ELSE 'usb_removed' END AS event_type,
        CASE WHEN change = 'created' AND val NOT IN (SELECT value FROM whitelist) THEN 'medium' ELSE 'info' END AS severity, val IN (SELECT value FROM whitelist) AS whitelisted FROM d WHERE change IN ('created', 'deleted')""")
def _(t):
    return sets.diff_devices(t.snap, ["pid"], "name", t.whitelist)


@query("set04_diff_adapters", "SET-04", _DIFF.format(v="name") + " SELECT host, cycle, pid, 'rogue_adapter' AS event_type, 'high' AS severity FROM d WHERE change = 'created'")
def _(t):
    return sets.diff_adapters(t.snap, ["pid"])


@query("set05_diff_files", "SET-05 A-10", """
    WITH f AS (SELECT host, CAST(floor((ts_us - 1704067200000000) / 3600000000.0) AS BIGINT) AS cycle, path, max(value) AS v, max(value) / 17.3::DOUBLE AS entropy FROM tele WHERE sensor = 'file' GROUP BY ALL),
    c AS (SELECT host, cycle, lag(cycle) OVER (PARTITION BY host ORDER BY cycle) AS prev, lead(cycle) OVER (PARTITION BY host ORDER BY cycle) AS nxt FROM (SELECT DISTINCT host, cycle FROM f)), s AS (SELECT f.*, prev, nxt FROM f JOIN c USING (host, cycle)),
    d AS (SELECT coalesce(a.host, b.host) AS host, coalesce(a.cycle, b.nxt) AS cycle, coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'created' WHEN a.path IS NULL THEN 'deleted' WHEN a.v <> b.v THEN 'modified' END AS change, coalesce(a.entropy, b.entropy) AS entropy
        FROM (SELECT * FROM s WHERE prev IS NOT NULL) a FULL JOIN (SELECT * FROM s WHERE nxt IS NOT NULL) b ON a.host = b.host AND a.prev = b.cycle AND a.path = b.path)
    SELECT host, cycle, count(*) FILTER (change = 'created') AS files_new, count(*) FILTER (change = 'modified') AS files_modified, count(*) FILTER (change = 'deleted') AS files_deleted, count(*) AS total_changes,
        round(count(*) / 60.0, 2)::DOUBLE AS files_changed_per_minute, count(DISTINCT lower(regexp_extract(path, '[^.](\\.[^.\\\\]+)$', 1))) AS file_types_changed,
        round(greatest(0.0, coalesce(avg(entropy) FILTER (change IN ('created', 'modified')), 0.0) - 4.0), 4) AS entropy_increase_rate, count(*) FILTER (lower(path) LIKE 'c:\\windows\\system32%') AS critical_dir_changes,
        CASE WHEN count(*) FILTER (lower(path) LIKE 'c:\\windows\\system32%') > 0 THEN 'high' WHEN count(*) > 50 THEN 'medium' ELSE 'info' END AS severity
    FROM d WHERE change IS NOT NULL GROUP BY host, cycle""")
def _(t):
    from wardline.operators.aggregates import file_change_stats
    f = t.tele.where("sensor = 'file'").groupBy("host", F.floor((F.col("ts_us") - 1704067200000000) / 3600000000).alias("cycle"), "path").agg(F.max("value").alias("v")) \
        .withColumn("entropy", F.col("v") / 17.3)
    return file_change_stats(sets.diff_files(f, "path", "v", "entropy"), ["host", "cycle"], 3600.0)


@query("set06_diff_canaries", "SET-06", """
    SELECT 'c' || doc_id AS canary_id, CASE doc_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'triggered' ELSE 'deployed' END AS status, CASE doc_id % 7 WHEN 0 THEN 'File deleted' WHEN 1 THEN 'Content modified' END AS reason FROM documents WHERE doc_id % 5 > 1""")
def _(t):
    path, h = F.concat(F.lit("d"), "doc_id"), F.sha2("text", 256)
    k, m = F.col("doc_id") % 7, F.col("doc_id") % 5
    can = t.documents.select(F.concat(F.lit("c"), "doc_id").alias("canary_id"), path.alias("path"), h.alias("content_hash"), F.when(m == 0, "triggered").when(m == 1, "error").otherwise("deployed").alias("status"))
    files = t.documents.where(k > 0).select(path.alias("path"), F.when(k == 1, F.md5("text")).otherwise(h).alias("hash"))
    return sets.diff_canaries(can, files).select("canary_id", "status", "reason")


@query("set07_jaccard_distance", "SET-07 SET-08", """
    WITH p AS (SELECT name, list_distinct(list(remote_ip) FILTER (seq % 2 = 0)) AS a, list_distinct(list(remote_ip) FILTER (seq % 2 = 1)) AS b, count(*) AS n FROM tele GROUP BY name)
    SELECT name, CASE WHEN n < 900 AND n % 2 = 0 THEN 1.0::DOUBLE ELSE round(0.3 * (1.0 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 6)::DOUBLE END AS anomaly FROM p""")
def _(t):
    empty = F.array().cast("array<string>")
    side = lambda odd: F.collect_set(F.when(F.col("seq") % 2 == odd, F.col("remote_ip")))
    p = t.tele.groupBy("name").agg(side(0).alias("a"), side(1).alias("b"), F.count(F.lit(1)).alias("n"))
    prof = p.select(F.col("name").alias("process_hash"), F.when((F.col("n") < 900) & (F.col("n") % 2 == 0), 1).otherwise(9).alias("observations"), F.col("a").alias("endpoints"), *[empty.alias(c) for c in ("files", "children", "dlls", "registry")])
    cur = p.select(F.col("name").alias("process_hash"), F.col("b").alias("endpoints"), *[empty.alias(c) for c in ("files", "children", "dlls", "registry")])
    return sets.dna_anomaly(cur, prof).select(F.col("process_hash").alias("name"), F.round("anomaly", 6).alias("anomaly"))


@query("set09_union_alerts", "SET-09", "SELECT alert_id, sensor FROM alerts")
def _(t):
    return sets.union_alerts(*[t.alerts.where(F.col("sensor") == s).select("alert_id", "sensor") for s in ("network", "process", "file", "eventlog")])
