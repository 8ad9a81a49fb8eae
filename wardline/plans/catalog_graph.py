"""Queries for the graph, memory, correlation and composite operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline import fixed_values as fv
from wardline.operators import correlate, detect, graph, joins, memory
from wardline.plans.catalog_tables import _BEST, MITRE_LIST, mitre
from wardline.plans.catalog_text import sql_case, sql_list
from wardline.plans.catalog_windows import _BEACON, _CH
from wardline.plans.registry import query
from wardline.sources import feeds

_GRAPH = """n AS (SELECT *, event_id AS node_id, CASE sensor WHEN 'eventlog' THEN 'log' ELSE sensor END AS node_type FROM tele),
    l AS (SELECT node_id, host, ts_us, seq, 'spawned' AS edge_type, ppid AS lp FROM n WHERE ppid <> 0 UNION ALL
          SELECT node_id, host, ts_us, seq, CASE node_type WHEN 'file' THEN 'modified' WHEN 'network' THEN 'opened' ELSE 'triggered' END, pid FROM n WHERE node_type <> 'process'),
    e AS (SELECT l.host, l.node_id AS dst, l.edge_type, arg_max(p.node_id, (p.ts_us, p.seq)) AS src FROM l JOIN n p ON p.node_type = 'process' AND p.host = l.host AND p.pid = lp AND (p.ts_us, p.seq) < (l.ts_us, l.seq) GROUP BY ALL)"""


def _graph(t):
    nodes = graph.build_nodes(t.tele)
    return nodes, graph.build_edges(nodes)


@query("j15_build_edges", "J-15", f"WITH {_GRAPH} SELECT host, src, dst, edge_type FROM e")
def _(t):
    return _graph(t)[1].select("host", "src", "dst", "edge_type")


_TREE = """t AS (SELECT p_partkey AS pid, CASE WHEN p_partkey % 97 = 5 THEN p_partkey + 1 WHEN p_partkey % 97 = 6 THEN p_partkey - 1 WHEN p_partkey % 89 = 3 THEN p_partkey
        WHEN p_partkey % 83 = 4 THEN -1 ELSE p_partkey // 3 END AS ppid FROM part),
    r AS (SELECT t.pid, CASE WHEN t.ppid = 0 OR t.ppid = t.pid OR p.pid IS NULL THEN NULL ELSE t.ppid END AS up FROM t LEFT JOIN t p ON t.ppid = p.pid),
    w(pid, cur, steps) AS (SELECT pid, up, 1 FROM r WHERE up IS NOT NULL UNION ALL SELECT w.pid, r.up, steps + 1 FROM w JOIN r ON w.cur = r.pid WHERE r.up IS NOT NULL AND w.cur <> w.pid AND steps < 40),
    c AS (SELECT DISTINCT pid FROM w WHERE cur = pid),
    g AS (SELECT pid, CASE WHEN pid IN (SELECT pid FROM c) THEN NULL ELSE up END AS up FROM r),
    d(pid, cur, depth) AS (SELECT pid, up, 0 FROM g UNION ALL SELECT d.pid, g.up, depth + 1 FROM d JOIN g ON d.cur = g.pid)"""


def _procs(t):
    k = F.col("p_partkey")
    up = (F.when(k % 97 == 5, k + 1).when(k % 97 == 6, k - 1).when(k % 89 == 3, k).when(k % 83 == 4, -1).otherwise(F.floor(k / 3)))
    return t.part.select(F.lit("h").alias("host"), k.alias("pid"), up.cast("bigint").alias("ppid"))


@query("j21_lineage_depth", "J-21", f"WITH RECURSIVE {_TREE} SELECT pid, max(depth)::BIGINT AS depth FROM d GROUP BY pid")
def _(t):
    return graph.lineage_depth(_procs(t)).select("pid", "depth")


@query("j20_process_tree", "J-20", f"""
    WITH RECURSIVE {_TREE} SELECT pid, arg_max(coalesce(prev, pid), depth) AS root_pid, bool_or(pid IN (SELECT pid FROM c)) AS in_cycle
    FROM (SELECT pid, depth, lag(cur) OVER (PARTITION BY pid ORDER BY depth) AS prev FROM d) GROUP BY pid""")
def _(t):
    return graph.process_tree(_procs(t)).select("pid", "root_pid", "in_cycle")


@query("w14_prune_graph", "W-14", f"""
    WITH {_GRAPH}, k AS (SELECT node_id FROM n WHERE ts_us >= 1704067200000000 + 30000000000 - 1800000000)
    SELECT src, dst, edge_type FROM e WHERE src IN (SELECT node_id FROM k) AND dst IN (SELECT node_id FROM k)""")
def _(t):
    return graph.prune_graph(*_graph(t), 1704067200000000 + 30_000_000_000)[1].select("src", "dst", "edge_type")


# downloads named after a program with a prefix, files named by their program alone, and processes known by their whole path
_DRIVE_BY = _GRAPH.replace("SELECT *, event_id AS node_id", r"""SELECT * REPLACE (CASE WHEN sensor = 'file' AND seq % 9 = 6 THEN 'd:\dl\setup_' || name WHEN sensor = 'file' AND seq % 9 = 7 THEN name ELSE path END AS path,
        CASE WHEN sensor = 'process' AND seq % 4 = 1 THEN 'C:\Windows\System32\' || name ELSE name END AS name), event_id AS node_id""")


@query("g01_drive_by", "G-01", f"""
    WITH {_DRIVE_BY}, f AS (SELECT e.host, e.src, e.dst, lower(p.name) AS br, lower(x.path) AS file FROM e JOIN n x ON e.dst = x.node_id JOIN n p ON e.src = p.node_id
        WHERE e.edge_type = 'modified' AND lower(p.name) IN {sql_list(fv.GRAPH_BROWSERS)} AND regexp_matches(lower(x.path), '\\.(exe|dll|scr|bat|cmd|ps1|vbs|js|hta|msi)$'))
    SELECT f.host, f.src AS node_id, f.dst, count(*) AS executions FROM f JOIN n q ON q.node_type = 'process' AND q.host = f.host AND q.node_id <> f.src AND (contains(file, lower(q.name)) OR contains(lower(q.name), file)) GROUP BY ALL""")
def _(t):
    s, kind = F.col("seq"), F.col("sensor")
    tele = t.tele.withColumns({
        "path": F.when((kind == "file") & (s % 9 == 6), F.concat(F.lit("d:\\dl\\setup_"), "name")).when((kind == "file") & (s % 9 == 7), F.col("name")).otherwise(F.col("path")),
        "name": F.when((kind == "process") & (s % 4 == 1), F.concat(F.lit("C:\\Windows\\System32\\"), "name")).otherwise(F.col("name"))})
    nodes = graph.build_nodes(tele)
    out = graph.chain_drive_by(nodes, graph.build_edges(nodes))
    return out.select("host", "node_id", F.col("target_id").alias("dst"), F.col("evidence")["executions"].alias("executions"))


def _ev(out, *names):
    return out.select("host", "node_id", F.round("confidence", 6).alias("confidence"), *[F.col("evidence")[n].alias(n) for n in names])


_CRED = "(lower(path) LIKE '%login data%' OR lower(path) LIKE '%vault%')"


@query("g02_credential_theft", "G-02", f"""
    WITH {_GRAPH}, f AS (SELECT e.host, src, count(*) AS credential_files FROM e JOIN n ON dst = node_id WHERE edge_type = 'modified' AND {_CRED} GROUP BY ALL), o AS (SELECT src, count(*) AS connections FROM e WHERE edge_type = 'opened' GROUP BY src)
    SELECT f.host, f.src AS node_id, 0.9::DOUBLE AS confidence, credential_files, connections FROM f JOIN o USING (src) JOIN n ON n.node_id = f.src WHERE lower(name) NOT IN {sql_list(fv.GRAPH_BROWSERS)}""")
def _(t):
    return _ev(graph.chain_credential_theft(*_graph(t)), "credential_files", "connections")


@query("g03_ransomware", "G-03", f"""
    WITH {_GRAPH} SELECT e.host, src AS node_id, 0.95::DOUBLE AS confidence, count(*) AS files, count(*) FILTER (value > k AND value > 6.0) AS entropy_rises FROM e JOIN n ON dst = node_id WHERE edge_type = 'modified'
    GROUP BY e.host, src HAVING count(*) >= 3 AND max(ts_us) - min(ts_us) <= 6000000000""")
def _(t):
    nodes = graph.build_nodes(t.tele.withColumn("entropy_before", F.col("k")).withColumn("entropy_after", F.col("value")))
    return _ev(graph.chain_ransomware(nodes, graph.build_edges(nodes), 3, 6_000_000_000), "files", "entropy_rises")


@query("g04_persistence", "G-04", f"""
    WITH {_GRAPH}, x AS (SELECT e.host, src FROM e JOIN n ON dst = node_id WHERE edge_type = 'modified' AND lower(path) LIKE '%\\startup\\%' UNION ALL SELECT e.host, src FROM e JOIN n ON dst = node_id WHERE edge_type = 'triggered' AND code = 7045)
    SELECT x.host, src AS node_id, 0.8::DOUBLE AS confidence, count(*) AS targets FROM x JOIN n ON src = node_id WHERE lower(exe) LIKE '%\\temp\\%' GROUP BY ALL""".replace("\\\\", "\\"))
def _(t):
    return _ev(graph.chain_persistence(*_graph(t)), "targets")


@query("g05_fileless", "G-05", f"""
    WITH {_GRAPH}, u AS (SELECT src AS child, count(*) FILTER (edge_type = 'opened') AS connections, count(*) FILTER (edge_type = 'modified') AS files FROM e WHERE edge_type IN ('opened', 'modified') GROUP BY src)
    SELECT e.host, e.src AS node_id, round(CASE WHEN files > 0 THEN 0.85 * 0.7 ELSE 0.85 END, 6)::DOUBLE AS confidence, connections, files FROM e JOIN n ON e.dst = node_id JOIN u ON child = e.dst
    WHERE edge_type = 'spawned' AND lower(name) = 'powershell.exe' AND cmdline LIKE '%-enc %' AND connections > 0""")
def _(t):
    return _ev(graph.chain_fileless(*_graph(t)), "connections", "files")


@query("g06_lateral", "G-06", """
    WITH f AS (SELECT host, count(*) AS failures, min(ts_us) AS a FROM tele WHERE sensor = 'eventlog' AND code = 4625 GROUP BY host), v AS (SELECT host, ts_us FROM tele WHERE sensor = 'eventlog' AND code = 7045),
    x AS (SELECT host, max(ts_us) AS net FROM tele WHERE sensor = 'network' GROUP BY host), s AS (SELECT t.host, event_id, t.ts_us, min(v.ts_us) AS svc FROM tele t JOIN v ON v.host = t.host AND v.ts_us >= t.ts_us WHERE sensor = 'eventlog' AND code = 4688 GROUP BY ALL)
    SELECT s.host, event_id AS node_id, 0.8::DOUBLE AS confidence, failures, CASE WHEN net >= svc THEN 1 ELSE 0 END::BIGINT AS outbound FROM s JOIN f USING (host) LEFT JOIN x USING (host) WHERE failures >= 3 AND ts_us >= a""")
def _(t):
    nodes = graph.build_nodes(t.tele.withColumn("code", F.when(F.col("code") == 4688, 4624).otherwise(F.col("code"))).withColumn("event_type", F.lit("security_event")))
    return _ev(graph.chain_lateral(nodes), "failures", "outbound")


@query("g07_exfiltration", "G-07", f"""
    WITH {_GRAPH}, f AS (SELECT e.host, src, count(*) AS files FROM e WHERE edge_type = 'modified' GROUP BY ALL HAVING count(*) >= 2),
    o AS (SELECT src, count(*) AS connections, sum(bytes_sent)::BIGINT AS bytes FROM e JOIN n ON dst = node_id WHERE edge_type = 'opened' AND NOT (remote_ip LIKE '10.%' OR remote_ip LIKE '192.168.%') GROUP BY src)
    SELECT host, src AS node_id, round(CASE WHEN bytes < 5000000 THEN 0.85 * 0.6 ELSE 0.85 END, 6)::DOUBLE AS confidence, files, connections, bytes FROM f JOIN o USING (src)""")
def _(t):
    return _ev(graph.chain_exfiltration(*_graph(t), 2, 5_000_000), "files", "connections", "bytes")


_API = "CASE seq % 3 WHEN 0 THEN 'VirtualAllocEx' WHEN 1 THEN 'WriteProcessMemory' ELSE 'CreateRemoteThread' END"


@query("g08_injection", "G-08", f"""
    WITH {_GRAPH}, a AS (SELECT host, src, count(*) AS calls FROM (SELECT e.host, src, {_API} AS api FROM e JOIN n ON dst = node_id WHERE edge_type = 'triggered') GROUP BY host, src HAVING count(DISTINCT api) = 3)
    SELECT host, src AS node_id, 0.9::DOUBLE AS confidence, calls FROM a
    UNION ALL SELECT n.host, node_id, 0.9, 1 FROM n LEFT JOIN e ON e.dst = node_id AND edge_type = 'triggered' WHERE node_type = 'log' AND code = 1074 AND coalesce(src, '') NOT IN (SELECT src FROM a)""")
def _(t):
    pick = F.element_at(F.array(F.lit("VirtualAllocEx"), F.lit("WriteProcessMemory"), F.lit("CreateRemoteThread")), (F.col("seq") % 3 + 1).cast("int"))
    nodes = graph.build_nodes(t.tele.withColumn("api_call", pick).withColumn("code", F.when(F.col("code") == 1074, 8).otherwise(F.col("code"))))
    return _ev(graph.chain_injection(nodes, graph.build_edges(nodes)), "calls")


@query("g09_graph_neighbors", "G-09", f"WITH {_GRAPH} SELECT src, dst, node_type AS dst_type FROM e JOIN n ON dst = node_id WHERE edge_type = 'opened'")
def _(t):
    return graph.graph_neighbors(*_graph(t), "opened").select("src", "dst", "dst_type")


@query("g10_attack_chains", "G-10", f"""
    WITH {_GRAPH}, br AS (SELECT e.host, e.src, e.dst, lower(x.path) AS file FROM e JOIN n x ON e.dst = x.node_id JOIN n p ON e.src = p.node_id
        WHERE e.edge_type = 'modified' AND lower(p.name) IN {sql_list(fv.GRAPH_BROWSERS)} AND regexp_matches(lower(x.path), '\\.(exe|dll|scr|bat|cmd|ps1|vbs|js|hta|msi)$')),
    fl AS (SELECT e.host, src, count(*) AS files, max(ts_us) - min(ts_us) AS span, count(*) FILTER {_CRED.join(['(', ')'])} AS cred FROM e JOIN n ON dst = node_id WHERE edge_type = 'modified' GROUP BY ALL),
    op AS (SELECT src, count(*) AS conns, count(*) FILTER (NOT (remote_ip LIKE '10.%' OR remote_ip LIKE '192.168.%')) AS ext, sum(bytes_sent) FILTER (NOT (remote_ip LIKE '10.%' OR remote_ip LIKE '192.168.%')) AS bytes FROM e JOIN n ON dst = node_id WHERE edge_type = 'opened' GROUP BY src)
    SELECT 'drive_by_download' AS chain_name, src AS node_id, 0.85::DOUBLE AS confidence FROM (SELECT DISTINCT br.src, br.dst FROM br JOIN n q ON q.node_type = 'process' AND q.host = br.host AND q.node_id <> br.src AND (contains(file, lower(q.name)) OR contains(lower(q.name), file)))
    UNION ALL SELECT 'credential_theft', src, 0.9 FROM fl JOIN op USING (src) JOIN n ON n.node_id = src WHERE cred > 0 AND lower(name) NOT IN {sql_list(fv.GRAPH_BROWSERS)}
    UNION ALL SELECT 'ransomware', src, 0.95 FROM fl WHERE files >= 2 AND span <= 60000000
    UNION ALL SELECT 'persistence_installation', src, 0.8 FROM (SELECT DISTINCT src FROM (SELECT src FROM e JOIN n ON dst = node_id WHERE edge_type = 'modified' AND lower(path) LIKE '%\\startup\\%' UNION ALL SELECT src FROM e JOIN n ON dst = node_id WHERE edge_type = 'triggered' AND code = 7045)) JOIN n ON src = node_id WHERE lower(exe) LIKE '%\\temp\\%'
    UNION ALL SELECT 'fileless_attack', e.src, CASE WHEN coalesce(files, 0) > 0 THEN 0.595 ELSE 0.85 END FROM e JOIN n ON e.dst = node_id JOIN op ON op.src = e.dst LEFT JOIN fl ON fl.src = e.dst WHERE edge_type = 'spawned' AND lower(name) = 'powershell.exe' AND cmdline LIKE '%-enc %'
    UNION ALL SELECT 'data_exfiltration', src, CASE WHEN bytes < 50000000 THEN 0.51 ELSE 0.85 END FROM fl JOIN op USING (src) WHERE files >= 2 AND ext > 0""")
def _(t):
    out = graph.attack_chains(*_graph(t), ransom_files=2, exfil_files=2)
    return out.select("chain_name", "node_id", F.round("confidence", 6).alias("confidence"))


_CHAINS9 = [*fv.GRAPH_CHAINS, "other"]


@query("p16_narrate_chains", "P-16", f"""
    SELECT alert_id, 'ATTACK DETECTED: ' || c || chr(10) || 'Severity: ' || severity || ' | Confidence: ' || (30 + k % 70) || '.0%' AS head, CASE mitre WHEN '' THEN 'N/A' ELSE replace(mitre, ',', ', ') END AS mitre
    FROM (SELECT *, {sql_case('k % 9', dict(enumerate(_CHAINS9)))} AS c FROM alerts)""")
def _(t):
    from wardline.operators.reports import narrate_chains
    names = F.array(*map(F.lit, _CHAINS9))
    m = t.alerts.withColumn("chain_name", F.element_at(names, (F.col("k") % 9 + 1).cast("int"))).withColumn("mitre_ids", mitre()) \
        .withColumn("matched_nodes", F.array("event_id")).withColumn("confidence", F.col("confidence").cast("double"))
    told = narrate_chains(m)
    return told.select("alert_id", F.substring_index("narrative", "\n", 2).alias("head"), F.regexp_extract("narrative", "MITRE ATT&CK: (.*)", 1).alias("mitre"))


# --- memory ------------------------------------------------------------------------------------
@query("j16_thread_outside_modules", "J-16", """
    SELECT t.pid, thread_id, start_address FROM threads t WHERE start_address <> 0 AND NOT EXISTS (SELECT 1 FROM modules m WHERE m.pid = t.pid AND m.base <= t.start_address AND t.start_address < m.base + m.size)""")
def _(t):
    return memory.thread_outside_modules(t.modules, t.threads)


def _regions(t):
    """Documents as memory regions: every thirteenth is random bytes, every third has an image header, every ninth is managed code."""
    k = F.col("doc_id")
    text = F.hex(F.encode("text", "UTF-8"))
    header = F.concat(F.lit("4D5A"), F.repeat(F.lit("00"), F.lit(58)), F.lit("44000000"), F.lit("00000000"), F.lit("50450000"))
    random = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.sha2(F.concat_ws("-", k.cast("string"), i.cast("string")).cast("binary"), 256)), "")
    body = F.when(k % 13 == 0, random).when(k % 3 == 0, F.concat(header, F.when(k % 9 == 0, F.lit("42534A42")).otherwise(F.lit("")), text)).otherwise(text)
    return t.documents.select((k % 40).alias("pid"), (k * 65536).alias("base"), F.col("n_chars").cast("bigint").alias("size"), F.unhex(body).alias("content"),
                              F.lit(True).alias("is_committed"), (k % 5 > 0).alias("is_executable"), (k % 7 > 0).alias("is_private"), (k % 11 == 0).alias("is_rwx"), "doc_id")


# regions by kind; random ones hold the 1,024 bytes of 32 digests, and their entropy is summed byte by byte
_MEMORY = """d AS (SELECT doc_id, doc_id % 40 AS pid, doc_id % 13 = 0 AS random, doc_id % 5 > 0 AND doc_id % 7 > 0 AS live,
        NOT EXISTS (SELECT 1 FROM modules m WHERE m.pid = doc_id % 40 AND m.base = doc_id * 65536 AND m.mid % 2 = 0) AS free FROM documents),
    rh AS (SELECT doc_id, array_to_string(list_transform(range(1, 33), lambda i: sha256(doc_id || '-' || i)), '') AS h FROM d WHERE random AND live),
    rb AS (SELECT doc_id, substr(h, 2 * i + 1, 2) AS b FROM rh, (SELECT unnest(range(1024)) AS i)), rc AS (SELECT doc_id, b, count(*) AS c FROM rb GROUP BY ALL),
    re AS (SELECT doc_id, sum(-(c / 1024) * log2(c / 1024)) AS e FROM rc GROUP BY doc_id),
    mf AS (SELECT doc_id AS id, pid, 'reflective_dll' AS finding, 'high' AS severity, 0.85::DOUBLE AS confidence, 'T1620' AS mitre FROM d WHERE doc_id % 3 = 0 AND NOT random AND free AND live
        UNION ALL SELECT doc_id, pid, 'dotnet_injection', 'high', 0.8, 'T1055' FROM d WHERE doc_id % 9 = 0 AND NOT random AND free AND live
        UNION ALL SELECT doc_id, pid, 'shellcode', 'high', least(1.0, (e - 6.0) / 2.0), 'T1055' FROM d JOIN re USING (doc_id) WHERE e > 6.0
        UNION ALL SELECT doc_id, pid, 'rwx_region', 'medium', 0.6, 'T1055.012' FROM d WHERE doc_id % 11 = 0 AND live
        UNION ALL SELECT thread_id, pid, 'suspicious_thread', 'medium', 0.75, 'T1055.003' FROM threads t WHERE start_address <> 0
            AND NOT EXISTS (SELECT 1 FROM modules m WHERE m.mid % 2 = 0 AND m.pid = t.pid AND m.base <= t.start_address AND t.start_address < m.base + m.size))"""


@query("j17_unbacked_images", "J-17", f"""
    WITH {_MEMORY} SELECT doc_id, 'reflective_dll' AS kind FROM d WHERE doc_id % 3 = 0 AND NOT random AND free UNION ALL SELECT doc_id, 'dotnet' FROM d WHERE doc_id % 9 = 0 AND NOT random AND free""")
def _(t):
    r, m = _regions(t), t.modules.where("mid % 2 = 0")
    return memory.unbacked_images(r, m).select("doc_id", F.lit("reflective_dll").alias("kind")).unionByName(
        memory.unbacked_images(r, m, managed=True).select("doc_id", F.lit("dotnet").alias("kind")))


@query("j18_hooked_prologues", "J-18", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey % 6 < 5 AND l_linenumber * 4096 < l_quantity * 1000 AND l_linenumber <= 8 AND (l_partkey % 4 = 0 OR l_partkey % 4 = 1) AND l_suppkey % 6 > 0""")
def _(t):
    k, s = F.col("l_partkey") % 4, F.col("l_suppkey") % 6
    name = F.element_at(F.array(*[F.lit(m) for m in ("NTDLL.dll", "kernel32.dll", "KernelBase.dll", "advapi32.dll", "ws2_32.dll", "user32.dll")]), (s + 1).cast("int"))
    mem = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", name.alias("module"), (F.col("l_linenumber") * 4096).alias("offset"),
                            (F.col("l_quantity") * 1000).alias("module_size"),
                            F.unhex(F.when(k == 0, "E900112233").when(k == 1, "FF25112233").when(k == 2, "4889112233").otherwise("4883112233")).alias("bytes"))
    # the file of the first module already starts with a jump of either form, so it is no hook
    hexed = lambda m: F.unhex(F.when(F.lit(m) == "NTDLL.dll", F.lit("E9FF25")).otherwise(F.lit("4883112233")))
    mods = ["kernel32.dll", "KernelBase.dll", "advapi32.dll", "ws2_32.dll", "user32.dll"]
    disk = mem.select("module", "offset").distinct().where(F.col("module").isin(*mods)).withColumn("bytes", hexed("other"))
    return memory.hooked_prologues(mem, disk).select("l_orderkey", "l_linenumber", "l_partkey")


@query("c04_memory_findings", "C-04", f"""
    WITH {_MEMORY} SELECT pid, finding, severity, mitre AS mitre_id, count(*) AS n, round(sum(confidence), 6) AS confidence FROM mf GROUP BY ALL""")
def _(t):
    found = memory.memory_findings(_regions(t), t.modules.where("mid % 2 = 0"), t.threads)
    return found.groupBy("pid", "finding", "severity", "mitre_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("confidence"))


# --- correlation ---------------------------------------------------------------------------------
def _alert_rows(t):
    return t.alerts.withColumn("mitre_ids", mitre()).withColumn(
        "entities", correlate.extract_entities(pid="a_pid", ip="a_ip", path="a_path", domain="a_domain"))


_TACTICS = "list_filter(list_transform(m, lambda x: " + sql_case("x", fv.TECHNIQUE_TACTIC) + "), lambda x: x IS NOT NULL)"
FOLD_SQL = f"""
    WITH RECURSIVE x AS (SELECT host, alert_id, ts_us, sensor, row_number() OVER (PARTITION BY host ORDER BY ts_us, seq) AS r, {MITRE_LIST} AS m,
        list_filter(['p' || a_pid, 'i' || a_ip, 'f' || a_path, 'd' || a_domain], lambda v: v IS NOT NULL) AS e FROM alerts),
    a AS (SELECT *, {_TACTICS} AS t FROM x),
    f(host, r, alert_id, incident_id, rule, st) AS (
        SELECT DISTINCT host, 0::BIGINT, '', '', '', []::STRUCT(id VARCHAR, e VARCHAR[], t VARCHAR[], l BIGINT, s VARCHAR)[] FROM a
        UNION ALL SELECT host, r, alert_id, CASE WHEN k IS NULL THEN 'inc-' || alert_id ELSE live[k].id END,
            CASE WHEN i1 > 0 THEN 'entity' WHEN i2 > 0 THEN 'tactic' WHEN i3 > 0 THEN 'sensor' ELSE 'new' END,
            CASE WHEN k IS NULL THEN list_append(live, {{'id': 'inc-' || alert_id, 'e': e, 't': t, 'l': ts_us, 's': sensor}})
            ELSE list_concat(list_concat(live[1:k - 1], [{{'id': live[k].id, 'e': list_distinct(list_concat(live[k].e, e)), 't': list_distinct(list_concat(live[k].t, t)), 'l': ts_us, 's': sensor}}]), live[k + 1:]) END
        FROM (SELECT *, coalesce(nullif(i1, 0), nullif(i2, 0), nullif(i3, 0)) AS k FROM (SELECT *,
            coalesce(list_position(list_transform(live, lambda i: len(list_intersect(i.e, e)) > 0), true), 0) AS i1,
            coalesce(list_position(list_transform(live, lambda i: len(list_filter(t, lambda v: NOT list_contains(i.t, v))) > 0), true), 0) AS i2,
            coalesce(list_position(list_transform(live, lambda i: i.s = sensor), true), 0) AS i3
          FROM (SELECT a.*, list_filter(f.st, lambda i: a.ts_us - i.l <= 300000000) AS live FROM f JOIN a ON a.host = f.host AND a.r = f.r + 1))))
    SELECT alert_id, incident_id, rule FROM f WHERE r > 0"""


@query("w16_correlate_exact", "W-16", FOLD_SQL)
def _(t):
    return correlate.correlate_alerts(_alert_rows(t)).select("alert_id", "incident_id", "rule")


@query("w16_correlate_components", "W-16", """
    WITH RECURSIVE x AS (SELECT alert_id, host, ts_us, seq, unnest(list_filter(['p' || a_pid, 'i' || a_ip, 'f' || a_path, 'd' || a_domain], lambda v: v IS NOT NULL)) AS entity FROM alerts),
    g AS (SELECT alert_id, lag(alert_id) OVER w AS prev, ts_us - lag(ts_us) OVER w AS gap FROM x WINDOW w AS (PARTITION BY host, entity ORDER BY ts_us, seq)),
    l AS (SELECT alert_id AS a, prev AS b FROM g WHERE gap <= 300000000 UNION SELECT prev, alert_id FROM g WHERE gap <= 300000000),
    c(a, b) AS (SELECT alert_id, alert_id FROM alerts UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
    SELECT c.a AS alert_id, 'inc-' || arg_min(c.b, (o.ts_us, o.seq)) AS incident_id FROM c JOIN alerts o ON o.alert_id = c.b GROUP BY c.a""")
def _(t):
    return correlate.correlate_alerts(_alert_rows(t), "components").select("alert_id", "incident_id")


def _campaign_input(t):
    e = t.incident_alerts.where("a_path IS NOT NULL").select("incident_id", F.concat(F.lit("f:"), "a_path").alias("entity")).distinct()
    return t.incidents.withColumn("ord", F.col("first_us")), e


@query("a12_detect_campaigns", "A-12 J-19", """
    WITH RECURSIVE i AS (SELECT incident_id, first_us, last_us, row_number() OVER (ORDER BY first_us, incident_id) AS r FROM incidents WHERE status = 'closed'),
    l AS (SELECT DISTINCT i.r, i.incident_id, a_path AS entity FROM i JOIN incident_alerts USING (incident_id) WHERE a_path IS NOT NULL),
    j AS (SELECT DISTINCT a.r AS a, b.r AS b FROM l a JOIN l b ON a.entity = b.entity AND a.r < b.r),
    m AS (SELECT b, list(a) AS earlier FROM j GROUP BY b),
    o AS (SELECT DISTINCT r FROM l), z AS (SELECT r, row_number() OVER (ORDER BY r) AS q FROM o),
    s(q, seeds) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT z.q, CASE WHEN len(list_intersect(coalesce(m.earlier, []::BIGINT[]), seeds)) = 0 THEN list_append(seeds, z.r) ELSE seeds END FROM s JOIN z ON z.q = s.q + 1 LEFT JOIN m ON m.b = z.r),
    f AS (SELECT seeds FROM s ORDER BY q DESC LIMIT 1), sd AS (SELECT unnest(seeds) AS r FROM f),
    w AS (SELECT o.r, coalesce(min(sd.r), o.r) AS seed FROM o LEFT JOIN j ON j.b = o.r LEFT JOIN sd ON sd.r = j.a WHERE o.r NOT IN (SELECT r FROM sd) GROUP BY o.r UNION ALL SELECT r, r FROM sd),
    sz AS (SELECT seed, count(*) AS n FROM w GROUP BY seed),
    sh AS (SELECT seed, count(*) AS n_shared FROM (SELECT w.seed, l.entity FROM w JOIN l USING (r) JOIN sz ON sz.seed = w.seed GROUP BY w.seed, l.entity, sz.n HAVING count(*) = sz.n) GROUP BY seed)
    SELECT x.incident_id AS seed_id, count(*) AS n_incidents, min(i.first_us) AS first_us, max(i.last_us) AS last_us, coalesce(max(n_shared), 0)::BIGINT AS n_shared
    FROM w JOIN i USING (r) JOIN i x ON x.r = w.seed LEFT JOIN sh ON sh.seed = w.seed GROUP BY x.incident_id HAVING count(*) >= 2""")
def _(t):
    return correlate.detect_campaigns(*_campaign_input(t)).select("seed_id", "n_incidents", "first_us", "last_us", "n_shared")


# --- composites --------------------------------------------------------------------------------------
_DOM = f"""q AS (SELECT *, array_to_string(string_split(domain, '.')[-2:], '.') AS base, CASE WHEN len(string_split(domain, '.')) > 2 THEN array_to_string(string_split(domain, '.')[:-3], '.') ELSE '' END AS sub,
        string_split(domain, '.')[-2] AS lab FROM tele WHERE event_type = 'dns_query'),
    rt AS (SELECT *, count(*) OVER (PARTITION BY base ORDER BY ts_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS rate FROM q),
    u AS (SELECT DISTINCT sub AS s FROM q UNION SELECT DISTINCT lab FROM q), ch AS (SELECT s, unnest(regexp_extract_all(lower(s), '(?s).')) AS c FROM u), hh AS (SELECT s, c, count(*) AS k FROM ch GROUP BY ALL),
    en AS (SELECT s, round(sum(-(k / length(s)) * log2(k / length(s))), 4) AS entropy FROM hh GROUP BY s),
    bp AS (SELECT s, unnest(list_transform(range(1, length(s)), lambda i: substr(lower(s), i, 2))) AS bg FROM u),
    bs AS (SELECT s, round(least(sum({sql_case('bg', fv.ENGLISH_BIGRAMS, '0.0')}::DOUBLE) / count(*) / 2.0::DOUBLE, 1.0::DOUBLE), 4) AS score FROM bp WHERE regexp_matches(bg, '^[a-z][a-z]$') GROUP BY s),
    sc AS (SELECT rt.*, CASE WHEN coalesce(es.entropy, 0) > 3.5 AND length(sub) > 10 THEN 0.4 ELSE 0 END + CASE WHEN length(sub) > 50 THEN 0.3 ELSE 0 END + CASE WHEN rate > 30 THEN 0.3 ELSE 0 END AS tun,
        CASE WHEN length(lab) < 5 OR el.entropy < 3.8 THEN 0 ELSE CASE WHEN el.entropy > 3.8 THEN 0.3 ELSE 0 END + CASE WHEN coalesce(bs.score, 0) < 0.5 THEN 0.35 ELSE 0 END
            + CASE WHEN CASE WHEN len(regexp_extract_all(lab, '[a-z]')) > 0 THEN (len(regexp_extract_all(lab, '[a-z]')) - len(regexp_extract_all(lab, '[aeiou]'))) / len(regexp_extract_all(lab, '[a-z]')) ELSE 0.5 END > 0.75 THEN 0.2 ELSE 0 END + CASE WHEN length(lab) > 12 THEN 0.15 ELSE 0 END END AS dga
        FROM rt LEFT JOIN en es ON es.s = sub LEFT JOIN en el ON el.s = lab LEFT JOIN bs ON bs.s = lab)"""


@query("c01_dns_threats", "C-01 X-09", f"""
    WITH {_DOM} SELECT seq, CASE WHEN b.source IS NOT NULL THEN 'known_malicious' WHEN tun >= 0.6 THEN 'tunneling' WHEN dga >= 0.6 THEN 'dga'
        WHEN remote_ip = '8.8.8.8' AND remote_port IN (443, 8443) AND lower(name) <> 'chrome.exe' THEN 'doh_evasion' ELSE 'suspicious_tld' END AS threat,
        round(CASE WHEN b.source IS NOT NULL THEN 0.95 WHEN tun >= 0.6 THEN tun WHEN dga >= 0.6 THEN dga WHEN remote_ip = '8.8.8.8' AND remote_port IN (443, 8443) AND lower(name) <> 'chrome.exe' THEN 0.8 ELSE 0.4 END, 4)::DOUBLE AS confidence
    FROM sc LEFT JOIN {_BEST.format("''")} b ON sc.domain = b.value
    WHERE b.source IS NOT NULL OR tun >= 0.6 OR dga >= 0.6 OR (remote_ip = '8.8.8.8' AND remote_port IN (443, 8443) AND lower(name) <> 'chrome.exe') OR domain LIKE '%.xyz'""")
def _(t):
    return detect.dns_threats(t.tele.where("event_type = 'dns_query'"), t.ioc).select("seq", "threat", F.round("confidence", 4).alias("confidence"))


def _tls(t, ts_us):
    k = F.col("k")
    return t.tele.where("sensor = 'network'").select(
        "event_id", "seq", ts_us.alias("ts_us"), "host", "sensor", F.when(F.col("event_type") == "connection", "etw.tls_handshake").otherwise("etw.http_request").alias("event_type"),
        F.col("domain").alias("server_name"), F.lit(None).cast("string").alias("destination"), F.concat(F.lit("http://"), "domain", F.lit("/x")).alias("url"),
        F.md5(k.cast("string")).alias("ja3_hash"), F.lit("CN=a").alias("issuer"), F.when(k % 3 == 0, "CN=a").otherwise("CN=b").alias("subject"),
        (k % 60).alias("validity_days"), (k % 4 > 0).alias("has_san"), F.lit("RSA").alias("key_type"), F.when(k % 2 == 0, 1024).otherwise(4096).alias("key_bits"))


# every second server is contacted in steps of 300 s, so that some contacts are beacons
_STEADY = "CASE WHEN seq % 10 < 5 THEN 1704067200000000 + seq * 30000000 + k % 5 * 1000000 ELSE ts_us END"


@query("c02_encrypted_traffic", "C-02 W-04", _BEACON.format(keys="host, dest", src=f"(SELECT host, domain AS dest, {_STEADY} AS ts_us, seq FROM tele WHERE sensor = 'network')", min=15) + """
    SELECT host, seq, 'encrypted_traffic_malicious_ja3' AS alert_type, 0.9::DOUBLE AS confidence FROM tele WHERE event_type = 'connection' AND md5(CAST(k AS VARCHAR)) IN (SELECT value FROM ioc WHERE ioc_type = 'hash')
    UNION ALL SELECT host, seq, 'encrypted_traffic_cert_anomaly', s FROM (SELECT host, seq, round(CASE WHEN k % 3 = 0 THEN 0.25 ELSE 0 END + CASE WHEN k % 60 <= 30 THEN 0.2 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 0.2 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 0.35 ELSE 0 END, 4)::DOUBLE AS s FROM tele WHERE event_type = 'connection') WHERE s > 0.5
    UNION ALL SELECT host, NULL, 'encrypted_traffic_beacon', round(least(score0, 1.0), 6) FROM f WHERE score0 >= 0.5""")
def _(t):
    steady = F.when(F.col("seq") % 10 < 5, 1704067200000000 + F.col("seq") * 30_000_000 + F.col("k") % 5 * 1_000_000).otherwise(F.col("ts_us"))
    out = detect.encrypted_traffic(_tls(t, steady), t.ioc.where("ioc_type = 'hash'").withColumn("ioc_type", F.lit("ja3")))
    return out.select("host", "seq", "alert_type", F.round("confidence", 6).alias("confidence"))


# script blocks are the command lines behind a download or two encoded parts
_SCRIPT = "CASE k % 3 WHEN 0 THEN cmdline WHEN 1 THEN 'IEX ([Convert]::FromBase64String(1)); ' || cmdline ELSE cmdline || md5(cmdline) || upper(md5(domain)) || path END"


@query("c03_fileless", "C-03 R-06", rf"""
    WITH z AS (SELECT seq, {_SCRIPT} AS t FROM tele WHERE sensor = 'eventlog' AND code = 4104), zc AS (SELECT seq, length(t) AS n, unnest(regexp_extract_all(t, '.')) AS ch FROM z),
    zf AS (SELECT seq, n, ch, count(*) AS c FROM zc GROUP BY ALL), zh AS (SELECT seq, round(sum(-(c / n) * log2(c / n)), 4) AS e FROM zf GROUP BY seq),
    zp AS (SELECT seq, e, CASE WHEN regexp_matches(t, '(?i)-enc\b') THEN 1 ELSE 0 END + CASE WHEN starts_with(t, 'IEX') THEN 2 ELSE 0 END AS np FROM z JOIN zh USING (seq))
    SELECT seq, 'fileless_powershell_obfuscation' AS alert_type, greatest(0.5, round(least(CASE WHEN e > 5.0 THEN least((e - 5.0) / 2.0, 1.0) * 0.5 ELSE 0.0 END + least(np * 0.15, 0.5), 1.0), 4))::DOUBLE AS confidence FROM zp WHERE e > 5.0 OR np >= 2
    UNION ALL SELECT seq, 'fileless_dotnet_injection' AS alert_type, 0.7::DOUBLE AS confidence FROM tele WHERE sensor = 'eventlog' AND code = 4688 AND k % 2 = 0
    UNION ALL SELECT seq, 'fileless_wmi_persistence', 0.75 FROM tele WHERE sensor = 'eventlog' AND code = 7045 AND k % 3 = 0
    UNION ALL SELECT seq, 'fileless_lolbin_abuse', 0.8 FROM tele WHERE sensor = 'process' AND lower(parent_name) IN ('winword.exe', 'excel.exe') AND lower(name) IN ('powershell.exe', 'cmd.exe', 'mshta.exe', 'rundll32.exe')
    UNION ALL SELECT seq, 'fileless_lolbin_abuse', 0.85 FROM tele WHERE sensor = 'process' AND ((lower(name) = 'certutil.exe' AND (regexp_matches(cmdline, 'urlcache.*-f\s+https?://') OR cmdline LIKE '%-decode%'))
        OR (lower(name) = 'mshta.exe' AND regexp_matches(cmdline, 'https?://|vbscript:|javascript:')) OR (lower(name) = 'rundll32.exe' AND regexp_matches(cmdline, 'javascript:|vbscript:')))""")
def _(t):
    c = F.col("code")
    kind = F.when(F.col("sensor") == "process", "process_new").when(c == 4688, "etw.dotnet_assembly_load").when(c == 7045, "etw.wmi_activity").when(c == 4104, "etw.powershell_scriptblock")
    ev = t.tele.where("sensor IN ('process', 'eventlog')").withColumn("event_type", kind).withColumn("is_dynamic", F.col("k") % 2 == 0).withColumn("module_il_path", F.lit("")) \
        .withColumn("namespace", F.when(F.col("k") % 3 == 0, "root\\SUBSCRIPTION").otherwise("root\\cimv2")).withColumn("script_text", F.expr(_SCRIPT))
    return detect.fileless(ev).select("seq", "alert_type", "confidence")


@query("c05_enrich_events", "C-05 S-11", f"""
    SELECT seq, coalesce(d.source, a.source) AS ioc_source, coalesce(i.severity, j.severity) AS threat_intel_severity, score::DOUBLE AS reputation_score FROM tele
    LEFT JOIN {_BEST.format("'ip'")} a ON remote_ip = a.value LEFT JOIN {_BEST.format("'domain'")} d ON domain = d.value
    LEFT JOIN {_BEST.format("''")} i ON remote_ip = i.value LEFT JOIN {_BEST.format("''")} j ON domain = j.value LEFT JOIN reputation ON remote_ip = address""")
def _(t):
    return joins.enrich_events(t.tele, t.ioc, t.reputation).select("seq", "ioc_source", "threat_intel_severity", F.col("reputation_score").cast("double").alias("reputation_score"))


@query("c07_make_alert", "C-07", """
    SELECT event_id, 'alt-' || sha256(event_id || '|rule_x|demo') AS alert_id, 'Detected by demo at ' || CAST(round(ts_us / 1e6) AS BIGINT) AS description FROM tele WHERE severity = 'critical'""")
def _(t):
    out = detect.make_alert(t.tele.where("severity = 'critical'"), F.lit("rule_x"), F.col("name"), F.col("severity"), F.lit(0.5), "demo")
    return out.select("event_id", "alert_id", "description")


def _flow(t):
    from wardline.plans.catalog_rules import DEMO_RULES
    return detect.rule_alerts(t.tele, DEMO_RULES)


@query("c08_alert_flow", "C-08 W-01 A-02", """
    WITH r AS (SELECT seq, host, sensor, ts_us, CASE WHEN event_type = 'process_new' AND name = 'powershell.exe' THEN 'eq_case|high' WHEN event_type = 'dns_query' AND domain <> 'www.example.com' AND pid > 90 THEN 'neq|low'
        WHEN parent_name IN ('winword.exe', 'excel.exe') AND pid <= 12 THEN 'in_list|medium' WHEN sensor = 'network' AND protocol <> 'TCP' AND remote_port >= 1024 AND remote_port < 1500 THEN 'not_in|medium'
        WHEN name LIKE '%Explorer%' THEN 'contains_case|low' WHEN lower(exe) LIKE '%\\temp\\%' AND value > 100 THEN 'contains_any|low' WHEN regexp_matches(cmdline, '-enc [A-Za-z0-9+/]{20,}') THEN 'regex|high' END AS h FROM tele),
    g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY host, sensor, h ORDER BY ts_us, seq) AS gap FROM r WHERE h IS NOT NULL),
    k AS (SELECT string_split(h, '|')[2] AS severity FROM g WHERE gap IS NULL OR gap >= 60000000)
    SELECT 'severity' AS dimension, v AS value, (SELECT count(*) FROM k WHERE severity = v) AS n FROM (SELECT unnest(['info', 'low', 'medium', 'high', 'critical']) AS v)
    UNION ALL SELECT 'status', v, CASE WHEN v = 'new' THEN (SELECT count(*) FROM k) ELSE 0 END FROM (SELECT unnest(['new', 'investigating', 'resolved', 'dismissed', 'auto_suppressed']) AS v) UNION ALL SELECT 'total', 'all', count(*) FROM k""".replace("\\\\", "\\"))
def _(t):
    from wardline.operators.aggregates import alert_breakdown
    return alert_breakdown(detect.process_alerts(_flow(t)))


# scores, predictions, content matches and temporal patterns are given; the DNS rate is too
_GIVEN = """ev AS (SELECT * REPLACE (CASE WHEN sensor = 'eventlog' AND code = 4688 THEN 'etw.process_image_load' ELSE event_type END AS event_type), (k % 100) / 100.0::DOUBLE AS score, k % 2 = 0 AS verified FROM tele),
    up AS (SELECT value AS url, CASE severity WHEN 'low' THEN 'benign' WHEN 'medium' THEN 'suspicious' ELSE 'malicious' END AS label FROM ioc WHERE ioc_type = 'domain'),
    cm AS (SELECT DISTINCT value AS path, 'listed_' || enabled AS rule FROM whitelist WHERE entry_type = 'file'),
    mp AS (SELECT pid, finding, severity, mitre, max(confidence) AS confidence FROM mf GROUP BY ALL)"""
_RULE = """CASE WHEN event_type = 'process_new' AND name = 'powershell.exe' THEN 'eq_case|high|T1' WHEN event_type = 'dns_query' AND domain <> 'www.example.com' AND pid > 90 THEN 'neq|low|T2'
        WHEN parent_name IN ('winword.exe', 'excel.exe') AND pid <= 12 THEN 'in_list|medium|T3' WHEN sensor = 'network' AND protocol <> 'TCP' AND remote_port >= 1024 AND remote_port < 1500 THEN 'not_in|medium|T4'
        WHEN name LIKE '%Explorer%' THEN 'contains_case|low|T5' WHEN lower(exe) LIKE '%\\temp\\%' AND value > 100 THEN 'contains_any|low|T6' WHEN regexp_matches(cmdline, '-enc [A-Za-z0-9+/]{20,}') THEN 'regex|high|T7' END"""
_DNS_STAGE = """CASE WHEN seq IN (SELECT seq FROM sc JOIN ioc ON ioc_type = 'domain' AND sc.domain = ioc.value) THEN 'known_malicious' WHEN tun >= 0.6 THEN 'tunneling' WHEN dga >= 0.6 THEN 'dga'
        WHEN remote_ip = '8.8.8.8' AND remote_port IN (443, 8443) AND lower(name) <> 'chrome.exe' THEN 'doh_evasion' WHEN domain LIKE '%.xyz' THEN 'suspicious_tld' END"""
_RATED = _DOM.replace("count(*) OVER (PARTITION BY base ORDER BY ts_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)", "seq % 40")


@query("c06_detect", "C-06 S-13 W-15", f"""
    WITH {_GRAPH}, {_RATED}, {_MEMORY}, {_GIVEN},
    u2 AS (SELECT src AS child, count(*) FILTER (edge_type = 'opened') AS connections, count(*) FILTER (edge_type = 'modified') AS files FROM e WHERE edge_type IN ('opened', 'modified') GROUP BY src),
    al AS (SELECT event_id, 'rule' AS stage, 'rule_' || string_split(h, '|')[1] AS alert_type, string_split(h, '|')[2] AS severity, 0.95::DOUBLE AS confidence, 'rule_engine' AS engine, string_split(h, '|')[3] AS mitre
            FROM (SELECT *, {_RULE} AS h FROM ev) WHERE h IS NOT NULL
        UNION ALL SELECT event_id, 'cascade', CASE WHEN score >= 0.6 THEN 'confirmed_anomaly' ELSE 'statistical_anomaly' END, CASE WHEN score >= 0.6 THEN 'high' ELSE 'medium' END,
            round(CASE WHEN score >= 0.6 THEN least(score + 0.1, 1.0) ELSE score END, 3), CASE WHEN score >= 0.6 THEN 'autoencoder' ELSE 'isolation_forest' END, '' FROM ev WHERE score >= 0.4 AND (score < 0.6 OR verified)
        UNION ALL SELECT event_id, 'url', 'url_' || label, CASE label WHEN 'malicious' THEN 'high' ELSE 'medium' END, 0.7, 'url_classifier', '' FROM ev JOIN up ON url = domain WHERE label <> 'benign'
        UNION ALL SELECT event_id, 'dns', 'dns_' || th, {sql_case('th', {k: v for k, (v, _) in fv.DNS_THREATS.items()})},
            CASE th WHEN 'known_malicious' THEN 0.95 WHEN 'tunneling' THEN least(tun, 1.0) WHEN 'dga' THEN dga WHEN 'doh_evasion' THEN 0.8 ELSE 0.4 END::DOUBLE, 'dns_analyzer', {sql_case('th', {k: ','.join(m) for k, (_, m) in fv.DNS_THREATS.items()})}
            FROM (SELECT *, {_DNS_STAGE} AS th FROM sc) WHERE th IS NOT NULL
        UNION ALL SELECT event_id, 'memory', finding, mp.severity, confidence, 'memory_forensics', mp.mitre FROM ev JOIN mp USING (pid) WHERE event_type = 'etw.process_image_load'
        UNION ALL SELECT event_id, 'content', 'yara_' || rule, 'high', 0.9, 'yara_scanner', '' FROM ev JOIN cm USING (path) WHERE event_type = 'file_change'
        UNION ALL SELECT e.src, 'chain', 'chain_fileless_attack', 'critical', round(CASE WHEN files > 0 THEN 0.85 * 0.7 ELSE 0.85 END, 3)::DOUBLE, 'graph_analyzer', '{','.join(fv.GRAPH_CHAINS['fileless_attack'][0])}'
            FROM e JOIN n ON e.dst = node_id JOIN u2 ON child = e.dst WHERE edge_type = 'spawned' AND lower(name) = 'powershell.exe' AND cmdline LIKE '%-enc %' AND connections > 0
        UNION ALL SELECT event_id, 'pattern', 'temporal_pattern', 'high', 0.75, 'lstm_analyzer', '' FROM tele WHERE sensor = 'eventlog' AND k % 25 = 0),
    mv AS (SELECT p[j] AS s, p[j + 1] AS d FROM (SELECT p, unnest(range(1, len(p))) AS j FROM (VALUES {_CH}) v(i, p))), nx AS (SELECT s, least(count(DISTINCT d), 5)::INTEGER AS n_predictions FROM mv GROUP BY s)
    SELECT event_id, stage, alert_type, severity, round(confidence, 6) AS confidence, engine, mitre, coalesce(n_predictions, 0) AS n_predictions FROM al LEFT JOIN nx ON string_split(mitre, ',')[-1] = s""")
def _(t):
    k = F.col("k")
    kind = F.when((F.col("sensor") == "eventlog") & (F.col("code") == 4688), detect.IMAGE_LOAD).otherwise(F.col("event_type"))
    events = t.tele.withColumns({"event_type": kind, "score": (k % 100) / 100.0, "verified": k % 2 == 0, "rate": F.col("seq") % 40})
    domains = t.ioc.where("ioc_type = 'domain'")
    level = F.col("severity")
    urls = domains.select(F.col("value").alias("url"), F.when(level == "low", "benign").when(level == "medium", "suspicious").otherwise("malicious").alias("label"), F.lit(0.7).alias("confidence"))
    found = memory.memory_findings(_regions(t), t.modules.where("mid % 2 = 0"), t.threads).groupBy("pid", "finding", "severity", "mitre_id").agg(
        F.max("confidence").alias("confidence")).withColumns({"address": F.lit(0), "size": F.lit(0)})
    content = t.whitelist.where("entry_type = 'file'").select(F.col("value").alias("path"), F.concat(F.lit("listed_"), "enabled").alias("rule"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("mitre")).distinct()
    patterns = t.tele.where("sensor = 'eventlog' AND k % 25 = 0").select("event_id", F.lit(None).cast("string").alias("description"), F.lit(None).cast("double").alias("confidence"))
    known = [detect.url_findings(urls), detect.domain_findings(domains), detect.memory_alert_findings(found), detect.content_findings(content),
             detect.chain_findings(graph.chain_fileless(*_graph(t))), detect.pattern_findings(patterns)]
    from wardline.plans.catalog_rules import DEMO_RULES
    out = detect.dispatch(events, *known, rule_set=DEMO_RULES, chains=feeds.read_attack_chains(t.spark))
    return out.select("event_id", "stage", "alert_type", "severity", F.round("confidence", 6).alias("confidence"), "engine",
                      F.array_join("mitre_ids", ",").alias("mitre"), F.coalesce(F.size(F.coalesce("predictions", F.array().cast("array<struct<technique_id:string,probability:double>>"))), F.lit(0)).alias("n_predictions"))


@query("c09_respond", "C-09", """
    SELECT incident_id FROM (SELECT incident_id, count(*) AS n, bool_or(severity IN ('high', 'critical')) AS h FROM incident_alerts GROUP BY incident_id) WHERE n >= 3 OR h""")
def _(t):
    from wardline.operators.aggregates import incident_rollup
    inc = incident_rollup(t.incident_alerts.withColumn("mitre_ids", mitre()).withColumn("entities", correlate.extract_entities(pid="a_pid")))
    steps, due = detect.respond(t.alerts.withColumn("data", F.lit("{}")), inc)
    return due.select("incident_id")


@query("c10_threat_intel_overview", "C-10", """
    SELECT count(*) AS total_iocs, count(*) FILTER (ioc_type = 'ip') AS ip_count, (SELECT count(DISTINCT feed_name) FROM feed_runs) AS total_feeds FROM ioc""")
def _(t):
    from wardline.operators.aggregates import feed_health, feed_health_summary, ioc_by_type
    feeds_row = feed_health_summary(feed_health(t.feed_runs, 1104537600000000)).withColumn("_j", F.lit(1))
    return ioc_by_type(t.ioc).withColumn("_j", F.lit(1)).join(feeds_row, "_j").select(F.col("total").alias("total_iocs"), "ip_count", "total_feeds")
