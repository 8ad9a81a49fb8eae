"""Queries for rules, signatures and stateless detections (R-*, T-07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline import fixed_values as fv
from wardline.functions.text import decode_powershell
from wardline.operators import rules
from wardline.plans.catalog_text import entropy_sql, sql_case, sql_list
from wardline.plans.registry import query

# rules over the columns the telemetry has, exercising every operator
DEMO_RULES = [
    dict(id="eq_case", severity="high", mitre=["T1"], sensor="process", event_type="process_new",
         conditions=[("name", "eq", "powershell.exe")]),
    dict(id="neq", severity="low", mitre=["T2"], sensor="", event_type="dns_query",
         conditions=[("domain", "neq", "www.example.com"), ("pid", "gt", 90)]),
    dict(id="in_list", severity="medium", mitre=["T3"], sensor="", event_type="",
         conditions=[("parent_name", "in", ["winword.exe", "excel.exe"]), ("pid", "lte", 12)]),
    dict(id="not_in", severity="medium", mitre=["T4"], sensor="network", event_type="",
         conditions=[("protocol", "not_in", ["TCP"]), ("remote_port", "gte", 1024), ("remote_port", "lt", 1500)]),
    dict(id="contains_case", severity="low", mitre=["T5"], sensor="", event_type="",
         conditions=[("name", "contains", "Explorer")]),
    dict(id="contains_any", severity="low", mitre=["T6"], sensor="", event_type="",
         conditions=[("exe", "contains_any", ["\\TEMP\\", "\\tmp\\"]), ("value", "gt", 100)]),
    dict(id="regex", severity="high", mitre=["T7"], sensor="", event_type="",
         conditions=[("cmdline", "regex", "-enc [A-Za-z0-9+/]{20,}")]),
    dict(id="missing", severity="high", mitre=["T8"], sensor="", event_type="",
         conditions=[("no_such_field", "neq", "x")]),
    dict(id="unknown_op", severity="high", mitre=["T9"], sensor="", event_type="",
         conditions=[("name", "sounds_like", "x")]),
]
_DEMO_SQL = """
    SELECT seq, 'eq_case' AS rule_id FROM tele WHERE sensor = 'process' AND event_type = 'process_new' AND name = 'powershell.exe'
    UNION ALL SELECT seq, 'neq' FROM tele WHERE event_type = 'dns_query' AND domain <> 'www.example.com' AND pid > 90
    UNION ALL SELECT seq, 'in_list' FROM tele WHERE parent_name IN ('winword.exe', 'excel.exe') AND pid <= 12
    UNION ALL SELECT seq, 'not_in' FROM tele WHERE sensor = 'network' AND protocol <> 'TCP' AND remote_port >= 1024 AND remote_port < 1500
    UNION ALL SELECT seq, 'contains_case' FROM tele WHERE name LIKE '%Explorer%'
    UNION ALL SELECT seq, 'contains_any' FROM tele WHERE lower(exe) LIKE '%\\temp\\%' AND value > 100
    UNION ALL SELECT seq, 'regex' FROM tele WHERE regexp_matches(cmdline, '-enc [A-Za-z0-9+/]{20,}')""".replace("\\\\", "\\")


@query("r01_conditions", "R-01 R-02", _DEMO_SQL)
def _(t):
    return rules.apply_rules(t.tele, DEMO_RULES).select("seq", "rule_id")


@query("r02_behaviour_rules", "R-02", r"""
    WITH e AS (SELECT seq, name, cmdline, exe, length(cmdline) AS n FROM tele WHERE sensor = 'process'),
    c AS (SELECT seq, n, unnest(regexp_extract_all(cmdline, '.')) AS ch FROM e),
    f AS (SELECT seq, n, ch, count(*) AS k FROM c GROUP BY ALL),
    h AS (SELECT seq, round(sum(-(k / n) * log2(k / n)), 4) AS entropy FROM f GROUP BY seq)
    SELECT seq, 'suspicious_office_child' AS rule_id, 'T1059' AS mitre FROM e
        WHERE name IN ('cmd.exe', 'powershell.exe', 'wscript.exe', 'cscript.exe', 'mshta.exe')
    UNION ALL SELECT seq, 'encoded_powershell', 'T1059.001,T1027' FROM e WHERE name = 'powershell.exe'
        AND (lower(cmdline) LIKE '%-enc %' OR lower(cmdline) LIKE '%-encodedcommand %' OR lower(cmdline) LIKE '%-e %' OR lower(cmdline) LIKE '%-ec %')
    UNION ALL SELECT seq, 'high_entropy_cmdline', 'T1027' FROM h WHERE entropy > 5.5
    UNION ALL SELECT seq, 'process_masquerading', 'T1036.005' FROM e
        WHERE (lower(name) IN ('powershell.exe', 'explorer.exe')) OR
              (lower(name) IN ('cmd.exe', 'svchost.exe', 'rundll32.exe') AND lower(exe) NOT LIKE 'c:\windows\system32\%')
    UNION ALL SELECT seq, 'temp_dir_execution', 'T1204' FROM e WHERE lower(exe) LIKE '%\temp\%'""")
def _(t):
    from wardline.functions.text import char_entropy
    ev = t.tele.where("sensor = 'process'").withColumn("event_type", F.lit("process_snapshot")) \
        .withColumn("is_masquerading", rules.masquerading(F.col("name"), F.col("exe"))) \
        .withColumn("cmdline_entropy", char_entropy(F.col("cmdline")))
    return rules.apply_rules(ev).select("seq", "rule_id", F.array_join("rule_mitre", ",").alias("mitre"))


@query("t07_first_match", "T-07", f"""
    SELECT seq, list_min(list({sql_case('rule_id', {r['id']: i for i, r in enumerate(DEMO_RULES)})})) AS first_rule
    FROM ({_DEMO_SQL}) GROUP BY seq""")
def _(t):
    from wardline.functions.scoring import lookup
    first = rules.apply_rules(t.tele, DEMO_RULES, first_only=True)
    return first.select("seq", lookup(F.col("rule_id"), {r["id"]: i for i, r in enumerate(DEMO_RULES)}).alias("first_rule"))


@query("r03_sigma_rules", "R-03", r"""
    WITH e AS (SELECT seq, sensor, domain, lower(cmdline) AS c, lower(exe) AS x, lower(parent_name) AS p FROM tele)
    SELECT seq, 'sigma_ae01-sigma-encoded-ps' AS rule_id, 'T1059.001' AS mitre FROM e WHERE sensor = 'process' AND x LIKE '%\powershell.exe'
        AND (c LIKE '%-encodedcommand%' OR c LIKE '%-enc %' OR c LIKE '%-e %')
    UNION ALL SELECT seq, 'sigma_ae02-sigma-office-child', 'T1204.002' FROM e WHERE sensor = 'process'
        AND p IN ('winword.exe', 'excel.exe', 'powerpnt.exe', 'outlook.exe')
        AND (x LIKE '%\cmd.exe' OR x LIKE '%\powershell.exe' OR x LIKE '%\mshta.exe')
    UNION ALL SELECT seq, 'sigma_ae04-sigma-dns-tunnel', 'T1071.004' FROM e WHERE sensor = 'network' AND regexp_matches(domain, '^[a-zA-Z0-9]{30,}\.')
    UNION ALL SELECT seq, 'sigma_ae05-sigma-certutil', 'T1140' FROM e WHERE sensor = 'process' AND x LIKE '%\certutil.exe'
        AND (c LIKE '%-urlcache%' OR c LIKE '%-decode%' OR c LIKE '%/urlcache%' OR c LIKE '%/decode%')""")
def _(t):
    ev = t.tele.withColumn("event_type", F.when(F.col("sensor") == "process", "process_snapshot").otherwise("dns_query")) \
        .withColumn("parent_exe", F.concat(F.lit("C:\\Office\\"), "parent_name")).withColumn("query_name", F.col("domain"))
    return rules.apply_sigma_rules(ev).select("seq", "rule_id", F.array_join("rule_mitre", ",").alias("mitre"))


_PC_SQL = """CASE WHEN lower(parent_name) IN ('winword.exe', 'excel.exe') AND lower(name) IN ('powershell.exe', 'cmd.exe', 'mshta.exe') THEN 'office_spawns_scripting'
     WHEN lower(parent_name) IN ('winword.exe', 'excel.exe') AND lower(name) = 'rundll32.exe' THEN 'office_spawns_rundll32' END"""
_CL_SQL = "CASE " + " ".join(
    f"WHEN lower(name) = '{b}' AND regexp_matches(cmdline, '(?i){rx}') THEN '{b}_{tid}'"
    for b, rx, _, tid, _ in fv.COMMAND_LINE_RULES) + " END"


@query("r04_lolbin_parent_child", "R-04", f"SELECT seq, {_PC_SQL} AS matched_rule FROM tele WHERE ({_PC_SQL}) IS NOT NULL")
def _(t):
    return rules.lolbin_parent_child(t.tele).select("seq", "matched_rule")


@query("r05_lolbin_cmdline", "R-05", f"SELECT seq, {_CL_SQL} AS matched_rule FROM tele WHERE ({_CL_SQL}) IS NOT NULL")
def _(t):
    return rules.lolbin_cmdline(t.tele).select("seq", "matched_rule")


@query("r06_lolbin_findings", "R-06", f"""
    SELECT * FROM (SELECT seq, {_PC_SQL} AS matched_rule, 0.8::DOUBLE AS confidence FROM tele
    UNION ALL SELECT seq, {_CL_SQL}, 0.85 FROM tele) WHERE matched_rule IS NOT NULL""")
def _(t):
    return rules.lolbin_findings(t.tele).select("seq", "matched_rule", "confidence")


_PS_SQL = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(regexp_replace(text, '[À-ɏ]', '_', 'g'), '{rx.replace(chr(39), chr(39) * 2)}') THEN '{n}' END"
    for n, rx in fv.SCRIPT_PATTERNS.items()) + "], lambda x: x IS NOT NULL), ',')"


@query("r07_powershell_patterns", "R-07", f"""
    WITH src AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL
        SELECT 'e' || seq, CASE WHEN seq % 4 = 0 THEN '& ''a'' + ''b'' | iex ' || cmdline WHEN seq % 4 = 1 THEN 'i`e`x `n' || cmdline
            WHEN seq % 4 = 2 THEN cmdline || ' -Replace 1 -replace 2' ELSE '[Convert]::FromBase64String(' || cmdline END FROM tele)
    SELECT * FROM (SELECT id, {_PS_SQL} AS patterns FROM src) WHERE patterns <> ''""")
def _(t):
    mod, cmd = F.col("seq") % 4, F.col("cmdline")
    script = (F.when(mod == 0, F.concat(F.lit("& 'a' + 'b' | iex "), cmd)).when(mod == 1, F.concat(F.lit("i`e`x `n"), cmd))
              .when(mod == 2, F.concat(cmd, F.lit(" -Replace 1 -replace 2")))
              .otherwise(F.concat(F.lit("[Convert]::FromBase64String("), cmd)))
    src = t.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(
        t.tele.select(F.concat(F.lit("e"), "seq").alias("id"), script.alias("text")))
    return src.select("id", F.array_join(rules.powershell_patterns(F.col("text")), ",").alias("patterns")) \
        .where("patterns <> ''")


@query("r08_powershell_obfuscation", "R-08", r"""
    WITH e AS (SELECT DISTINCT cmdline FROM tele),
    c AS (SELECT cmdline, length(cmdline) AS n, unnest(regexp_extract_all(cmdline, '.')) AS ch FROM e),
    f AS (SELECT cmdline, n, ch, count(*) AS k FROM c GROUP BY ALL),
    h AS (SELECT cmdline, round(sum(-(k / n) * log2(k / n)), 4) AS entropy FROM f GROUP BY cmdline),
    g AS (SELECT cmdline, entropy, CASE WHEN regexp_matches(cmdline, '(?i)-enc\b') THEN 1 ELSE 0 END AS np FROM h)
    SELECT cmdline, entropy, np AS n_patterns, entropy > 5.0 OR np >= 2 AS is_obfuscated,
        round(least(CASE WHEN entropy > 5.0 THEN least((entropy - 5.0) / 2.0, 1.0) * 0.5 ELSE 0.0 END + least(np * 0.15, 0.5), 1.0), 4)::DOUBLE AS confidence
    FROM g""")
def _(t):
    scored = rules.powershell_obfuscation(t.tele.select("cmdline").distinct(), "cmdline")
    return scored.select("cmdline", "entropy", F.size("matched_patterns").alias("n_patterns"), "is_obfuscated", "confidence")


@query("r09_dotnet_injection", "R-09", "SELECT seq FROM tele WHERE seq % 3 = 0 AND seq % 5 = 0")
def _(t):
    ev = t.tele.withColumn("is_dynamic", F.col("seq") % 3 == 0).withColumn(
        "module_il_path", F.when(F.col("seq") % 5 == 0, "").otherwise(F.col("exe")))
    return rules.dotnet_injection(ev).select("seq")


@query("r10_wmi_namespace", "R-10 R-11", """
    SELECT seq, CASE WHEN seq % 4 = 1 THEN 'high' ELSE 'critical' END AS risk,
        CASE WHEN seq % 4 = 1 THEN cmdline ELSE path END AS command_or_script, 'T1546.003' AS mitre_id
    FROM tele WHERE k % 2 = 0 AND seq % 4 IN (1, 3)""")
def _(t):
    ev = t.tele.withColumn("namespace", F.when(F.col("k") % 2 == 0, "ROOT\\Subscription").otherwise("root\\cimv2")) \
        .withColumn("consumer_type", F.when(F.col("seq") % 4 == 1, "CommandLineEventConsumer")
                    .when(F.col("seq") % 4 == 3, "ActiveScriptEventConsumer").otherwise("LogFileEventConsumer")) \
        .withColumn("command_line_template", F.col("cmdline")).withColumn("script_text", F.col("path"))
    return rules.wmi_consumer_findings(rules.wmi_namespace_persistence(ev)).select(
        "seq", "risk", "command_or_script", "mitre_id")


@query("r12_masquerading", "R-12 R-13", rf"""
    SELECT seq, m AS masquerading, CASE WHEN m THEN 'high' WHEN {entropy_sql('cmdline')} > 5.0 THEN 'medium' ELSE 'info' END AS severity
    FROM (SELECT seq, cmdline, lower(name) IN ('powershell.exe', 'explorer.exe') OR
              (lower(name) IN ('cmd.exe', 'svchost.exe', 'rundll32.exe') AND lower(exe) NOT LIKE 'c:\windows\system32\%') AS m
          FROM tele WHERE sensor = 'process')""")
def _(t):
    n, x = F.col("name"), F.col("exe")
    return t.tele.where("sensor = 'process'").select(
        "seq", rules.masquerading(n, x).alias("masquerading"),
        rules.process_event_severity(n, x, F.col("cmdline")).alias("severity"))


@query("r14_badusb_suspects", "R-14", """
    SELECT p_partkey, array_to_string(list_filter([
        CASE WHEN v IN ('2341', '16C0') THEN 'vendor:' || v END,
        CASE WHEN (c IN ('Keyboard', 'HID') OR d LIKE '%keyboard%') AND (c IN ('DiskDrive', 'USB') OR d LIKE '%mass storage%') THEN 'composite:hid+storage' END,
        CASE WHEN c IN ('Keyboard', 'HID') AND d LIKE '%storage%' THEN 'hint:storage' END,
        CASE WHEN d LIKE '%teensy%' THEN 'keyword:teensy' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '2341' WHEN 1 THEN '16C0' WHEN 2 THEN '8087' ELSE '0BDA' END AS v,
        CASE p_partkey % 5 WHEN 0 THEN 'Keyboard' WHEN 1 THEN 'DiskDrive' WHEN 2 THEN 'HID' WHEN 3 THEN 'USB' ELSE 'Net' END AS c,
        lower(p_name || CASE p_partkey % 7 WHEN 0 THEN ' Mass Storage' WHEN 1 THEN ' keyboard' WHEN 2 THEN ' Teensy' ELSE '' END) AS d FROM part)
    WHERE reasons <> ''""")
def _(t):
    pick = lambda sel, *v: F.element_at(F.array(*map(F.lit, v)), (sel + 1).cast("int"))
    dev = t.part.select(
        "p_partkey", pick(F.col("p_size") % 4, "2341", "16c0", "8087", "0bda").alias("vendor_id"),
        pick(F.col("p_partkey") % 5, "Keyboard", "DiskDrive", "HID", "USB", "Net").alias("device_class"),
        F.concat("p_name", pick(F.col("p_partkey") % 7, " Mass Storage", " keyboard", " Teensy", "", "", "", "")).alias("description"))
    return rules.badusb_suspects(dev).select("p_partkey", F.array_join("reasons", ",").alias("reasons"))


@query("r15_doh_evasion", "R-15", f"""
    SELECT seq FROM tele WHERE remote_ip IN {sql_list(fv.DOH_PROVIDERS)} AND remote_port IN (443, 8443)
        AND lower(name) NOT IN {sql_list(fv.DOH_BROWSERS)}""")
def _(t):
    return t.tele.where(rules.doh_evasion(F.col("remote_ip"), F.col("remote_port"), F.col("name"))).select("seq")


def _signature_sql(column: str) -> str:
    parts = []
    for sig in fv.CONTENT_SIGNATURES:
        tests = []
        for k, words in sig["groups"]:
            terms = " + ".join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in words)
            tests.append(f"({terms}) >= {k}")
        if sig.get("regex"):
            tests.append(f"regexp_matches({column}, '{sig['regex']}')")
        parts.append(f"SELECT id, '{sig['name']}' AS signature, '{sig['mitre']}' AS mitre_id FROM src WHERE {' AND '.join(tests)}")
    return " UNION ALL ".join(parts)


@query("r17_content_signatures", "R-17",
       "WITH src AS (SELECT 'd' || doc_id AS id, text AS body, lower(text) AS low FROM documents UNION ALL "
       "SELECT 'p' || page_id, html, lower(html) FROM pages UNION ALL SELECT 'e' || seq, cmdline || ' .enc .crypt ' || path, "
       "lower(cmdline || ' .enc .crypt ' || path) FROM tele) " + _signature_sql("body"))
def _(t):
    src = t.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("body")).unionByName(
        t.pages.select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("body"))).unionByName(
        t.tele.select(F.concat(F.lit("e"), "seq").alias("id"),
                      F.concat_ws(" ", "cmdline", F.lit(".enc .crypt"), "path").alias("body")))
    return rules.content_signatures(src, "body").select("id", "signature", "mitre_id")


_SENS = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS pattern, len(regexp_extract_all(x, '{rx}')) AS hits FROM src" for n, rx in fv.SENSITIVE_PATTERNS.items())


@query("r18_sensitive_data", "R-18", f"""
    WITH src AS (SELECT doc_id, regexp_replace(text, '[À-ÖØ-öø-ɏ]', '_', 'g') AS x FROM documents)
    SELECT * FROM ({_SENS}) WHERE hits > 0""")
def _(t):
    found = rules.sensitive_data_scan(t.documents.select("doc_id", "text"), "text")
    return found.select("doc_id", F.explode("patterns_found").alias("p")).select(
        "doc_id", "p.pattern", F.col("p.count").cast("bigint").alias("hits"))


@query("r19_screen_capture", "R-19", """
    SELECT seq, CASE WHEN lower(name) LIKE '%obs%' THEN 'obs' END AS fragment FROM tele WHERE lower(name) LIKE '%obs%'""")
def _(t):
    return t.tele.select("seq", rules.screen_capture_fragment(F.col("name")).alias("fragment")).where("fragment IS NOT NULL")


@query("r20_whitelist_suppress", "R-20 U-05", """
    WITH w AS (SELECT * FROM whitelist WHERE enabled),
    v AS (SELECT seq, ts_us, 'process' AS entry_type, exe AS value FROM tele UNION ALL SELECT seq, ts_us, 'process', name FROM tele
          UNION ALL SELECT seq, ts_us, 'file', path FROM tele UNION ALL SELECT seq, ts_us, 'ip', remote_ip FROM tele
          UNION ALL SELECT seq, ts_us, 'domain', domain FROM tele)
    SELECT seq FROM tele WHERE seq NOT IN (
        SELECT v.seq FROM v JOIN w USING (entry_type, value) WHERE w.expires_us = 0 OR w.expires_us > v.ts_us)""")
def _(t):
    return rules.whitelist_suppress(t.tele, t.whitelist, "seq").select("seq")


@query("r21_cert_anomaly", "R-21", """
    SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN 0.25 ELSE 0 END + CASE WHEN p_size <= 30 THEN 0.2 ELSE 0 END
        + CASE WHEN p_partkey % 4 = 0 THEN 0.2 ELSE 0 END
        + CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 0.35 ELSE 0 END
               WHEN p_partkey % 5 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 0.35 ELSE 0 END ELSE 0.35 END, 4)::DOUBLE AS score
    FROM part""")
def _(t):
    k = F.col("p_partkey")
    score = rules.cert_anomaly_score(
        F.lit("CN=a"), F.when(k % 3 == 0, "CN=a").otherwise("CN=b"), F.col("p_size"), k % 4 != 0,
        F.when(k % 5 == 0, "RSA").when(k % 5 == 1, "EC").otherwise("DSA"),
        F.when(k % 2 == 0, F.when(k % 5 == 0, 1024).otherwise(224)).otherwise(4096))
    return t.part.select("p_partkey", score.alias("score"))


@query("r22_path_predicates", "R-22 R-23", r"""
    SELECT seq, NOT (remote_ip LIKE '10.%' OR remote_ip LIKE '192.168.%') AS external,
        regexp_matches(lower(path), '\.(exe|dll|scr|bat|cmd|ps1|vbs|js|hta|msi)$') AS executable,
        lower(path) LIKE '%login data%' OR lower(path) LIKE '%vault%' AS credential,
        lower(path) LIKE '%\startup\%' AS persistence, lower(exe) LIKE '%\temp\%' AS temp_origin,
        cmdline LIKE '%-enc %' AS encoded, value > k AND value > 6.0 AS entropy_up, code = 7045 AS persist_event
    FROM tele""")
def _(t):
    path = F.col("path")
    return t.tele.select(
        "seq", rules.external_address(F.col("remote_ip")).alias("external"), rules.is_executable(path).alias("executable"),
        rules.is_credential_path(path).alias("credential"), rules.is_persistence_path(path).alias("persistence"),
        rules.suspicious_origin(F.lit("signed"), F.col("exe")).alias("temp_origin"),
        rules.has_encoded_flag(F.col("cmdline")).alias("encoded"),
        rules.entropy_increase(F.col("k"), F.col("value")).alias("entropy_up"),
        rules.persistence_event(F.col("code"), F.col("event_type")).alias("persist_event"))


@query("r25_search_processes", "R-25", """
    SELECT seq FROM tele WHERE sensor = 'process' AND (contains(CAST(pid AS VARCHAR), 'exp') OR contains(lower(name), 'exp') OR contains(lower(exe), 'exp') OR contains(lower(host), 'exp'))""")
def _(t):
    return rules.search_processes(t.tele.where("sensor = 'process'"), "EXP", ("pid", "name", "host", "exe")).select("seq")


@query("r25_process_stats", "R-25", """
    SELECT count(*) AS total, count(*) FILTER (severity IN ('medium', 'high')) AS suspicious,
        count(*) FILTER (seq % 3 = 0) AS pathless, count(*) FILTER (value > 80) AS high_cpu FROM tele WHERE sensor = 'process'""")
def _(t):
    return rules.process_stats(t.tele.where("sensor = 'process'").withColumn("risk_level", F.upper("severity"))
                               .withColumn("exe", F.when(F.col("seq") % 3 != 0, F.col("exe"))).withColumn("cpu_percent", F.col("value")))


@query("r26_filter_connections", "R-26", "SELECT seq FROM tele WHERE protocol = 'UDP'")
def _(t):
    return rules.filter_connections(t.tele, "udp").select("seq")


@query("p05_decode_powershell", "P-05", r"""
    WITH b AS (SELECT seq, regexp_extract(cmdline, '(?i)(?:-(?:e|enc|encodedcommand))\s+([A-Za-z0-9+/=]{20,})', 1) AS b FROM tele),
    p AS (SELECT seq, hex(from_base64(rpad(b, CAST(ceil(length(b) / 4.0) * 4 AS INTEGER), '='))) AS h FROM b WHERE b <> '' AND length(b) % 4 <> 1)
    SELECT seq, decode(unhex(regexp_replace(substr(h, 1, length(h) - length(h) % 4), '([0-9A-F]{2})00', '\1', 'g')))
        || CASE WHEN length(h) % 4 > 0 THEN chr(65533) ELSE '' END AS raw FROM p""")
def _(t):
    return t.tele.select("seq", decode_powershell(F.col("cmdline")).alias("raw")).where("raw IS NOT NULL")
