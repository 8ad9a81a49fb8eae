"""Queries for the text, name, URL and scoring functions (X-*, P-10…P-14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline import fixed_values as fv
from wardline.functions import names, scoring, text
from wardline.plans.registry import query


def sql_list(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def sql_case(expr: str, mapping: dict, default: str = "NULL") -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "CASE " + expr + " " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items()) \
        + f" ELSE {default} END"


def entropy_sql(expr: str, unit: str = "''", rounded: bool = True) -> str:
    """Scalar subquery: entropy of the characters of ``expr`` (a column in scope)."""
    total = f"length({expr})"
    body = (f"list_sum(list_transform(map_values(hist), lambda c: -(c / {total}) * log2(c / {total})))")
    inner = (f"coalesce((SELECT {body} FROM (SELECT histogram(ch) AS hist FROM "
             f"(SELECT unnest(regexp_extract_all({expr}, '(?s).')) AS ch))), 0.0)")
    return f"round({inner}, 4)" if rounded else inner


@query("x01_char_entropy", "X-01", """
    WITH ch AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents),
    n AS (SELECT doc_id, c, count(*) AS k FROM ch GROUP BY doc_id, c),
    t AS (SELECT doc_id, k, sum(k) OVER (PARTITION BY doc_id) AS total FROM n),
    e AS (SELECT doc_id, round(sum(-(k / total) * log2(k / total)), 4) AS entropy FROM t GROUP BY doc_id)
    SELECT d.doc_id, coalesce(e.entropy, 0.0) AS entropy FROM documents d LEFT JOIN e USING (doc_id)""")
def _(t):
    return t.documents.select("doc_id", text.document_entropy(F.col("text")).alias("entropy"))


@query("x02_char_entropy_ci", "X-02", """
    WITH ch AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '(?s).')) AS c FROM conversations),
    n AS (SELECT conv_id, turn, c, count(*) AS k FROM ch GROUP BY ALL),
    t AS (SELECT conv_id, turn, k, sum(k) OVER (PARTITION BY conv_id, turn) AS total FROM n)
    SELECT conv_id, turn, round(sum(-(k / total) * log2(k / total)), 4) AS entropy FROM t GROUP BY conv_id, turn""")
def _(t):
    return t.conversations.where(F.length("text") > 0).select(
        "conv_id", "turn", text.char_entropy_ci(F.col("text")).alias("entropy"))


@query("x03_domain_entropy", "X-03", """
    WITH d AS (SELECT DISTINCT domain FROM tele),
    ch AS (SELECT domain, unnest(regexp_extract_all(domain, '(?s).')) AS c FROM d),
    n AS (SELECT domain, c, count(*) AS k FROM ch GROUP BY ALL),
    t AS (SELECT domain, k, sum(k) OVER (PARTITION BY domain) AS total FROM n)
    SELECT domain, round(sum(-(k / total) * log2(k / total)), 9) AS entropy FROM t GROUP BY domain""")
def _(t):
    return t.tele.select("domain").distinct().select(
        "domain", F.round(text.domain_entropy(F.col("domain")), 9).alias("entropy"))


@query("x04_byte_entropy", "X-04", """
    WITH ch AS (SELECT page_id, unnest(regexp_extract_all(hex(encode(html)), '..')) AS c FROM pages),
    n AS (SELECT page_id, c, count(*) AS k FROM ch GROUP BY ALL),
    t AS (SELECT page_id, k, sum(k) OVER (PARTITION BY page_id) AS total FROM n)
    SELECT page_id, round(sum(-(k / total) * log2(k / total)), 4) AS entropy FROM t GROUP BY page_id""")
def _(t):
    return t.pages.select("page_id", text.byte_entropy(F.encode("html", "UTF-8")).alias("entropy"))


@query("x05_value_entropy", "X-05", """
    WITH n AS (SELECT host, remote_port, count(*) AS k FROM tele WHERE sensor = 'network' GROUP BY ALL),
    t AS (SELECT host, k, sum(k) OVER (PARTITION BY host) AS total FROM n)
    SELECT host, round(sum(-(k / total) * log2(k / total)), 4) AS port_entropy FROM t GROUP BY host""")
def _(t):
    from wardline.operators.aggregates import value_entropy
    return value_entropy(t.tele.where("sensor = 'network'"), ["host"], "remote_port", "port_entropy")


@query("x06_domain_parts", "X-06 R-16", f"""
    SELECT DISTINCT domain,
        CASE WHEN len(string_split(domain, '.')) >= 2 THEN array_to_string(string_split(domain, '.')[-2:], '.') ELSE domain END AS base,
        CASE WHEN len(string_split(domain, '.')) > 2 THEN array_to_string(string_split(domain, '.')[:-3], '.') ELSE '' END AS sub,
        lower(string_split(domain, '.')[-1]) AS tld,
        lower(string_split(domain, '.')[-1]) IN {sql_list(fv.SUSPICIOUS_TLDS)} AS suspicious
    FROM tele""")
def _(t):
    d = F.col("domain")
    return t.tele.select("domain").distinct().select(
        "domain", names.base_domain(d).alias("base"), names.subdomain(d).alias("sub"),
        names.tld(d).alias("tld"), names.suspicious_tld(d).alias("suspicious"))


_BIGRAM_SQL = f"""
    WITH d AS (SELECT DISTINCT domain AS s FROM tele),
    p AS (SELECT s, unnest(list_transform(range(1, length(s)), lambda i: substr(lower(s), i, 2))) AS bg FROM d),
    w AS (SELECT s, {sql_case('bg', fv.ENGLISH_BIGRAMS, '0.0')} ::DOUBLE AS weight FROM p WHERE regexp_matches(bg, '^[a-z][a-z]$'))
    SELECT s AS domain, round(least(sum(weight) / count(*) / 2.0::DOUBLE, 1.0::DOUBLE), 4) AS score FROM w GROUP BY s"""


@query("x07_bigram_score", "X-07", _BIGRAM_SQL)
def _(t):
    return t.tele.select("domain").distinct().select("domain", text.bigram_score(F.col("domain")).alias("score"))


@query("x08_consonant_ratio", "X-08", r"""
    SELECT doc_id, CASE WHEN l > 0 THEN round((l - v) / l, 6) ELSE 0.5 END AS ratio
    FROM (SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '\p{L}')) AS DOUBLE) AS l,
                 len(regexp_extract_all(lower(text), '[aeiou]')) AS v FROM documents)""")
def _(t):
    return t.documents.select("doc_id", F.round(text.consonant_ratio(F.col("text")), 6).alias("ratio"))


@query("x10_dns_dga", "X-10", f"""
    WITH d AS (SELECT DISTINCT domain FROM tele),
    b AS (SELECT domain, string_split(domain, '.')[-2] AS s FROM d),
    ch AS (SELECT domain, s, unnest(regexp_extract_all(lower(s), '(?s).')) AS c FROM b),
    n AS (SELECT domain, s, c, count(*) AS k FROM ch GROUP BY ALL),
    e AS (SELECT domain, round(sum(-(k / length(s)) * log2(k / length(s))), 4) AS entropy FROM n GROUP BY domain),
    p AS (SELECT domain, unnest(list_transform(range(1, length(s)), lambda i: substr(lower(s), i, 2))) AS bg FROM b),
    g AS (SELECT domain, round(least(avg({sql_case('bg', fv.ENGLISH_BIGRAMS, '0.0')}) / 2.0, 1.0), 4) AS score
          FROM p WHERE regexp_matches(bg, '^[a-z][a-z]$') GROUP BY domain),
    f AS (SELECT b.domain, s, entropy, coalesce(score, 0.0) AS score,
                 len(regexp_extract_all(s, '[a-z]')) AS l, len(regexp_extract_all(s, '[aeiou]')) AS v
          FROM b JOIN e USING (domain) LEFT JOIN g USING (domain))
    SELECT domain, CASE WHEN length(s) < 5 OR entropy < 3.8 THEN 0.0 ELSE round(
        CASE WHEN entropy > 3.8 THEN 0.3 ELSE 0 END + CASE WHEN score < 0.5 THEN 0.35 ELSE 0 END
        + CASE WHEN CASE WHEN l > 0 THEN (l - v) / l ELSE 0.5 END > 0.75 THEN 0.2 ELSE 0 END
        + CASE WHEN length(s) > 12 THEN 0.15 ELSE 0 END, 3)::DOUBLE END AS confidence
    FROM f""")
def _(t):
    return t.tele.select("domain").distinct().select(
        "domain", names.dga_confidence(names.base_domain(F.col("domain"))).alias("confidence"))


_HOST = r"lower(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':[0-9]*$', ''))"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[a-z]+://[^/?#]*[^?#]*[?]([^#]*)', 1)"


@query("x11_url_parts", "X-11", f"SELECT page_id, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query, "
       "TRY_CAST(regexp_extract(url, '^[a-z]+://[^/?#]*:([0-9]+)', 1) AS INTEGER) AS port FROM pages")
def _(t):
    return t.pages.select("page_id", names.url_parts(F.col("url")).alias("u")).select("page_id", "u.*")


_WORDS = " + ".join(f"CASE WHEN contains(lower(url), '{w}') THEN 1 ELSE 0 END" for w in fv.SUSPICIOUS_WORDS)


@query("x12_url_features", "X-12 X-14", f"""
    WITH u AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query FROM pages),
    ch AS (SELECT page_id, host, unnest(regexp_extract_all(host, '.')) AS c FROM u),
    n AS (SELECT page_id, host, c, count(*) AS k FROM ch GROUP BY ALL),
    e AS (SELECT page_id, round(sum(-(k / length(host)) * log2(k / length(host))), 4) AS entropy FROM n GROUP BY page_id)
    SELECT page_id, length(url)::DOUBLE AS url_length, length(host)::DOUBLE AS domain_length,
        greatest(len(string_split(host, '.')) - 2, 0)::DOUBLE AS subdomain_depth,
        len(list_filter(string_split(path, '/'), lambda x: x <> ''))::DOUBLE AS path_depth,
        len(regexp_extract_all(url, '[-@_~!$&''()*+,;=]'))::DOUBLE AS special_char_count,
        round(len(regexp_extract_all(url, '[0-9]')) / length(url), 6) AS digit_ratio,
        CASE WHEN url LIKE 'https%' THEN 1.0 ELSE 0.0 END::DOUBLE AS has_https,
        CASE WHEN regexp_matches(host, '^([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$') THEN 1.0 ELSE 0.0 END::DOUBLE AS has_ip_address,
        coalesce(entropy, 0.0) AS domain_entropy,
        {sql_case("'.' || string_split(host, '.')[-1]", fv.TLD_REPUTATION, '0.5')}::DOUBLE AS tld_reputation,
        len(list_filter(string_split(query, '&'), lambda x: x <> ''))::DOUBLE AS query_param_count,
        CASE WHEN path LIKE '%//%' THEN 1.0 ELSE 0.0 END::DOUBLE AS has_double_slash_redirect,
        CASE WHEN host LIKE '%-%' THEN 1.0 ELSE 0.0 END::DOUBLE AS has_dash_in_domain,
        length(path)::DOUBLE AS path_length,
        round(len(regexp_extract_all(url, '[A-Za-z]')) / length(url), 6) AS letter_ratio,
        len(regexp_extract_all(url, '[.]'))::DOUBLE AS dot_count,
        ({_WORDS})::DOUBLE AS suspicious_word_count
    FROM u LEFT JOIN e USING (page_id)""")
def _(t):
    f = names.url_features(F.col("url"))
    keep = ["url_length", "domain_length", "subdomain_depth", "path_depth", "special_char_count", "has_https",
            "has_ip_address", "domain_entropy", "tld_reputation", "query_param_count",
            "has_double_slash_redirect", "has_dash_in_domain", "path_length", "dot_count",
            "suspicious_word_count"]
    return t.pages.select("page_id", *[f[n].alias(n) for n in keep],
                          *[F.round(f[n], 6).alias(n) for n in ("digit_ratio", "letter_ratio")])


_DIST = ", ".join(f"{{'d': levenshtein(b, '{x}'), 'i': {i}, 'm': greatest(length(b), {len(x)})}}"
                  for i, x in enumerate(fv.TOP_BRANDS))


@query("x13_brand_similarity", "X-13", f"""
    WITH u AS (SELECT page_id, regexp_replace({_HOST}, '[.][^.]*$', '') AS b FROM pages),
    m AS (SELECT page_id, list_min([{_DIST}]) AS best FROM u)
    SELECT page_id, round(greatest(0.0, 1.0 - best.d / best.m), 4) AS similarity FROM m""")
def _(t):
    return t.pages.select("page_id", names.brand_similarity(names.url_parts(F.col("url"))["host"]).alias("similarity"))


@query("x15_priority", "X-15 X-16 P-02 P-13", f"""
    SELECT alert_id,
        round(greatest(0.0, least(100.0, {sql_case('severity', fv.SEVERITY_WEIGHT)} * confidence * 100)), 6)::DOUBLE AS priority_score,
        {sql_case('severity', fv.SEVERITY_RANK)} AS severity_rank,
        CASE WHEN p >= 80 THEN 'fullscreen' WHEN p >= 60 THEN 'toast' WHEN p >= 30 THEN 'tray' ELSE 'log' END AS route
    FROM (SELECT *, least(100.0, greatest(0.0, round({sql_case('severity', fv.ALERT_WEIGHT)} * confidence * 1.5 * 100, 2))) AS p FROM alerts)""")
def _(t):
    sev, conf = F.col("severity"), F.col("confidence")
    return t.alerts.select(
        "alert_id", F.round(scoring.priority_score(sev, conf), 6).cast("double").alias("priority_score"),
        scoring.severity_rank(sev).alias("severity_rank"),
        scoring.route_priority(scoring.priority(sev, conf, context=1.5)).alias("route"))


@query("x17_confidences", "X-17 X-18 P-12 P-14", """
    SELECT seq, round(1.0 / (1.0 + exp(-0.05 * (pid - 50))), 9) AS sigmoid,
        round(1.0 / (1.0 + exp(-4.0 * (k / 100.0) + 2.0)), 9) AS platt,
        CASE WHEN k <= 30 THEN 'Malicious' WHEN k <= 60 THEN 'Suspicious' WHEN k <= 80 THEN 'Neutral' ELSE 'Clean' END AS label,
        CASE WHEN k < 40 THEN 'normal' WHEN k < 60 THEN 'suspicious' ELSE 'anomalous' END AS class
    FROM tele""")
def _(t):
    k = F.col("k")
    return t.tele.select(
        "seq", F.round(scoring.sigmoid_confidence(F.col("pid")), 9).alias("sigmoid"),
        F.round(scoring.platt_scale(k / 100.0), 9).alias("platt"),
        scoring.reputation_label(k).alias("label"), scoring.anomaly_class(k / 100.0).alias("class"))


@query("x19_type_code", "X-19 X-20", """
    SELECT seq, round(CAST('0x' || substr(sha256(event_type), 1, 8) AS BIGINT) % 100000 / 100000.0, 6)::DOUBLE AS code,
        substr(sha256(cmdline), 1, 16) AS value_hash FROM tele""")
def _(t):
    return t.tele.select("seq", F.round(text.type_code(F.col("event_type")), 6).cast("double").alias("code"),
                         text.value_hash(F.col("cmdline")).alias("value_hash"))


@query("x21_techniques", "X-21 X-22", f"""
    SELECT seq, technique, tactic, {sql_case('tactic', fv.TACTIC_ORDER)} AS tactic_rank FROM (
      SELECT seq, technique, {sql_case('technique', fv.TECHNIQUE_TACTIC)} AS tactic FROM (
        SELECT seq, coalesce({sql_case('lower(name)', fv.PROCESS_TECHNIQUE)}, {sql_case('event_type', fv.EVENT_TECHNIQUE)}) AS technique FROM tele))""")
def _(t):
    tech = scoring.infer_technique(F.col("name"), F.col("event_type"))
    tactic = scoring.technique_tactic(tech)
    return t.tele.select("seq", tech.alias("technique"), tactic.alias("tactic"),
                         scoring.tactic_order(tactic).alias("tactic_rank"))


@query("x23_file_change_severity", "X-23 X-24 X-25", r"""
    SELECT seq, lower(path) LIKE 'c:\windows\system32%' OR lower(path) LIKE 'c:\windows\startup%' AS critical,
        CASE WHEN seq % 3 = 0 THEN 'low' WHEN seq % 3 = 1 AND value / 10.0 >= 7.0 THEN 'high' ELSE 'medium' END AS change_severity,
        strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S') || ' UTC' AS seen_at
    FROM tele WHERE sensor = 'file'""")
def _(t):
    change = F.when(F.col("seq") % 3 == 0, "created").when(F.col("seq") % 3 == 1, "modified").otherwise("deleted")
    return t.tele.where("sensor = 'file'").select(
        "seq", scoring.critical_path(F.col("path")).alias("critical"),
        scoring.severity_of_file_change(change, F.col("value") / 10.0).alias("change_severity"),
        scoring.format_ts(F.timestamp_micros("ts_us")).alias("seen_at"))


@query("x24_payload_get", "X-24", """
    SELECT log_id, CASE WHEN json_valid(detail) THEN json_extract_string(detail, '$.log_type') END AS log_type,
        coalesce(CASE WHEN json_valid(detail) THEN json_extract_string(detail, '$.severity') END, 'info') AS severity
    FROM audit""")
def _(t):
    return t.audit.select("log_id", scoring.payload_get(F.col("detail"), "log_type").alias("log_type"),
                          scoring.payload_get(F.col("detail"), "severity", "info").alias("severity"))


@query("p10_anonymize_text", "P-10", r"""
    SELECT seq, regexp_replace(exe, '(?i)(C:\\Users\\)[^\\]+(\\)', '\1<USER>\2', 'g') AS exe FROM tele""")
def _(t):
    return t.tele.select("seq", text.anonymize_text(F.col("exe")).alias("exe"))


@query("p11_ja3_hash", "P-11", """
    SELECT seq, md5('771,' || k || '-' || pid || '-49195,' || '0-' || seq % 50 || ',29-23,0') AS ja3 FROM tele""")
def _(t):
    arr = lambda *c: F.array(*[F.col(x) if isinstance(x, str) else F.lit(x) for x in c])
    return t.tele.select("seq", text.ja3_hash(
        F.lit(771), arr("k", "pid", 49195), F.array(F.lit(0), F.col("seq") % 50), arr(29, 23), arr(0)).alias("ja3"))
