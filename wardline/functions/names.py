"""Domain-name and URL functions (X-06, X-09…X-14, R-16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import fixed_values as fv
from wardline.functions.text import bigram_score, char_entropy, char_entropy_ci, consonant_ratio


def _labels(name: Column) -> Column:
    return F.split(F.regexp_replace(name, r"\.+$", ""), r"\.")


def base_domain(name: Column) -> Column:
    parts = _labels(name)
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(name)


def subdomain(name: Column) -> Column:
    parts = _labels(name)
    return F.when(
        F.size(parts) > 2, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(1))), ".")
    ).otherwise("")


def tld(name: Column) -> Column:
    return F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def suspicious_tld(name: Column) -> Column:
    return tld(name).isin(fv.SUSPICIOUS_TLDS)


def tunnel_confidence(name: Column, per_minute: Column) -> Column:
    """Evidence that a query name carries data: random, long, frequent."""
    sub = subdomain(name)
    return F.round(
        F.when((char_entropy_ci(sub) > 3.5) & (F.length(sub) > 10), 0.4).otherwise(0.0)
        + F.when(F.length(sub) > 50, 0.3).otherwise(0.0)
        + F.when(per_minute > 30, 0.3).otherwise(0.0), 4)


def dga_confidence(base: Column) -> Column:
    """Evidence that the first label of a base domain was generated; 0 below the gates."""
    label = F.substring_index(base, ".", 1)
    entropy = char_entropy_ci(label)
    score = (
        F.when(entropy > 3.8, 0.3).otherwise(0.0)
        + F.when(bigram_score(label) < 0.5, 0.35).otherwise(0.0)
        + F.when(consonant_ratio(label) > 0.75, 0.2).otherwise(0.0)
        + F.when(F.length(label) > 12, 0.15).otherwise(0.0)
    )
    return F.when((F.length(label) >= 5) & (entropy >= 3.8), F.round(score, 3)).otherwise(0.0)


def _with_scheme(url: Column) -> Column:
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))


_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def url_parts(url: Column) -> Column:
    """STRUCT host, path, query, port; a missing scheme is taken as http."""
    full = _with_scheme(url)
    authority = F.regexp_extract(full, _URL, 1)
    hostport = F.element_at(F.split(authority, "@"), -1)
    return F.struct(
        F.lower(F.regexp_replace(hostport, r":\d*$", "")).alias("host"),
        F.regexp_extract(full, _URL, 2).alias("path"),
        F.regexp_extract(full, _URL, 3).alias("query"),
        F.regexp_extract(hostport, r":(\d+)$", 1).try_cast("int").alias("port"),
    )


def suspicious_words(url: Column) -> Column:
    low = F.lower(url)
    hits = [F.when(low.contains(w), 1).otherwise(0) for w in fv.SUSPICIOUS_WORDS]
    return sum(hits[1:], hits[0])


def brand_similarity(domain: Column) -> Column:
    """Closeness of the domain without its last label to the nearest well-known brand."""
    base = F.when(domain.contains("."), F.regexp_replace(domain, r"\.[^.]*$", "")).otherwise(domain)
    brands = F.array(*[
        F.struct(F.lit(b).alias("brand"), F.lit(i).alias("position")) for i, b in enumerate(fv.TOP_BRANDS)])
    nearest = F.array_min(F.transform(brands, lambda b: F.struct(
        F.levenshtein(base, b["brand"]).alias("distance"),
        b["position"].alias("position"),
        F.greatest(F.length(base), F.length(b["brand"])).alias("longest"),
    )))
    close = F.round(F.greatest(F.lit(0.0), 1.0 - nearest["distance"] / nearest["longest"]), 4)
    return F.when(F.length(domain) == 0, 0.0).otherwise(close)


def url_features(url: Column) -> dict[str, Column]:
    """The 22 lexical features of a URL by name, each a DOUBLE column."""
    part = url_parts(url)
    host, path, query = part["host"], part["path"], part["query"]
    n = F.length(url)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    is_ip = host.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")
    reputation = F.create_map(*[F.lit(x) for pair in fv.TLD_REPUTATION.items() for x in pair])
    suffix = F.when(is_ip | ~host.contains("."), "").otherwise(
        F.concat(F.lit("."), F.element_at(F.split(host, r"\."), -1)))
    non_empty = lambda text, sep: F.size(F.filter(F.split(text, sep), lambda x: x != ""))
    share = lambda rx: F.when(n > 0, F.regexp_count(url, F.lit(rx)) / n).otherwise(0.0)
    columns = {
        "url_length": n,
        "domain_length": F.length(host),
        "subdomain_depth": F.when(F.length(host) > 0, F.greatest(F.size(F.split(host, r"\.")) - 2, F.lit(0))).otherwise(0),
        "path_depth": non_empty(path, "/"),
        "special_char_count": F.regexp_count(url, F.lit(r"[@\-_~!$&'()*+,;=]")),
        "digit_ratio": share(r"\d"),
        "has_https": flag(F.lower(url).startswith("https")),
        "has_ip_address": flag(is_ip),
        "domain_entropy": char_entropy(host),
        "tld_reputation": F.coalesce(F.try_element_at(reputation, suffix), F.lit(0.5)),
        "query_param_count": non_empty(query, "&"),
        "has_punycode": flag(host.contains("xn--")),
        "brand_similarity": brand_similarity(host),
        "has_at_symbol": flag(url.contains("@")),
        "has_double_slash_redirect": flag(path.contains("//")),
        "has_dash_in_domain": flag(host.contains("-")),
        "path_length": F.length(path),
        "has_port": flag(part["port"].isNotNull()),
        "letter_ratio": share(r"\p{L}"),
        "dot_count": F.regexp_count(url, F.lit(r"\.")),
        "has_encoded_chars": flag(url.rlike("%[0-9A-Fa-f]{2}")),
        "suspicious_word_count": suspicious_words(url),
    }
    return {name: c.cast("double") for name, c in columns.items()}
