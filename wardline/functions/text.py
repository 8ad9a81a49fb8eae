"""Text functions: entropies, hashes, pattern scores (X-01…X-05, X-07, X-08, X-19, X-20, P-10, P-11)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wardline import fixed_values as fv


def _entropy_terms(text: Column) -> Column:
    """Shannon bits over the characters of ``text``: log2(n) − Σ k·log2(k) / n.

    The characters are sorted, so that each distinct one is a run whose length is
    its count; the cost is that of one sort.
    """
    n = F.length(text).cast("double")
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    weighted = F.aggregate(runs, F.lit(0.0), lambda acc, r: acc + F.length(r) * F.log2(F.length(r)))
    return F.log2(n) - weighted / n


def domain_entropy(text: Column) -> Column:
    """Unrounded character entropy; empty or missing text gives 0."""
    return F.when(F.length(text) > 0, _entropy_terms(text)).otherwise(0.0)


def char_entropy(text: Column) -> Column:
    """Character entropy rounded to four decimals; JVM only, for command lines and names."""
    return F.round(domain_entropy(text), 4) + 0.0


@F.pandas_udf(DoubleType())
def _document_entropy(texts: pd.Series) -> pd.Series:
    def bits(text):
        if not text:
            return 0.0
        _, counts = np.unique(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), return_counts=True)
        p = counts / counts.sum()
        return float(-(p * np.log2(p)).sum()) + 0.0

    return texts.map(bits).astype("float64")


def document_entropy(text: Column) -> Column:
    """The same value as :func:`char_entropy` for document-sized text, counted in Arrow batches."""
    return F.round(_document_entropy(text), 4)


def char_entropy_ci(text: Column) -> Column:
    """Character entropy of the lower-cased text."""
    return char_entropy(F.lower(text))


@F.pandas_udf(DoubleType())
def _byte_entropy(blobs: pd.Series) -> pd.Series:
    def bits(blob):
        if blob is None or len(blob) == 0:
            return 0.0
        counts = np.bincount(np.frombuffer(blob, dtype=np.uint8), minlength=256)
        p = counts[counts > 0] / len(blob)
        return float(-(p * np.log2(p)).sum()) + 0.0

    return blobs.map(bits).astype("float64")


def byte_entropy(blob: Column, rounded: bool = True) -> Column:
    """Byte entropy (0–8 bits) of a BINARY column."""
    value = _byte_entropy(blob)
    return F.round(value, 4) if rounded else value


def bigram_score(text: Column) -> Column:
    """Average weight of the letter pairs that are common in English, halved, at most 1."""
    weights = F.create_map(*[F.lit(x) for pair in fv.ENGLISH_BIGRAMS.items() for x in pair])
    low = F.lower(text)
    pairs = F.filter(
        F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2))),
        lambda p: p.rlike(r"^\p{L}\p{L}$"),
    )
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.coalesce(F.try_element_at(weights, p), F.lit(0.0)))
    score = F.when(F.size(pairs) == 0, 0.0).otherwise(
        F.round(F.least(total / F.size(pairs) / 2.0, F.lit(1.0)), 4)
    )
    return F.when(F.length(text) < 2, 0.5).otherwise(score)


def consonant_ratio(text: Column) -> Column:
    """Share of letters that are not a, e, i, o or u; 0.5 without letters."""
    low = F.lower(text)
    letters = F.regexp_count(low, F.lit(r"\p{L}"))
    vowels = F.regexp_count(low, F.lit("[aeiou]"))
    return F.when(letters > 0, (letters - vowels) / letters).otherwise(0.5)


def type_code(text: Column) -> Column:
    """Stable numeric code in [0, 1) of a type name, from the head of its SHA-256."""
    head = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return (head % 100000) / 100000.0


def value_hash(value: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the value's text."""
    return F.substring(F.sha2(value.cast("string"), 256), 1, 16)


def anonymize_text(text: Column) -> Column:
    """Replace the account folder in Windows profile paths."""
    return F.regexp_replace(text, r"(?i)(C:\\Users\\)[^\\]+(\\)", r"$1<USER>$2")


def ja3_string(version: Column, ciphers: Column, extensions: Column, curves: Column, formats: Column) -> Column:
    dashed = lambda a: F.array_join(a.cast("array<string>"), "-")
    return F.concat_ws(",", version.cast("string"), *map(dashed, (ciphers, extensions, curves, formats)))


def ja3_hash(version: Column, ciphers: Column, extensions: Column, curves: Column, formats: Column) -> Column:
    return F.md5(ja3_string(version, ciphers, extensions, curves, formats))


def decode_powershell(message: Column) -> Column:
    """Decode the base64 argument of an encoded command; NULL without a valid one.

    Text is UTF-16LE with U+FFFD for malformed units (the session sets
    ``spark.sql.legacy.codingErrorAction``).
    """
    found = F.regexp_extract(message, fv.ENCODED_COMMAND, 1)
    padded = F.rpad(found, (F.ceil(F.length(found) / 4) * 4).cast("int"), F.lit("="))
    raw = F.try_to_binary(padded, F.lit("base64"))
    return F.when(F.length(found) > 0, F.decode(raw, "UTF-16LE"))


# (?U): word characters, digits and boundaries follow Unicode
def sensitive_counts(text: Column) -> Column:
    """Pattern/count pairs of personal data in the text, never the text itself."""
    found = F.array(*[
        F.struct(F.lit(name).alias("pattern"), F.regexp_count(text, F.lit("(?U)" + rx)).alias("count"))
        for name, rx in fv.SENSITIVE_PATTERNS.items()
    ])
    return F.filter(found, lambda s: s["count"] > 0)


def matched_names(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns found in the text, in the order of the mapping."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?U)" + rx), F.lit(n)) for n, rx in patterns.items()]))


def obfuscation_confidence(entropy: Column, n_patterns: Column) -> Column:
    over = F.when(entropy > 5.0, F.least((entropy - 5.0) / 2.0, F.lit(1.0)) * 0.5).otherwise(0.0)
    return F.round(F.least(over + F.least(n_patterns * 0.15, F.lit(0.5)), F.lit(1.0)), 4)


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 − |A∩B| / |A∪B|; two empty sets are at distance 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1.0 - F.size(F.array_intersect(a, b)) / union)
