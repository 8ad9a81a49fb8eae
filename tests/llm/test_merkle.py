"""The Merkle manifest against a plain loop, with nulls, repeated rows, single groups and every number of levels a step."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from wardline.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb_up(levels, pos, folded):
    proof = ""
    for level in levels[:-1]:
        run, j = level[pos // 3 * 3 : pos // 3 * 3 + 3], pos % 3
        left, right = "".join(run[:j]), "".join(run[j + 1 :])
        proof, folded, pos = proof + left + right, sha(left + folded + right), pos // 3
    return proof, folded


def levels_of(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def plain(rows):
    """rows (doc_id, source, lang, n_chars, text) to the query's rows."""
    groups = {}
    for r in rows:
        tampered = r[4]
        if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
            tampered = r[4].replace("\n", "")
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0, leaf(r)), r[0], leaf(r), leaf((*r[:4], tampered))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(groups[s], key=lambda x: x[0])]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for pos, (_, i, own, tampered) in enumerate(sorted(groups[s], key=lambda x: x[0])):
            proof, folded = climb_up(trees[s], pos, tampered)
            more, folded = climb_up(top, k, folded)
            out.append((i, own, trees[s][-1][0], top[-1][0], sha(proof + more), folded))
    return sorted(out, key=repr)


def found(docs, **more):
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    tampered = F.when(odd == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    h = merkle.hexed
    rows = merkle.verified(docs, tampered, **more).select(
        "doc_id", h(F.col("leaf")), h(F.col("subroot")), h(F.col("root")), F.sha2(h(F.col("siblings")).cast("binary"), 256), h(F.col("folded_root"))).collect()
    return sorted([tuple(r) for r in rows], key=repr)


KIND = "doc_id long, source string, lang string, n_chars long, text string, gid string, pos string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], KIND)


@pytest.mark.parametrize("levels", [1, 4])
def test_manifest_equals_a_plain_loop(spark, levels):
    rows = [(i, ["a", "b", None, "é", "lone"][0 if i < 120 else 1 + i % 3], "en" if i % 5 else None, i if i % 7 else None, f"text {i}\nline\n" * (i % 4)) for i in range(160)]
    rows += [(9_000, "lone", "en", 1, None), (None, "a", None, None, None), (None, "a", None, None, "x\ny"), (3, "a", "en", 3, "again"), rows[5], rows[5], (7_000, "b", "de", 5, "ü\n" * 50_000)]
    assert found(frame(spark, rows).repartition(5), levels=levels) == plain(rows)


@pytest.mark.parametrize("n", [1, 82])
def test_one_source_of_any_size(spark, n):
    rows = [(i, "only", "en", i, f"{i}\n") for i in range(n)]
    assert found(frame(spark, rows)) == plain(rows)


def test_every_source_has_one_row(spark):
    rows = [(i, f"s{i}", "en", i, f"{i}\n") for i in range(30)]
    assert found(frame(spark, rows)) == plain(rows)


def test_empty_table(spark):
    assert found(frame(spark, [])) == []


def test_query_on_the_small_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    got = merkle.op11(spark, small).collect()
    assert sorted([tuple(r)[:6] for r in got], key=repr) == plain([tuple(r) for r in docs])
    assert all(r.verified == (r.folded_root == r.root) for r in got) and 0 < sum(r.verified for r in got) < len(got)
