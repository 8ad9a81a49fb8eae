"""Merkle manifest of a table, checked by a recursive query that climbs from every leaf.

Every row is a leaf: the SHA-256 of its fields, each as byte count, colon and value (``-`` if null).  The leaves of
a group (``source``) are ordered by id, and while more than one node is left every ``FAN`` consecutive ones become
their hash.  The group roots, ordered by group, become the root in the same way.

*Numbering.*  Rows are range-partitioned by (group, id, leaf) and counted per partition, so a hot group spreads.
*Building.*  ``LEVELS`` levels are built at once in blocks of ``FAN ** LEVELS`` nodes; each round's rows are written.
A stored node row names its node (tree, level, pos), links to the ancestor ``LEVELS`` levels above and holds the
runs' other members on the way (``path``: left and right digests per level), for less than that where the tree ends.
*Climbing.*  A ``WITH RECURSIVE`` query starts with the stored row of every leaf and joins the stored rows above on the link: each step
folds the leaf's hash through the runs.  Above a leaf's first block the siblings are those of the block's first leaf, so
only its climb appends them, and they come back to the others by a join.  Rows of upper levels are repeated per salt,
so that the many leaves beneath one node do not meet in one task.

Null ids come first in their group and are never tampered with; null groups are one group, the first.  Repeated rows
are leaves each; rows that are equal in id and group are ordered by leaf.  Empty and long texts are values like any
other.  An empty table gives an empty result; other columns are not part of a leaf.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.registry import query
from wardline.llm.tables import table, written

FAN, LEVELS = 3, 4
SALTS_INNER, SALTS_TOP = 16, 64
TOP_TREE = -1
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_text(fields: list[Column]) -> Column:
    """What a leaf hashes: every field as byte count, colon and value."""
    def one(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.concat(*[one(f) for f in fields])


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def salts_of(tree: Column, level: Column) -> Column:
    return F.when(tree == TOP_TREE, SALTS_TOP).when(level > 0, SALTS_INNER).otherwise(1)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``gid`` (unique), ``pos`` (from 0 in the order of the group), ``n`` (rows of the group) and
    ``tree`` (number of the group in its order, nulls first)."""
    place = F.monotonically_increasing_id()
    dealt = rows.withColumn("_tie", place).repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie")
    dealt = written(dealt.withColumn("gid", place), "merkle-order")
    dealt = dealt.withColumn("_part", F.shiftright("gid", 33))
    runs = dealt.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("gid").alias("_first"))
    runs = written(runs, "merkle-runs")
    sizes = runs.groupBy("_g").agg(F.sum("_n").alias("n"), F.min("_first").alias("_least"))
    # groups are numbered by their first row: a running count over partitions, then inside each
    sizes = sizes.withColumn("_p0", F.shiftright("_least", 33))
    inside = F.row_number().over(Window.partitionBy("_p0").orderBy("_least")) - 1
    opened = sizes.groupBy("_p0").agg(F.count(F.lit(1)).alias("_k"))
    opened = opened.select("_p0", (F.sum("_k").over(Window.orderBy("_p0")) - F.col("_k")).alias("_base"))  # a row per partition
    trees = sizes.withColumn("_i", inside).join(opened, "_p0").select(F.col("_g").alias("_t"), "n", (F.col("_base") + F.col("_i")).alias("tree"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_before", before).join(trees, F.col("_g").eqNullSafe(F.col("_t")))
    return (dealt.join(runs, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
            .withColumn("pos", F.col("_before") + F.col("gid") - F.col("_first"))
            .select(*rows.columns, "gid", "tree", "pos", "n"))


NODE = "struct<top: binary, paths: array<struct<path: array<struct<l: binary, r: binary>>>>>"


def _block(digests: list[bytes], n: int, levels: int) -> dict:
    """The levels above one block of a tree level of ``n`` nodes: the block's last digest and, per node, its runs' other members."""
    built = [digests]
    while len(built) <= levels and n > FAN ** (len(built) - 1):
        low = built[-1]
        built.append([hashlib.sha256(b"".join(low[i : i + FAN]).hex().encode()).digest() for i in range(0, len(low), FAN)])
    paths = []
    for j in range(len(digests)):
        path = []
        for level in built[:-1]:
            start = j // FAN * FAN
            path.append({"l": b"".join(level[start:j]), "r": b"".join(level[j + 1 : start + FAN])})
            j //= FAN
        paths.append({"path": path})
    return {"top": built[-1][0], "paths": paths}


def _round(nodes: DataFrame, level: int, levels: int, up: list[Column], extra: list[str]) -> DataFrame:
    """Node rows of one round; ``up``: what the nodes of a finished tree link to; ``extra``: columns of the nodes to keep.

    ``first`` is the gid of the block's first node, if the nodes have one.
    """
    span = FAN**levels
    kind = pa.struct([("top", pa.binary()), ("paths", pa.list_(pa.struct([("path", pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())])))])))])

    def built(digests: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([_block(d, m, levels) for d, m in zip(digests.to_pylist(), n.to_pylist())], kind)

    block = F.floor(F.col("pos") / span).cast("long")
    work = nodes.groupBy("tree", block.alias("block")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest", *extra))).alias("members"))  # at most ``span``
    work = work.withColumn("b", F.arrow_udf(built, NODE)(F.col("members.digest"), F.col("n")))
    done = F.col("n") <= span
    goal = [F.when(done, u).otherwise(v) for u, v in zip(up, [F.col("tree"), F.lit(level + 1), F.col("block")])]
    first = F.col("members")[0]["gid"] if "gid" in extra else F.lit(None).cast("long")
    return work.select("tree", "block", "n", F.col("b.top").alias("top"), first.alias("first"),
                       F.explode(F.arrays_zip("members", F.col("b.paths").alias("paths"))).alias("m")).select(
        "tree", F.lit(level).alias("level"), "m.members.pos", "m.members.digest", "m.paths.path", *[f"m.members.{e}" for e in extra], "first",
        goal[0].cast("long").alias("p_tree"), goal[1].cast("int").alias("p_level"), goal[2].cast("long").alias("p_pos"), "block", "n", "top", done.alias("ends"))


PATH = "array<struct<l: binary, r: binary>>"


def build(leaves: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The stored rows of the leaves and those of the nodes above, from leaves (gid, key, tree, pos, n, digest, found)."""
    spark, span, extra = leaves.sparkSession, FAN**levels, ["gid", "key", "found"]
    upper: list[DataFrame] = []

    def grow(nodes: DataFrame, up: list[Column], level: int) -> DataFrame:
        """Rounds until every tree is one node; returns the roots (tree, digest)."""
        roots = [nodes.where("n = 1").select("tree", "digest")]
        nodes = nodes.where("n > 1")
        while (most := nodes.agg(F.max("n")).first()[0]) is not None:
            rows = written(_round(nodes, level, levels, up, [c for c in extra if c in nodes.columns]), "merkle-nodes")
            upper.append(rows)
            tops = rows.where(F.col("pos") % span == 0)
            roots.append(tops.where("ends").select("tree", F.col("top").alias("digest")))
            nodes = tops.where("NOT ends").select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / span).cast("long").alias("n"), F.col("top").alias("digest"))
            level += 1
            if most <= span:
                break
        return reduce(DataFrame.union, roots)

    many = (leaves.agg(F.max("tree")).first()[0] or 0) > 0
    above = [F.lit(TOP_TREE), F.lit(0), F.col("tree")] if many else [F.lit(None)] * 3
    roots = grow(leaves, above, 0)
    lone = leaves.where("n = 1").select(
        *extra, "digest", F.col("gid").alias("first"), F.array().cast(PATH).alias("path"), above[0].cast("long").alias("p_tree"), above[1].cast("int").alias("p_level"),
        above[2].cast("long").alias("p_pos"), "tree", F.lit(False).alias("ends"), F.lit(None).cast("binary").alias("top"))
    base = upper.pop(0) if upper else None
    base = lone if base is None else base.select(lone.columns).union(lone)
    if many:
        roots = written(roots, "merkle-roots")
        grow(roots.select(F.lit(TOP_TREE).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(roots.count()).cast("long").alias("n"), "digest"), [F.lit(None)] * 3, 0)
    columns = ["tree", "level", "pos", "path", "p_tree", "p_level", "p_pos", "ends", "top"]
    if not upper:
        return base, spark.createDataFrame([], f"tree long, level int, pos long, path {PATH}, p_tree long, p_level int, p_pos long, ends boolean, top binary")
    return base, reduce(DataFrame.union, [u.select(columns) for u in upper])


_FOLD = "aggregate({0}.path, {1}, (h, x) -> unhex(sha2(CAST(concat(lower(hex(x.l)), lower(hex(h)), lower(hex(x.r))) AS BINARY), 256)))"
_CLIMB = f"""
WITH RECURSIVE climb (gid, lead, step, tree, level, pos, salt, folded, siblings, subroot, root) AS (
  SELECT gid, gid = first, 0, p_tree, p_level, p_pos, CAST(pmod(gid, p_salts) AS INT), {_FOLD.format("b", "coalesce(b.found, b.digest)")},
    X'', CASE WHEN gid = first AND ends THEN top END, CAST(NULL AS BINARY) FROM {{base}} b
  UNION ALL
  SELECT c.gid, c.lead, c.step + 1, n.p_tree, n.p_level, n.p_pos, CAST(pmod(c.gid, n.p_salts) AS INT), {_FOLD.format("n", "c.folded")},
    CASE WHEN c.lead THEN aggregate(n.path, X'', (s, x) -> concat(s, x.l, x.r)) END,
    CASE WHEN c.lead AND n.ends AND n.tree <> {TOP_TREE} THEN n.top END, CASE WHEN c.lead AND n.ends AND n.tree = {TOP_TREE} THEN n.top END
  FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.level = n.level AND c.pos = n.pos AND c.salt = n.salt
)
SELECT gid, lead, step, tree IS NULL AS ended, folded, siblings, subroot, root FROM climb WHERE lead OR tree IS NULL
"""


def climb(base: DataFrame, nodes: DataFrame) -> DataFrame:
    """``base`` with folded_root, the siblings above the first block, subroot and root."""
    spark = base.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the query has as many rows as leaves and steps
    salts = salts_of(F.col("p_tree"), F.col("p_level"))
    salted = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), salts_of(F.col("tree"), F.col("level")) - 1)))
    start = base.select("gid", "first", "found", "digest", "path", "p_tree", "p_level", "p_pos", "ends", "top", salts.alias("p_salts"))
    rows = written(spark.sql(_CLIMB, base=start, nodes=salted.withColumn("p_salts", salts)), "merkle-climb")
    leads = rows.where("lead").groupBy(F.col("gid").alias("first")).agg(
        F.array_sort(F.collect_list(F.struct("step", "siblings"))).alias("s"), F.max("subroot").alias("subroot"), F.max("root").alias("root"))
    leads = leads.withColumn("above", F.aggregate("s", F.lit(b""), lambda all_, x: F.concat(all_, x["siblings"]))).drop("s")
    return base.join(rows.where("ended").select("gid", F.col("folded").alias("folded_root")), "gid").join(leads, "first")


def verified(docs: DataFrame, altered: Column, group: str = "source", key: str = "doc_id", fields: list[str] = FIELDS, levels: int = LEVELS) -> DataFrame:
    """Manifest and check of ``docs``: ``key``, leaf, subroot, root, siblings, folded_root (all digests binary).

    ``altered`` is the value of the last field as it is found at the check.
    """
    now = F.concat(leaf_text([F.col(f) for f in fields[:-1]]), leaf_text([altered]))
    found = F.when(~altered.eqNullSafe(F.col(fields[-1])), sha(now))
    leaves = docs.select(F.col(key).alias("key"), F.col(group).alias("grp"), sha(leaf_text([F.col(f) for f in fields])).alias("digest"), found.alias("found"))
    leaves = written(numbered(leaves, "grp", ["key", "digest"]), "merkle-leaves")
    base, nodes = build(leaves, levels)
    own = F.aggregate("path", F.lit(b""), lambda all_, x: F.concat(all_, x["l"], x["r"]))
    subroot = F.coalesce("subroot", "digest")
    return climb(base, nodes).select(F.col("key").alias(key), F.col("digest").alias("leaf"), subroot.alias("subroot"), F.coalesce(F.col("root"), subroot).alias("root"),
                       F.concat(own, "above").alias("siblings"), "folded_root")


_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, doc_id, source, lang, n_chars, text,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: list_concat([ascii(c)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END) AS crc FROM documents),
p AS (SELECT *, coalesce(octet_length(doc_id::VARCHAR::BLOB) || ':' || doc_id, '-') || coalesce(octet_length(source::BLOB) || ':' || source, '-')
    || coalesce(octet_length(lang::BLOB) || ':' || lang, '-') || coalesce(octet_length(n_chars::VARCHAR::BLOB) || ':' || n_chars, '-') AS head,
    CASE WHEN (crc & 1) = 1 THEN replace(text, chr(10), '') ELSE text END AS found FROM d),
l AS (SELECT id, doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(found)) || ':' || found, '-')) AS tampered FROM p),
o AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM o
  UNION ALL
  SELECT tree, max(level) + 1, pos // 3, max((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, pos // 3),
s AS (SELECT tree AS pos, digest FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, pos, (SELECT count(*) FROM s) AS n, digest FROM s
  UNION ALL
  SELECT max(level) + 1, pos // 3, max((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY pos // 3),
climb AS (
  SELECT id, tree, pos, 0 AS level, n, tampered AS folded, '' AS proof, false AS top FROM o
  UNION ALL
  SELECT id, tree, CASE WHEN n = 1 THEN tree ELSE pos // 3 END, CASE WHEN n = 1 THEN 0 ELSE level + 1 END,
    CASE WHEN n = 1 THEN (SELECT count(*) FROM s) ELSE (n + 2) // 3 END,
    CASE WHEN n = 1 THEN folded ELSE sha256(lefts || folded || rights) END, CASE WHEN n = 1 THEN proof ELSE proof || lefts || rights END, top OR n = 1
  FROM (SELECT c.*,
      coalesce(CASE WHEN top THEN u2.digest ELSE t2.digest END, '') || coalesce(CASE WHEN top THEN u1.digest ELSE t1.digest END, '') AS lefts,
      coalesce(CASE WHEN top THEN u3.digest ELSE t3.digest END, '') || coalesce(CASE WHEN top THEN u4.digest ELSE t4.digest END, '') AS rights
    FROM climb c
    LEFT JOIN t t1 ON t1.tree = c.tree AND t1.level = c.level AND t1.pos = c.pos - 1 AND c.pos % 3 >= 1
    LEFT JOIN t t2 ON t2.tree = c.tree AND t2.level = c.level AND t2.pos = c.pos - 2 AND c.pos % 3 = 2
    LEFT JOIN t t3 ON t3.tree = c.tree AND t3.level = c.level AND t3.pos = c.pos + 1 AND c.pos % 3 <= 1
    LEFT JOIN t t4 ON t4.tree = c.tree AND t4.level = c.level AND t4.pos = c.pos + 2 AND c.pos % 3 = 0
    LEFT JOIN u u1 ON u1.level = c.level AND u1.pos = c.pos - 1 AND c.pos % 3 >= 1
    LEFT JOIN u u2 ON u2.level = c.level AND u2.pos = c.pos - 2 AND c.pos % 3 = 2
    LEFT JOIN u u3 ON u3.level = c.level AND u3.pos = c.pos + 1 AND c.pos % 3 <= 1
    LEFT JOIN u u4 ON u4.level = c.level AND u4.pos = c.pos + 2 AND c.pos % 3 = 0
    WHERE NOT (c.top AND c.n = 1)) x)
SELECT o.doc_id, o.leaf, s.digest AS subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(c.proof) AS proof_sha256,
  c.folded AS folded_root, c.folded = (SELECT digest FROM u WHERE n = 1) AS verified
FROM o JOIN s ON s.pos = o.tree JOIN climb c ON c.id = o.id AND c.top AND c.n = 1
"""


@query("op11_merkle_climb", _SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    tampered = F.when(odd == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = verified(table(spark, sf_dir, "documents"), tampered)
    return found.select("doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
                        F.sha2(hexed(F.col("siblings")).cast("binary"), 256).alias("proof_sha256"), hexed(F.col("folded_root")).alias("folded_root"),
                        (F.col("folded_root") == F.col("root")).alias("verified"))
