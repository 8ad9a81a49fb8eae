"""Embedding near-duplicates by a pivot-permutation index.

Reference points are vectors of a bounded sample (those with the least content hash) that are ``APART``, so that a cluster
holds one of them however large it is; random directions fill up their number.  It is ``PIVOTS`` up to ``BASE_ROWS`` rows and grows with the
cube root of the rows, as does the number of lists with the rows, up to ``MOST_PIVOTS``.  Every row is indexed.  A vector is described by its ``NEAREST`` nearest reference points.  Inverted
lists are kept per set of ``SHARED`` reference points, so two vectors meet in a list exactly if they
share at least that many; lists of one member are dropped before any vector is moved.  A pair that
meets in several lists is judged in one: the list of its lowest shared points.  Inside a list all
members are compared by cosine in double precision, lists longer than ``BLOCK`` in blocks, each
pair of blocks its own group, and only counts per vector and spanning links leave the task.

Recall is that of sharing ``SHARED`` of ``NEAREST`` points: 0.94 to 1 of all linked pairs in clusters at cosines near the
threshold, more for closer ones (tests measure it against brute force).

Equal vectors are one node with a multiplicity.  Null and zero vectors and those with null or non-finite
components link with nothing.  Vectors of different lengths never meet.  Rows with a
null vec_id are compared and get a null id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.components import components
from wardline.llm.registry import query
from wardline.llm.tables import table, written

PIVOTS, NEAREST, SHARED, BLOCK = 256, 7, 3, 1024
APART, BASE_ROWS, MOST_PIVOTS, SAMPLE = 0.8, 100_000, 2048, 4  # SAMPLE: rows looked at per reference point
COSINE = 0.9
_SUBSETS = np.array(list(combinations(range(NEAREST), SHARED)))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True, initial=0)  # no overflow of squares
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def reference_points(sample: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` rows of a sample of unit vectors whose cosines are all below ``APART``, and random directions up to ``n``."""
    kept = np.zeros((n, sample.shape[1]))
    have = 0
    for v in sample:
        if have == n:
            break
        if not have or (kept[:have] @ v).max() < APART:
            kept[have] = v
            have += 1
    more = np.random.default_rng(8).normal(size=(n - have, sample.shape[1]))
    kept[have:] = more / np.linalg.norm(more, axis=1, keepdims=True)
    return kept


def nearest(x: np.ndarray, reference: np.ndarray, k: int = NEAREST) -> np.ndarray:
    """The ``k`` nearest reference points of each row as ascending numbers (-1: fewer exist)."""
    out = np.full((len(x), k), -1, dtype=np.int64)
    have = min(k, len(reference))
    if have:
        out[:, k - have :] = np.sort(np.argsort(-(x @ reference.T), axis=1, kind="stable")[:, :have], axis=1)
    return out


def list_keys(points: np.ndarray) -> np.ndarray:
    """The keys of all lists of each row."""
    key = np.zeros((len(points), len(_SUBSETS)), dtype=np.int64)
    for j in range(SHARED):
        key = key * (MOST_PIVOTS + 1) + points[:, _SUBSETS[:, j]] + 1
    return key


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of the lowest ``SHARED`` points that rows of ``a`` and ``b`` share."""
    both = (a[:, :, None] == b[:, None, :]).any(axis=2)
    rank = np.cumsum(both, axis=1)
    key = np.zeros(len(a), dtype=np.int64)
    for j in range(SHARED):
        at = np.argmax(both & (rank == j + 1), axis=1)
        key = key * (MOST_PIVOTS + 1) + a[np.arange(len(a)), at] + 1
    return key


def _pairs(group: np.ndarray, block: np.ndarray, one: np.ndarray, key: np.ndarray, x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows that this group of lists has to judge; rows come sorted by group."""
    found_a, found_b = [], []
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])

    def judge(a: np.ndarray, b: np.ndarray) -> None:
        use = one[a] | (block[a] != block[b])
        a, b = a[use], b[use]
        near = np.einsum("ij,ij->i", x[a], x[b]) >= COSINE
        a, b = a[near], b[near]
        own = first_shared(points[a], points[b]) == key[a]
        found_a.append(a[own])
        found_b.append(b[own])

    small = np.repeat(size <= 32, size)
    for lag in range(1, 32):
        a = np.flatnonzero(small[:-lag] & (group[:-lag] == group[lag:])) if lag < len(group) else np.zeros(0, dtype=np.int64)
        if len(a) == 0:
            break
        for c in range(0, len(a), 50_000):
            judge(a[c : c + 50_000], a[c : c + 50_000] + lag)
    lowest = list_keys(points)[:, 0]
    for f, s in zip(first[size > 32].tolist(), size[size > 32].tolist()):
        # rows that share all their points are judged in the list of the lowest ones
        same = np.unique(points[f : f + s], axis=0, return_inverse=True)[1].ravel()
        elsewhere = lowest[f : f + s] != key[f]
        for r in range(f, f + s, 256):
            rows = slice(r - f, min(r + 256, f + s) - f)
            near = x[r : min(r + 256, f + s)] @ x[f : f + s].T >= COSINE - 1e-9
            near &= ~((same[rows][:, None] == same[None, :]) & elsewhere[rows][:, None])
            a, b = np.nonzero(near)
            a, b = a + r, b + f
            judge(a[a < b], b[a < b])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (first[:0], first[:0])


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, lo, hi): link counts per node and links that span each list's components."""

    def work(t: pa.Table) -> pa.RecordBatch:
        x = matrix(t.column("embedding"))
        key, lo, hi, block, copies = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "block", "copies"))
        points = np.frombuffer(b"".join(t.column("points").to_pylist()), dtype=np.int16).reshape(-1, NEAREST).astype(np.int64)
        change = np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
        a, b = _pairs(np.cumsum(change), block, lo == hi, key, x, points)
        n = len(key)
        links = np.bincount(a, copies[b], minlength=n) + np.bincount(b, copies[a], minlength=n)
        root = np.arange(n)
        while len(a):
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == before).all():
                break
        at = np.flatnonzero(links > 0)
        node = t.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(at)), pa.array(links[at].astype(np.int64)), node.take(pa.array(root[at]))], ["node", "links", "other"])

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < 20_000:
            continue
        key, lo, hi = (held.column(c).to_numpy() for c in ("key", "lo", "hi"))
        change = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
        if len(change):
            cut = int(change[-1]) + 1
            yield work(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield work(held)


def _describe(reference):
    """UDF: the nearest reference points and the list keys of a vector."""

    def describe(column: pa.Array) -> pa.Array:
        points = nearest(matrix(column), reference.value) if len(column) else np.zeros((0, NEAREST), dtype=np.int64)
        keys = list_keys(points)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
        return pa.StructArray.from_arrays([pa.array([p.tobytes() for p in points.astype(np.int16)], pa.binary()), flat], ["points", "keys"])

    return F.arrow_udf(describe, "points binary, keys array<long>").asNondeterministic()


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id of every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    ok = F.coalesce((F.size(e) > 0) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    node = F.when(ok, F.concat(F.hex(F.xxhash64(e)), F.lit("-"), F.hex(F.xxhash64(F.reverse(e)))))
    rows = vectors.select("vec_id", "embedding", node.alias("node"))
    unique = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    unique = written(unique.withColumn("dim", F.size("embedding")), "vectors")
    edges, counts = [], []
    rows_of = {r["dim"]: r["n"] for r in unique.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where("n > 1").collect()}
    for dim in sorted(rows_of):
        part = unique.where(F.col("dim") == dim)
        many = min(MOST_PIVOTS, int(np.ceil(PIVOTS * max(1.0, rows_of[dim] / BASE_ROWS) ** (1 / 3))))
        sample = part.orderBy(F.xxhash64("node"), "node").limit(SAMPLE * many).select("embedding").toArrow()
        reference = spark.sparkContext.broadcast(reference_points(matrix(sample.column("embedding")), many))

        described = part.withColumn("d", _describe(reference)(F.col("embedding")))
        described = written(described.select("node", "embedding", "copies", "d.points", F.array_distinct("d.keys").alias("keys")), "described")
        posted = described.select("node", F.explode("keys").alias("key"))
        lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        dealt = (posted.join(lists, "key").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
                 .select("key", "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")))
        full = dealt.join(described.select("node", "embedding", "copies", "points"), "node")
        sorted_rows = full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        found = written(sorted_rows.select("key", "lo", "hi", "block", "node", "embedding", "copies", "points").mapInArrow(_compare, "node string, links long, other string"), "links")
        counts.append(found.groupBy("node").agg(F.sum("links").alias("links")))
        edges.append(found.select(F.col("node").alias("a"), F.col("other").alias("b")).where("a != b"))
    out = unique.select("node", "least", "copies")
    if counts:
        for more in counts[1:]:
            counts[0] = counts[0].union(more)
        for more in edges[1:]:
            edges[0] = edges[0].union(more)
        out = out.join(counts[0], "node", "left").join(components(edges[0]), "node", "left")
    else:
        out = out.withColumn("links", F.lit(0).cast("long")).withColumn("root", F.col("node"))
    out = written(out.select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "vector-links")
    low = out.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = out.join(low, "root").select("node", "n_links", "component_id")
    return rows.select("vec_id", "node").join(by_node, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


@query("op8_pivot_permutation")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
