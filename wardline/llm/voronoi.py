"""Exact top-k search by inner product: a Voronoi join of queries and data.

Vectors are integers, floor(``SCALE`` * component).  One reference vector per ``CELL`` rows, ``PIVOTS`` at most (those with the
least content hash), divide queries and data into cells by nearest pivot.  Of every data cell
a summary is kept: its row count, the greatest distance to its pivot and the ``k + 1`` least ones; of every query cell the
greatest distance.  With q = p + u and x = c + v for pivots p and c, q.x lies within |p||v| + |u||c| + |u||v| of p.c, so the
summaries bound every score between two cells.  The (k + 1)-th best of the lower bounds (one may be the query itself; more,
where query ids repeat) is reached by k other rows, and a data cell whose upper bound is below it cannot hold an answer of that
query cell.  The bounds of the single query (u = 0) are tried on the cells that are left.

Only what is necessary is replicated: each query goes to the cells its bounds leave, and a data row of a visited cell moves once, to a piece of
its cell of about ``PIECE_BYTES`` (a hot cell has many pieces; repeated rows are dealt among them).  A task reads the data of a piece, then streams the
queries that came to it; the pieces' top k are merged per query.  Nothing is sampled: pivots only decide where rows go.
Vectors without structure, whose distances are all alike, leave nothing to exclude: then every query meets every row.

Vectors that are null or hold null or non-finite components take no part.  Shorter vectors count as padded by zeros.  A row with a
query's own vec_id is not its candidate; repeated query rows are answered each; rows with null ids are candidates
after all others of the same score and never queries.  Scores are exact: sums beyond 2**53 are added as integers
of any size, and one that does not fit 64 bits is an error.  Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.registry import query
from wardline.llm.tables import table, written

SCALE, PIVOTS, CELL, PIECE_BYTES = 1024, 1024, 1000, 16 << 20
MOST_REPEATS = 64  # query ids that repeat more often exclude no cells
NO_ID = np.iinfo(np.int64).max
ANSWER = "uid long, query_id long, vec_id long, score long"
SLACK = 1e-9  # relative; bounds are computed in double precision


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows as whole numbers in double precision, padded by zeros to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), width))
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.arange(width) < size[:, None]] = np.floor(SCALE * flat)
    return out


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row and the distance to it."""
    cell = np.empty(len(x), dtype=np.int64)
    half = (pivots**2).sum(axis=1) / 2
    for a in range(0, len(x), 4096):
        cell[a : a + 4096] = np.argmin(half - x[a : a + 4096] @ pivots.T, axis=1)
    return cell, np.linalg.norm(x - pivots[cell], axis=1)


class Cells:
    """Pivots and what the summaries say about scores between cells."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray, least: np.ndarray, pieces: np.ndarray, reach: np.ndarray) -> None:
        """``radius``, ``pieces``: of each data cell (radius -1: empty); ``least``: its least distances, as many as a bound
        needs (inf: fewer rows); ``reach``: radius of each query cell (-1: empty)."""
        self.pivots, self.radius, self.pieces, self.reach = pivots, radius, pieces, reach
        self.held, self.least = np.isfinite(least), np.where(np.isfinite(least), least, 0)
        self.norm = np.linalg.norm(pivots, axis=1)
        self.needed = np.zeros((len(pivots), len(pivots)), dtype=bool)
        for c in np.flatnonzero(reach >= 0):
            self.needed[c] = self.left(pivots[c : c + 1], reach[c])[0]

    def left(self, q: np.ndarray, reach: float = 0.0) -> np.ndarray:
        """For each row of ``q``: the data cells that may hold an answer of a query within ``reach`` of it."""
        middle = q @ self.pivots.T
        size = np.linalg.norm(q, axis=1)[:, None]
        far = np.maximum(self.radius, 0)
        slack = SLACK * (size + reach) * (self.norm + far + 1) + SLACK
        upper = middle + size * far + reach * self.norm + reach * far + slack
        kept = self.least.shape[1]
        spread = (size + reach)[:, :, None] * self.least + (reach * self.norm)[:, None]
        lower = np.where(self.held, middle[:, :, None] - spread - slack[:, :, None], -np.inf).reshape(len(q), -1)
        bar = np.partition(lower, -kept, axis=1)[:, -kept]
        return (upper >= bar[:, None]) & (self.radius >= 0)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = np.abs(q).max(initial=0) * np.abs(x).sum(axis=1).max(initial=0)
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    out = (whole(q) @ whole(x).T) if q.size and x.size else np.zeros((len(q), len(x)), dtype=object)
    if len(out) and out.size and max(abs(out.max()), abs(out.min())) >= 2**63:
        raise OverflowError("an inner product does not fit 64 bits")
    return out.astype(np.int64)


def best(s: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best columns; ``ids`` ascend, so of equal scores the first columns win."""
    allowed = own[:, None] != ids[None, :]
    allowed |= (ids == NO_ID)[None, :]
    n = len(ids)
    if np.abs(s).max(initial=0) < 2**61 // max(n, 1):
        key = np.where(allowed, s * n - np.arange(n), -(2**62))
        take = np.argpartition(-key, min(k, n) - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), s.shape)
    else:
        take = np.array([sorted(range(n), key=lambda j, r=r, a=a: (not a[j], -int(r[j]), j))[:k] for r, a in zip(s, allowed)])
    row = np.repeat(np.arange(len(s)), take.shape[1])
    col = take.ravel()
    fits = allowed[row, col]
    return row[fits], col[fits]


def _solve(k: int, width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (cell, piece, uid): data (uid null) first, then the queries that came to the piece."""

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, data, settled = None, np.zeros(0, dtype=np.int64), np.zeros((0, width)), True
        for batch in batches:
            cell, piece = batch.column("cell").to_numpy(), batch.column("piece").to_numpy()
            vec_id, uid = batch.column("vec_id"), batch.column("uid")
            asks = uid.is_valid().to_numpy(zero_copy_only=False)
            x = integers(batch.column("embedding"), width)
            cuts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (piece[1:] != piece[:-1]) | (asks[1:] != asks[:-1])]).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(cell)]):
                if (cell[a], piece[a]) != at:
                    at, ids, data, settled = (cell[a], piece[a]), ids[:0], data[:0], True
                mine = vec_id.slice(a, b - a)
                if not asks[a]:
                    ids = np.r_[ids, mine.fill_null(NO_ID).to_numpy(zero_copy_only=False)]
                    data, settled = np.r_[data, x[a:b]], False
                    continue
                if not settled:
                    order = np.argsort(ids, kind="stable")
                    ids, data, settled = ids[order], data[order], True
                if len(ids) == 0:
                    continue
                own = mine.to_numpy(zero_copy_only=False)
                for c in range(0, b - a, 512):
                    s = scores(x[a + c : min(a + c + 512, b)], data)
                    row, col = best(s, own[c : c + 512], ids, k)
                    yield pa.RecordBatch.from_arrays(
                        [uid.slice(a + c, 512).take(pa.array(row)), mine.slice(c, 512).take(pa.array(row)),
                         pa.array(ids[col], mask=ids[col] == NO_ID), pa.array(s[row, col])], ["uid", "query_id", "vec_id", "score"])

    return solve


def whole(e: Column) -> Column:
    """Whether a vector takes part."""
    return F.coalesce(~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int = PIVOTS, cell: int = CELL, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best other rows of ``vectors`` (vec_id, embedding).

    ``is_query`` must depend on vec_id alone.
    """
    spark = vectors.sparkSession
    embedding = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", embedding.alias("embedding"), (F.col("vec_id").isNotNull() & F.coalesce(is_query, F.lit(False))).alias("asks")).where(whole(embedding))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    sample = rows.orderBy(F.xxhash64("embedding"), "vec_id").limit(min(pivots, -(-n // cell))).select("embedding").toArrow()
    reference = np.unique(integers(sample.column("embedding"), width), axis=0)
    shared = spark.sparkContext.broadcast(reference)

    def locate(column: pa.Array) -> pa.Array:
        at, away = nearest(integers(column, width), shared.value) if len(column) else (np.zeros(0, dtype=np.int64), np.zeros(0))
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(away)], ["cell", "away"])

    located = rows.withColumn("at", F.arrow_udf(locate, "cell int, away double").asNondeterministic()(F.col("embedding")))
    located = written(located.select("vec_id", "embedding", "asks", "at.cell", "at.away"), "voronoi-rows")
    cells = _summaries(located, reference, k, max(piece_bytes // (8 * width), 1))
    place = spark.sparkContext.broadcast(cells)

    def visits(column: pa.Array, home: pa.Array) -> pa.Array:
        found: list[np.ndarray] = []
        q, home = integers(column, width), home.to_numpy(zero_copy_only=False)
        for a in range(0, len(q), 64):
            found += [np.flatnonzero(r) for r in place.value.left(q[a : a + 64]) & place.value.needed[home[a : a + 64]]]
        cut = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
        flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(cut), pa.array(flat.astype(np.int32)))

    # every query row has a number of its own, kept in the shared folder, so that repeated rows stay apart
    visit = F.arrow_udf(visits, "array<int>").asNondeterministic()
    asked = located.where("asks").select("vec_id", "embedding", F.monotonically_increasing_id().alias("uid"), visit("embedding", "cell").alias("cells"))
    asked = written(asked, "voronoi-queries")
    seen = [r[0] for r in asked.select(F.explode("cells")).distinct().collect()]  # at most one per pivot
    pieces = F.expr(f"array({', '.join(map(str, cells.pieces.tolist()))})[cell]")
    spread = asked.select(F.explode("cells").alias("cell"), "vec_id", "uid", "embedding")
    spread = spread.select("cell", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), "vec_id", "uid", "embedding")
    # the place in the written file is part of the hash, so that repeated rows are dealt among the pieces too
    dealt = located.where(F.col("cell").isin(seen)).select(
        "cell", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), pieces).cast("int").alias("piece"), "vec_id", F.lit(None).cast("long").alias("uid"), "embedding")
    met = dealt.unionByName(spread).repartition("cell", "piece").sortWithinPartitions("cell", "piece", F.col("uid").asc_nulls_first())
    answers = met.mapInArrow(_solve(k, width), ANSWER)
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _summaries(located: DataFrame, reference: np.ndarray, k: int, piece: int) -> Cells:
    """One row per pivot comes to the driver: count, radius and the least distances."""
    repeats = located.where("asks").groupBy("vec_id").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 1
    kept, p = k + min(repeats, MOST_REPEATS), len(reference)
    least = Window.partitionBy("cell", "_salt").orderBy("away")
    salted = located.select("cell", "away", F.pmod(F.xxhash64("vec_id", "away"), F.lit(64)).alias("_salt"))
    near = (salted.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= kept)
            .groupBy("cell").agg(F.slice(F.array_sort(F.collect_list("away")), 1, kept).alias("least")))
    sizes = located.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.max(F.when(F.col("asks"), F.col("away"))).alias("reach"))
    radius, reach, pieces, close = np.full(p, -1.0), np.full(p, -1.0), np.ones(p, dtype=np.int64), np.full((p, kept), np.inf)
    for r in sizes.join(near, "cell").collect():
        c = r["cell"]
        radius[c], pieces[c] = r["radius"], -(-r["n"] // piece)
        reach[c] = -1.0 if r["reach"] is None else r["reach"]
        if repeats <= MOST_REPEATS:
            close[c, : len(r["least"])] = r["least"]
    return Cells(reference, radius, close, pieces, reach)


_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""


@query("op12_voronoi_join", _SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of every vector whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
