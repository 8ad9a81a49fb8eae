"""Near-duplicates by BagMinHash signatures of weighted shingles, bands and exact multiset overlap.

Every distinct shingle carries Poisson processes on a weight axis cut at 0, 1, 2, 4, 8 ...
Points of a cut piece arrive in time with the piece's length as rate, each at a place on
the weight axis and for one register.  A text whose count of the shingle is ``w`` sees the
points placed below ``w``; pieces wholly above it are never started, pieces that it covers in
part are thinned by place, which is the split of a parent process into its halves.  A
register keeps its earliest point, so two texts agree in a register with probability equal
to the weighted Jaccard similarity of their shingle counts.  Points later than a horizon
cannot matter once all registers are filled; rows with an open register double it.

Texts are compared by their words in lower case (runs of letters and digits).  Texts with equal words form one
node.  In each band bucket pivots are compared with all members of other components, until no bucket holds an uncompared pair of
different components; links that would join a component to itself are not needed for the classes.  The first round has one
pivot a bucket, the member that shares most buckets, the second ``WIDTHS[1]``, all later ones up to ``WIDTHS[2]``: by then few buckets have more
members outside their largest component, and one round ends them.  Members and pivots move once a bucket, pairs are never rows: a task
holds the pivots' bags, streams the members past them and emits the links that join what it has not joined yet.

Rows without words or with a null doc_id are alone in a class of their own.  Repeated rows
share a class.  An empty table gives an empty result.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.arrays import blocks, lowered, mix, powers, shingles, words
from wardline.llm.components import components
from wardline.llm.registry import query
from wardline.llm.tables import forget, scalar, table, written

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 25, 5
BROADCAST_PAIRS = 100_000
PART = 256  # members that meet one copy of the pivots' texts
WIDTHS = (1, 8, 1024)  # pivots a bucket in the first, second and later rounds
WIDE_PART = 2048
SALT = np.uint64(0xD1B54A32D192ED03)
SHINGLE_BITS = np.uint64(48)


def bags(text: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of the shingle counts of a block, and the words per row."""
    row, word = words(*lowered(text))
    many = np.bincount(row, minlength=len(text))
    row, shingle = shingles(row, word, k)
    packed = np.sort((row.astype(np.uint64) << SHINGLE_BITS) | (shingle >> np.uint64(16)))
    first = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else np.zeros(0, dtype=np.int64)
    weight = np.diff(np.r_[first, len(packed)])
    return (packed[first] >> SHINGLE_BITS).astype(np.int64), packed[first] & ((np.uint64(1) << SHINGLE_BITS) - np.uint64(1)), weight, many


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """The registers of ``n`` rows: the time of each register's earliest point (inf without shingles)."""
    registers = np.full(n * m, np.inf)
    if len(row) == 0:
        return registers.reshape(n, m)
    # pieces [0,1), [1,2), [2,4), [4,8) ... below each weight
    depth = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    element = np.repeat(np.arange(len(row)), depth)
    piece = np.arange(len(element)) - np.repeat(np.cumsum(depth) - depth, depth)
    rate = np.where(piece == 0, 1.0, 2.0 ** np.maximum(piece - 1, 0))
    low = np.where(piece == 0, 0.0, rate)
    owner, limit = row[element], weight[element].astype(float)
    seed = mix(shingle[element] * np.uint64(0xFF51AFD7ED558CCD) + piece.astype(np.uint64) * SALT)
    horizon = (np.log(m) + 2) * m / np.maximum(np.bincount(row, weight, minlength=n), 1)
    open_rows = np.bincount(row, minlength=n) > 0
    while open_rows.any():
        live = np.flatnonzero(open_rows[owner])
        state, time = seed[live], np.zeros(len(live))
        while len(live):
            state = mix(state + SALT)
            time = time - np.log1p(-((state >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate[live]
            stay = time <= horizon[owner[live]]
            live, state, time = live[stay], state[stay], time[stay]
            draw = mix(state ^ SALT)
            register = ((draw >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            place = low[live] + (draw & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate[live]
            seen = place < limit[live]
            np.minimum.at(registers, owner[live][seen] * m + register[seen].astype(np.int64), time[seen])
        open_rows = open_rows & np.isinf(registers.reshape(n, m)).any(axis=1)
        horizon = horizon * 2
    return registers.reshape(n, m)


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = registers.view(np.uint64).reshape(len(registers), bands, rows)
    total = np.zeros(bits.shape[:2], dtype=np.uint64)
    for j in range(rows):
        total += mix(bits[:, :, j] + powers(SALT, ROWS + 2)[j % (ROWS + 1) + 1])
    return mix(total + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _sketch(text: pa.Array) -> pa.Array:
    """node (16 bytes naming the sequence of words; null for a row without words), shingles counted with repeats, keys."""
    row, word = words(*lowered(text))
    n = len(text)
    many = np.bincount(row, minlength=n)
    first = np.cumsum(many) - many
    place = np.arange(len(row)) - first[row] if len(row) else row
    name = np.zeros((n, 2), dtype=np.uint64)
    for c in range(2):
        if len(row):
            np.add.at(name[:, c], row, mix(word ^ (SALT if c else np.uint64(0))) * powers(np.uint64(0x9E3779B97F4A7C15), int(place.max()) + 2)[place + 1])
        name[:, c] = mix(name[:, c] + many.astype(np.uint64))
    r, s, w, _ = bags(text)
    registers = signatures(r, s, w, n, BANDS * ROWS)
    keys = band_keys(registers)
    none = many == 0
    node = pa.array([None if x else b for x, b in zip(none, np.ascontiguousarray(name).view("V16").ravel().tolist())], pa.binary())
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * BANDS)
    size = pa.array(np.maximum(many - WORDS + 1, 1).astype(np.int32))
    return pa.StructArray.from_arrays([node, size, pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))], ["node", "size", "keys"])


def _bag_bytes(text: pa.Array) -> pa.Array:
    row, shingle, weight, _ = bags(text)
    cut = np.searchsorted(row, np.arange(len(text) + 1))
    pairs = np.stack([shingle.view(np.int64), weight.astype(np.int64)], axis=1)
    return pa.array([pairs[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two bags."""
    x, y = (np.frombuffer(v, dtype=np.int64).reshape(-1, 2) for v in (a, b))
    _, i, j = np.intersect1d(x[:, 0], y[:, 0], assume_unique=True, return_indices=True)
    both = np.minimum(x[i, 1], y[j, 1]).sum()
    return float(both / max(x[:, 1].sum() + y[:, 1].sum() - both, 1))


class Pivots:
    """The bags of some texts, joined into one list sorted by shingle."""

    def __init__(self, names: list[bytes], roots: list[bytes | None], held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.names, self.roots = names, roots
        shingle = np.concatenate([s for s, _ in held])
        order = np.argsort(shingle, kind="stable")
        self.shingle, self.weight = shingle[order], np.concatenate([w for _, w in held])[order]
        self.owner = np.repeat(np.arange(len(held)), [len(s) for s, _ in held])[order]
        self.total = np.array([w.sum() for _, w in held])
        self.joined: dict[bytes, bytes] = {}

    def near(self, shingle: np.ndarray, weight: np.ndarray) -> list[int]:
        """The texts whose weighted Jaccard similarity with the bag is high enough."""
        low = np.searchsorted(self.shingle, shingle, "left")
        many = np.searchsorted(self.shingle, shingle, "right") - low
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        both = np.bincount(self.owner[at], np.minimum(self.weight[at], np.repeat(weight, many)), minlength=len(self.total))
        return np.flatnonzero(both / np.maximum(self.total + weight.sum() - both, 1) >= SIMILARITY).tolist()

    def find(self, x: bytes) -> bytes:
        while (up := self.joined.get(x, x)) != x:
            self.joined[x] = x = self.joined.get(up, up)
        return x

    def joins(self, a: bytes, b: bytes) -> bool:
        """Whether a link of two components joins what this task has not joined yet."""
        a, b = self.find(a), self.find(b)
        if a != b:
            self.joined[max(a, b)] = min(a, b)
        return a != b


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (group, part, member): the group's pivots lead each part, and their bags are all that is held.

    A member asks for the pivots it names, or for all of other components if it names none (null).
    """
    at, names, roots, held, pivots = None, [], [], [], None
    for b in blocks(batches, "text"):
        row, shingle, weight, _ = bags(b.column("text"))
        cut = np.searchsorted(row, np.arange(b.num_rows + 1)).tolist()
        found: tuple[list[bytes], list[bytes]] = ([], [])
        here = zip(*(b.column(c).to_pylist() for c in ("group", "part", "member", "node", "root", "pivots")))
        for (group, part, member, node, root, asked), i, j in zip(here, cut, cut[1:]):
            if at != (group, part):
                at, names, roots, held, pivots = (group, part), [], [], [], None
            if not member:
                names.append(node)
                roots.append(root)
                held.append((shingle[i:j].copy(), weight[i:j].copy()))
                continue
            pivots = pivots or Pivots(names, roots, held)
            for p in pivots.near(shingle[i:j], weight[i:j]):
                if names[p] in asked if asked is not None else pivots.joins(root, roots[p]):
                    found[0].append(names[p])
                    found[1].append(node)
        yield pa.record_batch([pa.array(c, pa.binary()) for c in found], ["a", "b"])


def _compared(state: DataFrame, chosen: DataFrame, texts_of: DataFrame) -> DataFrame:
    """Links (a, b) between the pivots ``chosen`` (key, pivot, pivot_root) of each bucket and its members of other components."""
    parts = state.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / WIDE_PART).cast("int").alias("parts"))
    none = F.lit(None).cast("array<binary>").alias("pivots")
    members = state.join(parts, "key").select(F.col("key").alias("group"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("member"), "node", "root", none)
    leads = chosen.join(parts, "key").select(F.col("key").alias("group"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"),
                                             F.col("pivot").alias("node"), F.col("pivot_root").alias("root"), none)
    rows = texts_of.join(members.union(leads), "node").select("group", "part", "member", "node", "root", "pivots", "text")
    return rows.repartition("group", "part").sortWithinPartitions("group", "part", "member").mapInArrow(_verify, "a binary, b binary")


def _linked(pairs: DataFrame, texts_of: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` (group, pivot, node; few pivots a group) whose bags overlap enough.

    Texts move, as they are far smaller on disk than their bags: each member's once for a group with all the pivots it
    meets there, each pivot's once for ``PART`` members or so, which also splits a group of many members over tasks.
    Few pairs, by count, are broadcast so that only their own texts move.
    """
    few = pairs.count() <= BROADCAST_PAIRS
    members = pairs.groupBy("group", "node").agg(F.collect_list("pivot").alias("pivots"))  # at most the pivots of a bucket
    parts = members.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = members.join(parts, "group").select("group", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("member"), "node", "pivots")
    leads = pairs.select("group", "pivot").distinct().join(parts, "group").select(
        "group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), F.col("pivot").alias("node"), F.array().cast("array<binary>").alias("pivots"))
    todo = written(dealt.union(leads), "comparisons")
    rows = texts_of.join(F.broadcast(todo) if few else todo, "node").select("group", "part", "member", "node", F.lit(None).cast("binary").alias("root"), "pivots", "text")
    return rows.repartition("group", "part").sortWithinPartitions("group", "part", "member").mapInArrow(_verify, "a binary, b binary")


def classes(docs: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """One row (doc_id, text_hash, class_id, first) for each row of ``docs``.

    class_id is the least doc_id of the class; ``first`` marks the rows that may stand for it, which
    are equal in doc_id and text.
    """
    kind = "node binary, size int, keys array<long>"
    rows = written(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), scalar(_sketch, kind)(F.col("text")).alias("s")).select("doc_id", "text_hash", "s.*"), "sketches")
    nodes = rows.where("node IS NOT NULL AND doc_id IS NOT NULL")
    named = nodes.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    spread = named.select("node", "size", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    active = written(spread.join(shared, "key"), "shared-keys")  # a node has a key once at most, but for equal keys of two bands
    members = active.groupBy("node").agg(F.sum("n").alias("degree"))  # the text that others were made from meets the most
    active = written(active.drop("n").join(members, "node"), "buckets")
    # one row's text per node: every copy has the same words, so the least row's will do
    chosen = members.select("node").join(named.select("node", "least.*"), "node")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts_of = written(texts.join(chosen, ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"]), "texts")

    roots = None  # (node, root) of the nodes that have links
    widths = iter(widths)
    width = next(widths)
    while True:
        if roots is None:
            state = active.withColumn("root", F.col("node"))
        else:
            state = active.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        counts = state.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        mixed = counts.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("members"), F.max(F.struct("n", "root"))["root"].alias("main")).where("roots > 1").drop("roots")
        state = written(state.join(mixed, "key").join(counts, ["key", "root"]), "bucket-state")
        if state.isEmpty():
            break
        # pivots: members of the smallest components, of the highest degree first, at most ``width`` a bucket; the
        # largest component has none once all others can be pivots
        lead = state if width == 1 else state.where("root != main")
        chosen = (lead.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(width)).alias("class"))
                  .agg(F.min(F.struct("n", (-F.col("degree")).alias("d"), "node", "root", "size")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.root").alias("pivot_root"), F.col("p.size").alias("pivot_size")))
        chosen = written(chosen, "pivots")
        if width == 1:
            # a pair is compared in the group of its pivot; a pair of two pivots comes up from both sides
            pairs = (state.join(chosen, "key").where(f"root != pivot_root AND least(size, pivot_size) >= {SIMILARITY}D * greatest(size, pivot_size) - 1e-6D")
                     .groupBy(F.least("node", "pivot").alias("x"), F.greatest("node", "pivot").alias("y"))
                     .agg(F.min(F.struct(F.xxhash64("pivot").alias("group"), "pivot", "node")).alias("m")).select("m.group", "m.pivot", "m.node"))
            pairs = written(pairs, "pairs")
            new = written(_linked(pairs, texts_of), "new-links")
            forget(pairs)
        else:
            new = written(_compared(state.select("key", "node", "root"), chosen, texts_of), "new-links")
        if not new.isEmpty():
            edges = new if roots is None else new.union(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a != b"))
            old, roots = roots, written(components(edges), "roots")
            forget(old)
        old, active = active, written(state.select("key", "node", "size", "degree").join(chosen.select("key", F.col("pivot").alias("node")), ["key", "node"], "left_anti"), "buckets")
        forget(old, state, chosen, new)
        width = next(widths, width)
    member = named.select("node", "least")
    if roots is not None:
        member = member.join(roots, "node", "left")
    else:
        member = member.withColumn("root", F.lit(None).cast("binary"))
    member = member.withColumn("root", F.coalesce("root", "node"))
    class_of = member.groupBy("root").agg(F.min("least").alias("best"))
    by_node = member.join(class_of, "root").select("node", "best")
    out = rows.select("doc_id", "text_hash", "node").join(by_node, "node", "left")
    alone = F.col("best").isNull() | F.col("doc_id").isNull()
    return out.select(
        "doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        (alone | ((F.col("doc_id") == F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash")))).alias("first"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class; rows with a null doc_id or without words all stay."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("row")).withColumn("text_hash", F.xxhash64("text"))
    found = classes(docs)
    losers = found.where("NOT first").select("doc_id", "text_hash").distinct()
    rows = rows.join(losers, ["doc_id", "text_hash"], "left_anti")
    exempt = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[0-9A-Za-z\x80-\x{10FFFF}]"), F.lit(False))
    rows = rows.withColumn("own", F.when(exempt, F.monotonically_increasing_id()))
    return rows.dropDuplicates(["doc_id", "text_hash", "own"]).select("row.*")


@query("op5_bagminhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, kept: one document of each class stays."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.col("first").alias("kept"))
