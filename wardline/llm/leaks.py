"""Benchmark decontamination by item-sized windows and exact counts of shared word shingles.

A window is as many words long as the item (less where the text begins or ends) and matches if the weighted
Jaccard similarity of their word shingles is ``SIMILARITY`` or more.  For that, ``SHARE`` of the shingles of both
have to be shared, so the places of a text whose shingle an item has are counted: windows with fewer such places
cannot match, and all others are compared exactly.  Moving a window to its first such place (or, at a text's begin,
its end to its last) loses no shared shingle, so windows at these places, and those where a shared shingle puts the
item, hold the best similarity; which windows match is not estimated.  Of overlapping windows that match one item the best is
reported.

Items are read in blocks of ``ITEMS`` against all documents, so what a task holds is bounded.  Items and texts without words match
nothing; items shorter than a shingle use one shingle of all their words.  Repeated items are reported each;
repeated documents are each examined.  Null ids pass through.  Other columns of ``docs`` stay.
"""

from __future__ import annotations

from bisect import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.arrays import lowered, shingles, words
from wardline.llm.registry import query
from wardline.llm.tables import scalar, table

WORDS, SIMILARITY, ITEMS = 5, 0.8, 50_000
SHARE = SIMILARITY / (1 + SIMILARITY)  # of both shingle counts together: shared / (a + b - shared) >= SIMILARITY
MATCH = "array<struct<item_id: long, first_word: int, n_words: int, similarity: double>>"


def bag(word: np.ndarray) -> dict[int, int]:
    _, s = shingles(np.zeros(len(word), dtype=np.int64), word, WORDS)
    keys, n = np.unique(s, return_counts=True)
    return dict(zip(keys.tolist(), n.tolist()))


def weighted_jaccard(a: dict[int, int], b: dict[int, int]) -> float:
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def apart(found: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """The best (-similarity, begin, end), and of the others in that order those that overlap none before."""
    begins: list[int] = []
    ends: list[int] = []
    out = []
    for x in sorted(found):
        k = bisect(begins, x[1])
        if (k == 0 or ends[k - 1] <= x[1]) and (k == len(begins) or x[2] <= begins[k]):
            begins.insert(k, x[1])
            ends.insert(k, x[2])
            out.append(x)
    return out


class Index:
    """Items by shingle."""

    def __init__(self, ids: list[int | None], texts: list[str | None]) -> None:
        row, word = words(*lowered(pa.array(texts, pa.string())))
        cut = np.searchsorted(row, np.arange(len(ids) + 1))
        use = np.flatnonzero(np.diff(cut) > 0)
        self.ids = [ids[i] for i in use]
        self.length = np.diff(cut)[use]
        self.bags = [bag(word[cut[i] : cut[i + 1]]) for i in use]
        # every shingle with its item and place
        self.widths = np.unique(np.minimum(self.length, WORDS))
        at, key = shingles(row, word, WORDS)
        item = np.searchsorted(use, at)
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
        place = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], item[order], place[order]
        self.filter = np.zeros(1 << 16, dtype=bool)
        self.filter[(self.key & np.uint64(0xFFFF)).astype(np.int64)] = True

    def matches(self, text: pa.Array) -> pa.Array:
        row, word = words(*lowered(text))
        start = np.searchsorted(row, np.arange(len(text) + 1))
        out: list[list[dict]] = [[] for _ in range(len(text))]
        for width in self.widths.tolist():
            if len(row) < width:
                continue
            best: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
            for item, b, e in self._windows(row, word, start, width).tolist():
                likeness = weighted_jaccard(bag(word[b:e]), self.bags[item])
                if likeness >= SIMILARITY:
                    best.setdefault((int(row[b]), item), []).append((-likeness, b, e))
            for (r, item), found in best.items():
                for worse, b, e in apart(found):
                    out[r].append({"item_id": self.ids[item], "first_word": b - int(start[r]), "n_words": e - b, "similarity": -worse})
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("similarity", pa.float64())]))
        return pa.array(out, kind)

    def _windows(self, row: np.ndarray, word: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
        """(item, begin, end) of windows with enough places whose shingle of ``width`` words the item has."""
        key = self._runs(row, word, width)
        hit = np.flatnonzero((row[: len(key)] == row[width - 1 :]) & self.filter[(key & np.uint64(0xFFFF)).astype(np.int64)])
        lo, hi = np.searchsorted(self.key, key[hit], "left"), np.searchsorted(self.key, key[hit], "right")
        many = hi - lo
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        place = np.repeat(hit, many)
        same = np.minimum(self.length[self.item[at]], WORDS) == width
        at, place = at[same], place[same]
        # each (item, place) once, by item and place
        n = len(word) + 1
        hits = np.unique(self.item[at] * n + place)
        item, p = hits // n, hits % n
        length = self.length[item]
        begin, end = start[row[p]], start[row[p] + 1]
        aligned = place - self.place[at]
        whose, r = self.item[at], row[place]
        early = np.flatnonzero(p + width - begin < length)
        laid = np.concatenate([
            np.stack([item, p, np.minimum(p + length, end)], axis=1),
            np.stack([item[early], begin[early], p[early] + width], axis=1),
            np.stack([whose, np.maximum(aligned, start[r]), np.minimum(aligned + self.length[whose], start[r + 1])], axis=1)])
        item, b, e = laid.T
        shared = np.searchsorted(hits, item * n + np.maximum(e - width + 1, b)) - np.searchsorted(hits, item * n + b)
        both = (self.length[item] - width + 1) + np.maximum(e - b - width + 1, 1)
        return np.unique(laid[shared >= SHARE * both - 1e-6], axis=0)

    @staticmethod
    def _runs(row: np.ndarray, word: np.ndarray, width: int) -> np.ndarray:
        """The shingle hash of every run of ``width`` words, whatever rows it spans."""
        return shingles(np.zeros(len(word), dtype=np.int64), word, width)[1]


def matched(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """``docs`` with ``matches``: the item windows found in each text."""
    spark = docs.sparkSession
    n = benchmark.count()
    parts = max(1, -(-n // items))
    out = docs.withColumn("matches", F.array().cast(MATCH))
    for p in range(parts):
        block = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).toArrow()
        index = spark.sparkContext.broadcast(Index(block.column("item_id").to_pylist(), block.column("text").to_pylist()))
        find = scalar(lambda text, index=index: index.value.matches(text), MATCH)
        out = out.withColumn("matches", F.concat("matches", find(F.col("text"))))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    rows = docs.select("text", F.struct("*").alias("row"))
    return matched(rows, benchmark).where(F.size("matches") == 0).select("row.*")


@query("op7_simhash_windows")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending), similarity (the best; null if none)."""
    m = matched(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct("matches.item_id"))
    return m.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.array_max("matches.similarity").alias("similarity"))
