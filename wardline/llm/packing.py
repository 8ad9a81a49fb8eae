"""Sum-of-squares packing of token sequences into rows of a fixed length.

Documents are tokenised and end with id 0; longer ones are cut into full pieces and a rest.
Placing a piece of size ``s`` into a bin of residual gap ``g`` turns it into one of gap
``g - s``; the choice that makes the sum of squared counts of open bins per gap smallest
wins (ties prefer the smaller gap left); a new bin is opened only if no open one fits.  Pieces of one size are interchangeable, so
the rule runs over the histogram of sizes, at most ``capacity`` numbers, largest size first, and
places as many pieces at once as keep the choice the best (for common sizes at least 1/256 of them).
Its work and its list of placements follow from the capacity and not from the data.  Each piece then finds its sequence by its
rank within its size, which is numbered in stripes, so no size meets in one task.

Null texts are empty: the single id 0.  Repeated rows are packed each.  Empty tables give an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.registry import query
from wardline.llm.tables import scalar, table, written

CAPACITY, STRIPES, CHUNK = 2048, 64, 256
WORDS, PARTS = 1_000_000, 700_000  # kept encodings per worker
#: Fixed value: white space as the tokenizers' pattern ``\s`` has it.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_MARKS = "!#$%&()*+,-./:;<=>?@[\\]^_`{|}~\""
_ODD = re.compile("[\x1c-\x1f]")
_ENCODERS: dict[str, Encoder] = {}


class _Numbered(dict):
    """Numbers for strings in order of their first look-up; ``fresh`` lists those without an entry in the store yet."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class Encoder:
    """A tokenizer with the ids of the words and word parts it has met, kept per worker and bounded in number."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.words, self.parts = _Numbered(), _Numbered()
        self.of_word = np.zeros((0, 2), dtype=np.int32)  # the two parts of each word
        self.parts[""], self.ids = 0, np.zeros(0, dtype="<u4")  # ids of all parts, part after part
        self.first, self.size = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def _learn(self) -> None:
        """Encode what has been numbered since the last call."""
        pairs = [self.parts[p] for w in self.words.fresh for p in _parts(w)]
        self.of_word = np.concatenate([self.of_word, np.array(pairs, dtype=np.int32).reshape(-1, 2)])
        fresh = self.parts.fresh
        self.words.fresh, self.parts.fresh = [], []
        ids, size = [self.ids], np.zeros(len(fresh), dtype=np.int64)
        kind = [_plain(p) for p in fresh]
        plain, other = [i for i, k in enumerate(kind) if k], [i for i, k in enumerate(kind) if not k]
        order = plain + other
        for a in range(0, len(plain), 2000):  # many letter runs in one text, one of its words each
            some = plain[a : a + 2000]
            e = self.tokenizer.encode(" ".join([fresh[i] for i in some]), add_special_tokens=False)
            size[some] = np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(some))
            ids.append(np.array(e.ids, dtype="<u4"))
        for a in range(0, len(other), 2000):
            for i, e in zip(other[a : a + 2000], self.tokenizer.encode_batch_fast([fresh[i] for i in other[a : a + 2000]], add_special_tokens=False)):
                size[i] = len(e.ids)
                ids.append(np.array(e.ids, dtype="<u4"))
        first = np.zeros(len(fresh), dtype=np.int64)
        first[order] = len(self.ids) + np.cumsum(size[order]) - size[order]
        self.ids = np.concatenate(ids)
        self.first, self.size = np.concatenate([self.first, first]), np.concatenate([self.size, size])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        if len(self.words) > WORDS or len(self.parts) > PARTS:
            self.forget()
        number = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
        if self.words.fresh:
            self._learn()
        part = self.of_word[number].ravel()
        size = self.size[part]
        at = np.repeat(self.first[part] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.ids[at], size.reshape(-1, 2).sum(axis=1)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _plain(part: str) -> bool:
    """A run of Latin letters, which the tokenizer takes as one word."""
    return part.isalpha() and (part.isascii() or (max(part) < "\u0370" and "\u0130" not in part))


def _parts(word: str) -> tuple[str, str]:
    """Two parts that the tokenizer encodes one by one: the letters of a Latin word in lower case, and ASCII marks after it."""
    core = word.rstrip(_MARKS)
    return (core.lower(), word[len(core) :]) if _plain(core) else (word, "")


def encoded(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers, without the end id.

    The vocabulary's words never span white space, so a white-space run is encoded once and kept; runs
    that differ in case or in marks at the end share the encoding of their letters.
    """
    split = [WHITE.split(t) if _ODD.search(t) else t.split() for t in texts]
    ids, size = encoder(path).encode(list(chain.from_iterable(split)))
    ends = np.r_[0, np.cumsum(size)][np.cumsum([0, *map(len, split)])] * 4
    raw = ids.tobytes()
    return [raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def cut(text: pa.Array) -> pa.Array:
        out, ends = [[], [], []], [0]
        for raw in encoded([t or "" for t in text.to_pylist()], path):
            raw += b"\0\0\0\0"
            for a in range(0, len(raw), capacity * 4):
                part = raw[a : a + capacity * 4]
                out[0].append(a // 4)
                out[1].append(len(part) // 4)
                out[2].append(zlib.crc32(part))
            ends.append(len(out[0]))
        items = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in out], ["start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)

    kind = "array<struct<start: long, length: long, ids_crc32: long>>"
    found = docs.select("doc_id", F.posexplode(scalar(cut, kind)(F.col("text"))).alias("piece", "p"))
    return found.select("doc_id", "piece", "p.start", "p.length", "p.ids_crc32")


def sum_of_squares(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Placements (size, first rank, count, first sequence, offset) of all pieces.

    A placement puts the pieces of ranks first .. first + count - 1 of a size into consecutive sequences.
    """
    n = np.zeros(capacity + 1, dtype=np.int64)  # open bins per gap
    held: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs (first sequence, count)
    placed, sequences = [], 0
    for size in sorted((s for s, c in counts.items() if c), reverse=True):
        total, rank = counts[size], 0
        while rank < total:
            # change of the sum of squares for every gap; a gap of 0 is a closed bin and counts for nothing
            left = n[: capacity + 1 - size].copy()
            left[0] = 0
            change = 2 * (left - n[size:]).astype(np.float64) + 2
            change[0] = 1 - 2 * n[size]
            change[n[size:] == 0] = np.inf
            if np.isinf(change).all():  # a new bin only if no open one fits
                change[capacity - size] = 0
            g = int(np.argmin(change)) + size
            others = np.delete(change, g - size)
            margin = (others.min() - change[g - size]) / 4 if len(others) else np.inf
            take = min(total - rank, int(max(1, min(margin + 1, total), total // CHUNK)))
            if g == capacity:
                placed.append((size, rank, take, sequences, 0))
                if g > size:
                    held[g - size].append((sequences, take))
                    n[g - size] += take
                sequences += take
                rank += take
                continue
            take = min(take, int(n[g]))
            todo = take
            while todo:
                first, many = held[g].pop()
                use = min(many, todo)
                if use < many:
                    held[g].append((first + use, many - use))
                placed.append((size, rank, use, first, capacity - g))
                if g > size:
                    held[g - size].append((first, use))
                rank += use
                todo -= use
            n[g] -= take
            if g > size:
                n[g - size] += take
    return placed


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, capacity).withColumn("stripe", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(STRIPES)).cast("int")), "pieces")
    counts = cut.groupBy("length", "stripe").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    placed = np.array(sorted(sum_of_squares(sizes, capacity)), dtype=np.int64).reshape(-1, 5)
    lookup = spark.sparkContext.broadcast((placed[:, 0] << 44 | placed[:, 1], placed))

    def place(key: pa.Array) -> pa.Array:
        keys, rows = lookup.value
        k = key.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(keys, k, "right") - 1
        hit = rows[at] if len(k) else np.zeros((0, 5), dtype=np.int64)
        rank = k & ((1 << 44) - 1)
        return pa.StructArray.from_arrays([pa.array(hit[:, 3] + rank - hit[:, 1]), pa.array(hit[:, 4])], ["sequence_id", "offset"])

    before = F.sum("n").over(Window.partitionBy("length").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "stripe", F.coalesce(before, F.lit(0)).alias("base"))
    numbered = cut.withColumn("r", F.row_number().over(Window.partitionBy("length", "stripe").orderBy("doc_id", "start", "ids_crc32")) - 1)
    key = F.shiftleft(F.col("length"), 44) + F.col("base") + F.col("r")
    out = numbered.join(base, ["length", "stripe"]).withColumn("at", F.arrow_udf(place, "sequence_id long, offset long").asNondeterministic()(key))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


@query("op6_sum_of_squares")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
