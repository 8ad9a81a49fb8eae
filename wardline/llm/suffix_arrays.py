"""Exact repeated-substring removal with suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts elsewhere, in any text.

1. *Anchors.* In each window of ``length`` bytes the leftmost least hash of ``GRAM`` bytes is its
   anchor.  Equal windows have equal anchors at equal places, so only windows with the same
   anchor can match.  The windows of one anchor occurrence form a context.  Anchors that
   occur once settle their windows as unique.  Contexts that occur twice or more settle theirs as
   repeated.  That needs 64-bit hashes only and loses nothing.
2. *Shards.* What is left, contexts that differ near edges and edits with one copy of every
   other context of the same anchor, goes by anchor to shards of bounded size; an anchor
   with many different contexts is split over several.  A shard first drops what no window can share: two windows
   that are equal have their anchor at the same offset, so their contexts agree on the bytes that every window with
   its anchor in that range of offsets holds; contexts that agree with no other in a range lose its windows
   (``narrowed``; not for split anchors).  Of the rest it builds a suffix array by
   Larsson-Sadakane refinement (groups not yet sorted are re-sorted by the rank ``h`` bytes on) and
   the common prefixes of neighbours by Kasai's walk in lanes.  Neighbours that share ``length``
   bytes are repeats.
3. *Cross-shard merging.*  For split anchors each shard sends the sorted 128-bit digests of its
   window classes, cut into digest ranges; a range merges its runs by binary search, and
   classes found in two shards are repeats.
4. Removed spans go back to the texts by text digest and are cut out.

Texts are whole UTF-8 byte strings, null counts as empty, and equal texts share one
digest (so repeated rows and repeated ids need no care).  Empty tables give an empty result.
Other columns are passed on or not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.arrays import BASE, Spans, mix, moving_min, utf8
from wardline.llm.registry import query
from wardline.llm.tables import scalar, table, written

LENGTH, GRAM = 200, 32
SHARD_BYTES, SPLIT = 1 << 20, 1000  # text of a shard; contexts of one anchor in a shard
OFFSETS = 8  # of an anchor in a window, taken together when contexts are narrowed
LANE = 64
RANGE_BYTES = 1 << 18  # text of split contexts for each digest range
PLACE_BITS = 26  # of a place in one piece of a block; a longer block is read in pieces that overlap


# ------------------------------------------------------------------ anchors and contexts

def _anchors(keys: np.ndarray, width: int, bits: int = PLACE_BITS) -> np.ndarray:
    """Place of the leftmost least hash (without its ``bits`` lowest bits) of every ``width`` places.

    Places are packed beside the hashes, so at most ``2**bits`` are read at once; pieces overlap by a window, so each is whole in one.
    """
    if width > 1 << bits:
        raise ValueError(f"a window of {width} places needs more than {bits} bits")
    mask = np.uint64((1 << bits) - 1)
    step = (1 << bits) - width + 1
    found = [np.zeros(0, dtype=np.int64)]
    for a in range(0, len(keys) - width + 1, step):
        part = keys[a : a + step + width - 1]
        order = moving_min((part & ~mask) | np.arange(len(part), dtype=np.uint64), width)
        found.append((order & mask).astype(np.int64) + a)
    return np.concatenate(found)


def contexts(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, anchor, context hash, first window start, end of its last window), places within the row."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none
    spans = Spans(data)
    keys = spans.fixed(gram)
    anchor = _anchors(keys, length - gram + 1)  # of every window start
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    whole = np.arange(len(anchor)) + length <= offsets[row + 1]
    fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(fresh & whole)
    if len(first) == 0:
        return none, none, none, none, none
    run = np.cumsum(fresh) - 1
    last = np.flatnonzero(np.r_[fresh[1:], True])[run[first]]
    at = row[first]
    last = np.minimum(last, offsets[at + 1] - length)
    name = mix(spans.hash(first, last + length) + (anchor[first] - first).astype(np.uint64))
    return at, keys[anchor[first]].view(np.int64), name.view(np.int64), first - offsets[at], last + length - offsets[at]


def _contexts(text: pa.Array) -> pa.Array:
    data, offsets = utf8(text)
    row, anchor, name, start, end = contexts(data, offsets)
    cut = np.searchsorted(row, np.arange(len(text) + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(anchor), pa.array(name), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["anchor", "ctx", "start", "end"])
    found = pa.ListArray.from_arrays(pa.array(cut), items)
    name = [hashlib.md5(data[a:b]).digest() for a, b in zip(offsets, offsets[1:])]
    return pa.StructArray.from_arrays([pa.array(name, pa.binary()), found], ["digest", "c"])


# ------------------------------------------------------------------ suffix arrays

def _order(major: np.ndarray, minor: np.ndarray, bits: int) -> np.ndarray:
    """Stable order by (major, minor), both below ``2**bits``: values are sorted with their places packed in."""
    if 3 * bits <= 63:
        return np.sort((major << (2 * bits)) | (minor << bits) | np.arange(len(major))) & ((1 << bits) - 1)
    return np.lexsort((minor, major))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by Larsson-Sadakane refinement; ``text`` holds integers below 256.

    Ranks come from the first symbols that fit beside a place in 63 bits; then every group of equal rank
    is sorted by the rank ``h`` symbols later, and ``h`` doubles.
    """
    n = len(text)
    bits = max(int(n + 1).bit_length(), 1)
    h = max((63 - bits) // 9, 1)
    padded = np.zeros(n + h, dtype=np.int64)
    padded[:n] = text + 1
    key = np.zeros(n, dtype=np.int64)
    for j in range(h):
        key = (key << 9) | padded[j : n + j]
    packed = np.sort((key << bits) | np.arange(n))
    order, sorted_key = packed & ((1 << bits) - 1), packed >> bits
    head = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if n else np.zeros(0, dtype=bool)
    place = np.arange(n)
    rank = np.zeros(n + h + 1, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, place, 0)) + 1
    loose = np.flatnonzero(~(head & np.r_[head[1:], True])) if n else place
    while len(loose):
        suffix = order[loose]
        group = rank[suffix]
        by = _order(group, rank[np.minimum(suffix + h, n)], bits)
        suffix = suffix[by]
        later = rank[np.minimum(suffix + h, n)]  # groups stay where they were: only their members move
        order[loose] = suffix
        same = np.r_[False, (group[1:] == group[:-1]) & (later[1:] == later[:-1])]
        head[loose] = ~same
        first = np.maximum.accumulate(np.where(same, 0, loose))
        rank[suffix] = first + 1
        last = np.r_[~same[1:], True]
        loose = loose[same | ~last]
        h *= 2
    return order


def _leading(x: np.ndarray) -> np.ndarray:
    """Number of leading zero bytes of 64-bit words."""
    out = np.zeros(len(x), dtype=np.int64)
    for half in (32, 16, 8):
        zero = (x >> np.uint64(64 - half)) == 0
        out += np.where(zero, half // 8, 0)
        x = np.where(zero, x << np.uint64(half), x)
    return out + (x == 0)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int | None = None, lane: int = 1024) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order`` (0 for the first), up to ``most``.

    Kasai's walk in text order, in lanes of ``lane`` places side by side, eight symbols a step: the prefix at a
    place is at least the one before it less 1.  ``order`` has to be complete.
    """
    n = len(text)
    most = n if most is None else most
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    padded = np.zeros(n + most + 16, dtype=np.uint64)
    padded[:n] = text
    eight = np.zeros(n + most + 8, dtype=np.uint64)
    for j in range(8):
        eight = (eight << np.uint64(8)) | padded[j : j + len(eight)]
    lanes = np.arange(0, n, lane)
    found = np.zeros(n, dtype=np.int64)
    h = np.zeros(len(lanes), dtype=np.int64)
    for t in range(min(lane, n)):
        if lanes[-1] + t >= n:  # only the last lane can end early
            lanes, h = lanes[:-1], h[:-1]
        i = lanes + t
        j = before[i]
        k = np.maximum(h - 1, 0)
        go = np.flatnonzero((j >= 0) & (k < most))
        a, b = i[go], j[go]
        while len(go):
            step = _leading(eight[a + k[go]] ^ eight[b + k[go]])
            k[go] += step
            on = (step == 8) & (k[go] < most)
            go, a, b = go[on], a[on], b[on]
        h = np.where(j >= 0, np.minimum(np.minimum(k, most), n - np.maximum(i, j)), 0)
        found[i] = h
    return found[order]


def repeated_windows(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts of the pieces in suffix order: (piece, place, class, repeated)."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    text = np.zeros(int(sizes.sum() + len(pieces)), dtype=np.int64)  # bytes of UTF-8 are below 0xF8, so one more fits
    offset = np.cumsum(sizes + 1) - sizes - 1
    body = np.ones(len(text), dtype=bool)
    body[offset + sizes] = False  # an end mark of 0 after each piece
    text[body] = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64) + 1
    order = suffix_array(text)
    prefix = common_prefixes(text, order, length, LANE)
    piece = np.searchsorted(offset, order, side="right") - 1
    place = order - offset[piece]
    window = place + length <= sizes[piece]
    linked = (prefix >= length) & window
    piece, place, linked = piece[window], place[window], linked[window]
    cls = np.cumsum(~linked) - 1
    return piece, place, cls, np.bincount(cls, minlength=1)[cls] > 1 if len(cls) else linked


def _cover(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by windows of ``length`` at sorted ``starts``."""
    if len(starts) == 0:
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist()))


def narrowed(pieces: list[bytes], anchor: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the part of each context whose windows another context of the same anchor may hold (0, 0: none).

    The anchor of a context is its leftmost gram of that hash.  All contexts of an anchor have to be among ``pieces``.
    """
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    offset = np.r_[0, np.cumsum(sizes)]
    spans = Spans(np.frombuffer(b"".join(pieces), dtype=np.uint8))
    keys = spans.fixed(gram).view(np.int64)
    owner = np.repeat(np.arange(len(pieces)), sizes)[: len(keys)]
    hit = np.flatnonzero(keys == anchor[owner])
    which, first = np.unique(owner[hit], return_index=True)
    if len(which) != len(pieces):
        raise ValueError("a context does not hold its anchor")
    at = hit[first]
    left, right = at - offset[:-1], offset[1:] - at - gram
    most = length - gram
    low, high = np.full(len(pieces), length), np.full(len(pieces), -1)
    for a in range(0, most + 1, OFFSETS):
        b = min(a + OFFSETS - 1, most)
        have = np.flatnonzero((left >= a) & (right >= most - b))
        core = mix(spans.hash(at[have] - a, at[have] + gram + most - b) + anchor[have].view(np.uint64) * BASE)
        _, name, n = np.unique(core, return_inverse=True, return_counts=True)
        shared = have[n[name] > 1]
        low[shared] = np.minimum(low[shared], a)
        high[shared] = b
    begin = np.maximum(left - high, 0)
    end = np.minimum(left + gram + most - low, sizes)
    keep = (high >= 0) & (end - begin >= length)
    return np.where(keep, begin, 0), np.where(keep, end, 0)


def _shard(rows: pa.Table, ranges: int) -> pa.Table:
    """One shard: repeated spans (digest, start, end), and for split anchors the digests of its classes."""
    pieces = rows.column("bytes").to_pylist()
    start = rows.column("start").to_numpy().copy()
    split = rows.column("split").to_numpy(zero_copy_only=False)
    digest = rows.column("digest")
    whole = np.flatnonzero(~split)
    if len(whole):
        begin, end = narrowed([pieces[i] for i in whole], rows.column("anchor").to_numpy()[whole])
        for i, a, b in zip(whole.tolist(), begin.tolist(), end.tolist()):
            pieces[i] = pieces[i][a:b]
        start[whole] += begin.astype(np.int32)
    piece, place, cls, repeated = repeated_windows(pieces)
    out_digest, out_start, out_end, runs = [], [], [], []
    again = np.flatnonzero(repeated)
    order = again[np.lexsort((place[again], piece[again]))]
    for p in np.unique(piece[order]).tolist():
        mine = order[np.searchsorted(piece[order], p) : np.searchsorted(piece[order], p, "right")]
        for a, b in _cover(place[mine], LENGTH):
            out_digest.append(digest[p].as_py())
            out_start.append(int(start[p]) + a)
            out_end.append(int(start[p]) + b)
    # one digest for every window of a split anchor; a class is sent once
    lead = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]]) if len(cls) else np.zeros(0, dtype=np.int64)
    hot = np.zeros(len(lead), dtype=bool)
    if len(cls):
        hot[cls[split[piece]]] = True
    names: dict[int, bytes] = {}
    for c in np.flatnonzero(hot).tolist():
        i = int(lead[c])
        names[c] = hashlib.blake2b(pieces[piece[i]][place[i] : place[i] + LENGTH], digest_size=16).digest()
    if names:
        keys = sorted((name, c) for c, name in names.items())
        by_range: dict[int, list[tuple[bytes, int]]] = {}
        for name, c in keys:
            by_range.setdefault(int.from_bytes(name[:4], "big") * ranges >> 32, []).append((name, c))
        for r, items in by_range.items():
            owners = []
            for _, c in items:
                members = range(int(lead[c]), int(lead[c + 1]) if c + 1 < len(lead) else len(cls))
                owners.append([(digest[int(piece[m])].as_py(), int(start[piece[m]] + place[m])) for m in members if split[piece[m]] and not repeated[m]])
            runs.append((r, b"".join(name for name, _ in items), [[{"digest": d, "start": s} for d, s in o] for o in owners]))
    n = len(out_digest)
    kind = pa.list_(pa.list_(pa.struct([("digest", pa.binary()), ("start", pa.int32())])))
    return pa.table({
        "digest": pa.array(out_digest + [None] * len(runs), pa.binary()), "start": pa.array(out_start + [None] * len(runs), pa.int32()),
        "end": pa.array(out_end + [None] * len(runs), pa.int32()), "range": pa.array([None] * n + [r for r, _, _ in runs], pa.int32()),
        "run": pa.array([None] * n + [b for _, b, _ in runs], pa.binary()), "owners": pa.array([None] * n + [o for _, _, o in runs], kind)})


_SHARD_KIND = "digest binary, start int, end int, range int, run binary, owners array<array<struct<digest: binary, start: int>>>"


def merged(runs: list[np.ndarray]) -> list[np.ndarray]:
    """For each sorted run, which of its items another run holds too, by binary search."""
    found = [np.zeros(len(r), dtype=bool) for r in runs]
    total = np.sort(np.concatenate(runs)) if runs else None
    for i, r in enumerate(runs):
        found[i] = np.searchsorted(total, r, "right") - np.searchsorted(total, r, "left") > 1
    return found


def _merge(rows: pa.Table) -> pa.Table:
    pairs = [np.frombuffer(b, dtype=">u8").reshape(-1, 2) for b in rows.column("run").to_pylist()]
    wide = [np.rec.fromarrays([p[:, 0].astype(np.uint64), p[:, 1].astype(np.uint64)], names="a,b") for p in pairs]
    digest, start = [], []
    for i, hit in enumerate(merged(wide)):
        owners = rows.column("owners")[i]
        for k in np.flatnonzero(hit).tolist():
            for o in owners[k].as_py():
                digest.append(o["digest"])
                start.append(o["start"])
    s = np.array(start, dtype=np.int32)
    return pa.table({"digest": pa.array(digest, pa.binary()), "start": pa.array(s), "end": pa.array(s + LENGTH)})


# ------------------------------------------------------------------ the whole

def repeated_spans(docs: DataFrame) -> DataFrame:
    """(digest, start, end): spans of bytes to remove, by md5 of the text; spans of a text may overlap."""
    # the digest comes with the contexts, or the plan would take it once for each of them
    kind = "digest binary, c array<struct<anchor: long, ctx: long, start: int, end: int>>"
    found = docs.select(scalar(_contexts, kind)(F.col("text")).alias("f")).select("f.digest", F.explode("f.c").alias("c"))
    seen = written(found.select("digest", "c.*"), "contexts")
    by_context = seen.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("digest", "start", "end")).alias("one"))
    by_anchor = (by_context.groupBy("anchor").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") == 1).cast("long")).alias("single")).where("`all` > 1"))
    state = written(by_context.join(by_anchor, "anchor").select("anchor", "ctx", "n", "one", "kinds", "single"), "context-state")
    full = seen.join(state.where("n > 1").select("anchor", "ctx"), ["anchor", "ctx"], "left_semi").select("digest", "start", "end").distinct()

    # the contexts that need their bytes, one copy of each
    need = state.where("single > 0").select("anchor", "ctx", "kinds", "one.digest", "one.start", "one.end")
    need = need.groupBy("digest").agg(F.collect_list(F.struct("anchor", "ctx", "kinds", "start", "end")).alias("need"))  # at most the contexts of one text
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    # one copy of each text, by partial aggregates before the exchange that the join needs too
    texts = docs.select(digest.alias("digest"), F.col("text").cast("binary").alias("bytes")).dropDuplicates(["digest"]).join(need, "digest")
    cut = texts.select("digest", "bytes", F.explode("need").alias("w")).select(
        "digest", "w.*", F.substring("bytes", F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("bytes"))
    cut = written(cut, "context-bytes")
    size = F.length("bytes")
    sizes = cut.agg(F.sum(size).alias("all"), F.sum(F.when(F.col("kinds") > SPLIT, size)).alias("split")).first()
    shards = max(1, -(-(sizes["all"] or 0) // SHARD_BYTES))
    ranges = 1 + (sizes["split"] or 0) // RANGE_BYTES
    parts = F.ceil(F.col("kinds") / SPLIT)
    keyed = cut.withColumn("split", F.col("kinds") > SPLIT).withColumn("part", F.when(F.col("split"), F.pmod(F.xxhash64("ctx"), parts)).otherwise(0))
    keyed = keyed.withColumn("shard", F.when(F.col("split"), F.xxhash64("anchor", "part")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))))
    ends = written(keyed.select("shard", "anchor", "digest", "start", "bytes", "split").groupBy("shard").applyInArrow(lambda rows: _shard(rows, ranges), _SHARD_KIND), "shard-results")
    across = ends.where("run IS NOT NULL").select("range", "run", "owners").groupBy("range").applyInArrow(_merge, "digest binary, start int, end int")
    return full.union(ends.where("digest IS NOT NULL").select("digest", "start", "end")).union(across)


def _union(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted(spans or [], key=lambda s: s["start"]):
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["start"], s["end"]))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``removed``: array of (start, end), or null if nothing of the text goes."""
    spans = repeated_spans(docs).groupBy("digest").agg(F.collect_set(F.struct("start", "end")).alias("removed"))  # bounded by the text
    return docs.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary")))).join(spans, "digest", "left").drop("digest")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` whose texts lack their repeated bytes; cut characters at the edges of a span go whole.

    ``n_chars``, where there is such a column, is that of the new text.
    """

    def cut(text: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for t, r in zip(text, removed):
            out.append(t.as_py() if not r.is_valid else _kept(t.as_py().encode(), _union(r.as_py())).decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    columns = docs.columns
    done = _apply2(docs.select("text", F.struct("*").alias("row")), cut, "string", "new")
    kind = dict(docs.dtypes)
    size = F.length("new")
    return done.select(*[F.col("new").alias(c) if c == "text" else size.cast(kind[c]).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in columns])


def _apply2(docs: DataFrame, fn, kind: str, name: str) -> DataFrame:
    def apply(text: pa.Array, removed: pa.Array) -> pa.Array:
        return fn(text, removed)

    return with_spans(docs).withColumn(name, F.arrow_udf(apply, kind)(F.col("text"), F.col("removed"))).drop("removed")


def _digest_row(text: pa.Array, removed: pa.Array) -> pa.Array:
    n_bytes, n_removed, n_spans, sha = [], [], [], []
    for t, r in zip(text, removed):
        raw = t.as_py().encode() if t.is_valid else b""
        spans = _union(r.as_py()) if r.is_valid else []
        n_bytes.append(len(raw))
        n_removed.append(sum(b - a for a, b in spans))
        n_spans.append(len(spans))
        sha.append(hashlib.sha256(_kept(raw, spans)).hexdigest())
    return pa.StructArray.from_arrays([pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha)],
                                      ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


@query("op10_suffix_arrays")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _apply2(docs, _digest_row, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", "d").select("doc_id", "d.*")
