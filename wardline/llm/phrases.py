"""Phrase collocations by SON partitioning: mine shards completely, unite what is locally frequent, count that exactly.

Texts are lower-cased in A-Z and cut at punctuation and line ends into pieces, pieces at blanks and tabs into words.
Per language (null: ``und``) every phrase of 1 to ``WORDS`` words with ``SUPPORT`` or more occurrences is found:

1. A document belongs to one of ``SHARDS`` shards by its id.  A shard's local support is ``SUPPORT`` times the shard's share of the
   language's bytes, rounded up; a phrase below it in every shard is below ``SUPPORT`` in all.  With a fixed support a shard must be
   large to exclude anything, so there are few, and each is mined by many tasks: a task counts the phrases of its texts by 64-bit
   hashes and gives them out as sorted arrays, one for each cell (language and shard) and range of hashes; a range is added up by one
   task.  First words, then pairs of locally frequent words, then longer phrases of locally frequent pairs.
2. The hashes that are locally frequent anywhere are the candidates; two phrases of one hash only make one more candidate.
3. All candidates are counted in all documents.  Up to ``BROADCAST`` of them are counted by their text, a phrase once for a task, in
   few tasks.  More are counted as they are mined, by their hash and a second hash that tells phrases of one hash apart; the frequent
   ones then get their text from a document that has them.

A set of up to ``BROADCAST`` hashes is sent to the tasks as it is, a larger one as a bit filter of ``FILTER`` bits at most.  What a filter
lets through besides the set is counted too and falls under the support, so a full filter costs time and no result.

``collocations`` scores the frequent phrases of two words or more by their worst cut and drops those that mostly occur inside a longer one.

Null and empty texts have no words.  Long texts are read whole.  Repeated rows count each.  Null ids share a shard.
Empty tables give empty results; other columns are not read.  Arithmetic is in 64 bits or decimals, never in doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.arrays import BASE, Spans, blocks, mix, runs, utf8
from wardline.llm.registry import query
from wardline.llm.tables import table, written

WORDS, SUPPORT, COVER, TOP = 4, 30, 80, 2000
SHARDS, BROADCAST, BLOCK, HELD, TEXTS = 4, 500_000, 512 << 10, 1_000_000, 64 << 20
GATHERED = 4_000_000  # hashes that a task sorts at once
RANGE = 16 << 20  # bytes of text for each range of hashes
FILTER, SLICES = 1 << 29, 64
WAVES = 2  # tasks a core that count candidates
STEPS = 64  # from the place that a hash points to; a less even set is searched by halves
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[9] = 32  # a tab parts words as a blank does
CUT = np.zeros(256, dtype=bool)
CUT[[*b".,;:!?", 10, 11, 12, 13]] = True
_OTHER = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, 256, dtype=np.uint64)


class Words:
    """The words of one block of texts."""

    def __init__(self, text: pa.Array) -> None:
        data, offsets = utf8(text)
        self.data = LOWER[data]
        cut = CUT[self.data]
        self.start, self.end = runs(~(cut | (self.data == 32)), offsets)
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        piece = np.cumsum(cut)[self.start] if len(cut) else self.start
        self.word = Spans(self.data).hash(self.start, self.end)
        self.joined = np.zeros(len(self.start), dtype=bool)  # whether the next word is of the same piece
        self.joined[:-1] = (self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1])

    def grams(self, most: int, live: np.ndarray | None = None, part: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, number of the first word, hash) of all phrases of k words, k ascending.

        With ``live``: of those with all their phrases of ``part`` words (0: of one word less) at live places, which the
        caller marks as it gets them.
        """
        at, gram = np.arange(len(self.word)), mix(self.word)
        yield 1, at, gram
        for k in range(2, most + 1):
            inside = self.joined[at + k - 2]
            if live is not None and k > part:
                inside &= live[at] & live[at + (k - part if part else 1)]
            at = at[inside]
            gram = mix(gram[inside] * BASE + self.word[at + k - 1])
            yield k, at, gram

    def texts(self, at: np.ndarray, k: int) -> list[bytes]:
        raw, start, end = self.data.tobytes(), self.start, self.end
        size = end[at + k - 1] - start[at]
        plain = size == sum(end[at + j] - start[at + j] for j in range(k)) + k - 1
        return [raw[start[i] : end[i + k - 1]] if p else b" ".join(raw[start[j] : end[j]] for j in range(i, i + k)) for i, p in zip(at.tolist(), plain.tolist())]

    def checks(self, at: np.ndarray, k: int) -> np.ndarray:
        """A second hash, independent of the first."""
        if not hasattr(self, "sums"):
            self.sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_OTHER[self.data], out=self.sums[1:])
        out = np.zeros(len(at), dtype=np.uint64)
        for j in range(k):
            out = mix(out + self.sums[self.end[at + j]] - self.sums[self.start[at + j]])
        return out

    def marks(self, at: np.ndarray, k: int) -> np.ndarray:
        """30 bits of the second hash and two that tell ``k``: with the first hash, 94 bits for a phrase of a language."""
        return (self.checks(at, k) >> np.uint64(32)).astype(np.uint32) & np.uint32(2**32 - 4) | np.uint32(k - 1)

    def only_texts(self) -> None:
        """Let go of all that ``texts`` does not need."""
        self.start, self.end = self.start.astype(np.int32), self.end.astype(np.int32)
        del self.word, self.row, self.joined
        self.__dict__.pop("sums", None)


class Filter:
    """A set of 64-bit hashes in two bits each, both in the slice that a hash's first bits tell.  It may seem to hold others too."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def size(n: int) -> int:
        return min(1 << max((16 * n).bit_length(), 12), FILTER)

    @staticmethod
    def places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        one = keys >> np.uint64(65 - size.bit_length())
        low = np.uint64(size // SLICES - 1)
        return one, (one & ~low) | (mix(keys) & low)

    @classmethod
    def slice(cls, keys: np.ndarray, size: int) -> np.ndarray:
        """The bits of the slice that all ``keys`` belong to."""
        bits, low = np.zeros(size // SLICES // 8, dtype=np.uint8), np.uint64(size // SLICES - 1)
        for place in cls.places(keys, size):
            place = (place & low).astype(np.int64)
            np.bitwise_or.at(bits, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
        return bits

    @classmethod
    def of(cls, keys: np.ndarray) -> Filter:
        """From sorted hashes."""
        size, at = cls.size(len(keys)), np.append(np.searchsorted(keys, _edges(SLICES)), len(keys))
        return cls(np.concatenate([cls.slice(keys[a:b], size) for a, b in zip(at, at[1:])]))

    def has(self, keys: np.ndarray) -> np.ndarray:
        def test(place: np.ndarray) -> np.ndarray:
            place = place.astype(np.int64)
            return (self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)

        size = 8 * len(self.bits)
        out = test(keys >> np.uint64(65 - size.bit_length()))
        some = np.flatnonzero(out)
        out[some] = test(self.places(keys[some], size)[1])
        return out


class Members:
    """A set of 64-bit hashes."""

    def __init__(self, keys: np.ndarray) -> None:
        keys = np.unique(keys.astype(np.uint64))
        self.ended = np.append(keys, np.uint64(2**64 - 1))
        self.keys = keys = self.ended[:-1]
        self.filter = Filter.of(keys)
        # hashes are spread evenly, so the first bits of one lead to its place but for a few steps
        top = max(len(keys).bit_length() - 2, 1)
        self.shift = np.uint64(64 - top)
        self.first = np.searchsorted(keys, np.arange(1 << top, dtype=np.uint64) << self.shift).astype(np.int32)
        self.even = int(np.diff(self.first, append=len(keys)).max()) <= STEPS

    def __reduce__(self) -> tuple:
        return Members, (self.keys,)  # the rest is made again where it is used

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = self.filter.has(keys)
        some = np.flatnonzero(out)
        keys = keys[some]
        if self.even:
            at = self.first[(keys >> self.shift).astype(np.int64)].astype(np.int64)
            low = np.flatnonzero(self.ended[at] < keys)
            while len(low):
                at[low] += 1
                low = low[self.ended[at[low]] < keys[low]]
        else:
            at = np.searchsorted(self.keys, keys)
        out[some] = (self.ended[at] == keys) & (at < len(self.keys))
        return out


def _edges(ranges: int) -> np.ndarray:
    """The first hash of each range."""
    return np.array([(i << 64) // ranges for i in range(ranges)], dtype=np.uint64)


def _dealt(gram: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that sorted hashes fall into, and where each begins; at the end where the last ends."""
    at = np.append(np.searchsorted(gram, edges), len(gram))
    part = np.flatnonzero(np.diff(at))
    return part, np.append(at[part], len(gram))


def _bytes(column: np.ndarray, at: np.ndarray) -> pa.Array:
    """The pieces of ``column`` between the places ``at``."""
    offsets = (at * column.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(column))])


def _number_bytes(n: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """A byte for each number; those from 255 on are in the second column."""
    large = n >= 255
    return [_bytes(np.minimum(n, 255).astype(np.uint8), at), _bytes(n[large].astype(np.int64), np.append(0, np.cumsum(large))[at])]


def _numbers(few: bytes, many: bytes) -> np.ndarray:
    n = np.frombuffer(few, dtype=np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(many, dtype=np.int64)
    return n


def _together(block: pa.RecordBatch, column: str) -> tuple[pa.RecordBatch, list, np.ndarray]:
    """The block with equal values of ``column`` together, these values, and the first row of each."""
    code = block.column(column).dictionary_encode()
    index = code.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(index, kind="stable")
    return block.take(pa.array(order)), code.dictionary.to_pylist(), np.searchsorted(index[order], np.arange(len(code.dictionary)))


def _groups(gram: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash in which equal (hash, second hash) are together, and where each such group begins."""
    order = np.argsort(gram)
    g, c = gram[order], check[order]
    new, other = np.append(True, g[1:] != g[:-1])[: len(g)], np.append(True, c[1:] != c[:-1])[: len(g)]
    if (other & ~new).any():  # two phrases of one hash
        order = np.lexsort((check, gram))
        g, c = gram[order], check[order]
        new = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))[: len(g)]
    return order, np.flatnonzero(new)


def _mine(lengths: tuple[int, ...], parts: int, known: Broadcast | None, ranges: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the phrases of ``lengths`` words whose parts of ``parts`` words are all in ``known`` (null: of all phrases).

    A row has the hashes of one cell and range, sorted, and their numbers.
    """

    def rows(held: dict[tuple[int, int], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        edges = _edges(ranges)
        for cell, need in list(held):
            gram = np.concatenate(held.pop((cell, need)))
            gram.sort()
            first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            n = np.diff(first, append=len(gram))
            gram = gram[first]
            part, at = _dealt(gram, edges)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(np.full(len(part), cell)), pa.array(np.full(len(part), need)), _bytes(gram, at), *_number_bytes(n, at)],
                ["part", "cell", "need", "grams", "few", "many"])

    def mine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = {}, 0
        for b in blocks(batches, "text", BLOCK):
            b, cells, row = _together(b, "cell")
            w, need = Words(b.column("text")), b.column("need").to_pylist()
            cell = b.column("cell").to_numpy().view(np.uint64)[w.row]
            begin = np.searchsorted(w.row, row)
            frequent = None if known is None else np.zeros(len(w.word) + WORDS, dtype=bool)
            for k, at, gram in w.grams(max(lengths), frequent, parts):
                if k == parts and known is not None:
                    frequent[at[known.value.has(mix(gram ^ cell[at]))]] = True
                if k not in lengths:
                    continue
                cut = np.append(np.searchsorted(at, begin), len(at))
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    held.setdefault((cells[i], need[row[i]]), []).append(gram[cut[i] : cut[i + 1]])
                many += len(at)
            if many >= GATHERED:
                yield from rows(held)
                many = 0
        yield from rows(held)

    return mine


def _locally_frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, gram) of the hashes that reach their cell's local support, from all rows of some ranges."""
    held: dict[tuple[int, int], list[tuple[bytes, ...]]] = {}
    for b in batches:
        cell, need, *counts = (b.column(c).to_pylist() for c in ("cell", "need", "grams", "few", "many"))
        for key, *x in zip(zip(cell, need), *counts):
            held.setdefault(key, []).append(x)
    for cell, need in list(held):
        found = held.pop((cell, need))
        gram = np.frombuffer(b"".join(x[0] for x in found), dtype=np.uint64)
        order = np.argsort(gram)
        gram, n = gram[order], np.concatenate([_numbers(*x[1:]) for x in found])[order]
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        use = first[np.add.reduceat(n, first) >= need]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(use), cell)), pa.array(gram[use].view(np.int64))], ["cell", "gram"])


def _summed(gram: np.ndarray, lang: np.ndarray, check: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and sum of ``n`` of every (gram, lang, check)."""
    key = mix(gram + mix(lang.astype(np.uint64) + np.uint64(1)))
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    known = np.stack([check, lang.astype(np.uint64)])
    if (known != known[:, first][:, group]).any():  # two phrases of one hash: count by all that is known of them
        _, first, group = np.unique(np.concatenate([key[None], known]), axis=1, return_index=True, return_inverse=True)
    total = np.zeros(len(first), dtype=np.int64)
    np.add.at(total, group.reshape(-1), n)
    return first, total


def _count(candidates: Broadcast | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, gram, phrase, k, n) of the candidates in the blocks of a task (null: of all phrases), and k = 0 with the words of each language.

    A phrase is a row once for a task, unless the task has more than ``HELD`` different ones or ``TEXTS`` bytes of them;
    then those found so far are given out.  Blocks are held until ``HELD / 2`` counts are to be added.
    """

    def batch(names: list, k: int, gram: np.ndarray, lang: np.ndarray, n: np.ndarray, phrase: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()).take(pa.array(lang)), pa.array(gram.view(np.int64)), phrase.cast(pa.string()),
             pa.array(np.full(len(n), k, dtype=np.int32)), pa.array(n)], ["lang", "gram", "phrase", "k", "n"])

    def added(k: int, known: tuple | None, parts: list[tuple]) -> tuple:
        """gram, lang, check, n and phrase of ``known`` and the counts of blocks together; only new phrases are read from their block."""
        gram, lang, check, n = (np.concatenate(c) for c in zip(*([known[:4]] if known else []), *(p[2:] for p in parts)))
        first, n = _summed(gram, lang, check, n)
        order = np.argsort(first)
        first, n, begin, phrase = first[order], n[order], 0, []
        if known:
            begin = len(known[0])
            phrase = [known[4].take(pa.array(first[: np.searchsorted(first, begin)]))]
        for w, at, *_ in parts:
            mine = first[np.searchsorted(first, begin) : np.searchsorted(first, begin + len(at))] - begin
            phrase.append(pa.array(w.texts(at[mine], k), pa.large_binary()))
            begin += len(at)
        return gram[first], lang[first], check[first], n, pa.concat_arrays(phrase)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        known, held, many, total = {}, {}, 0, np.zeros(0, dtype=np.int64)

        def add() -> None:
            for k in list(held):
                known[k] = added(k, known.get(k), held.pop(k))

        def rows() -> Iterator[pa.RecordBatch]:
            for k in list(known):
                gram, lang, _, n, phrase = known.pop(k)
                yield batch(list(codes), k, gram, lang, n, phrase)

        for b in blocks(batches, "text", BLOCK):
            w = Words(b.column("text"))
            code = b.column("lang").dictionary_encode()
            own = np.array([codes.setdefault(x, len(codes)) for x in code.dictionary.to_pylist()], dtype=np.int64)
            lang = own[code.indices.to_numpy(zero_copy_only=False)][w.row]
            total = np.bincount(lang, minlength=len(codes)) + np.pad(total, (0, len(codes) - len(total)))
            for k, at, gram in w.grams(WORDS):
                if candidates is not None:
                    use = candidates.value.has(gram)
                    at, gram = at[use], gram[use]
                check = w.checks(at, k)
                first, n = _summed(gram, lang[at], check, np.ones(len(at), dtype=np.int64))
                held.setdefault(k, []).append((w, at[first], gram[first], lang[at[first]], check[first], n))
                many += len(n)
            w.only_texts()
            if 2 * many >= HELD:
                add()
                many = 0
                if sum(len(x[3]) for x in known.values()) > HELD or sum(x[4].nbytes for x in known.values()) > TEXTS:
                    yield from rows()
        add()
        yield from rows()
        some = np.flatnonzero(total)
        yield batch(list(codes), 0, np.zeros(len(some), dtype=np.uint64), some, total[some].astype(np.int64), pa.nulls(len(some), pa.large_binary()))

    return count


COUNTED = "lang string, gram long, phrase string, k int, n long"


def _merged(gram: np.ndarray, check: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each (hash, second hash) once, by hash: the least mark and the sum of the numbers."""
    order, first = _groups(gram, check)
    doc, n = np.minimum.reduceat(doc[order], first), np.add.reduceat(n[order], first, dtype=np.int64)
    order = order[first]
    return gram[order], check[order], doc, n


def _tally(candidates: Broadcast, ranges: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the candidates by both hashes, each once for a task unless it has many; a row has those of one language and range.

    ``docs`` has the least mark of the documents with it.
    A phrase can be frequent only if those of one word less inside it are candidates as well.
    The words of each language are a row of the first range.
    """
    names = ["part", "lang", "words", "grams", "checks", "docs", "few", "many"]

    def rows(known: dict[str, tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        edges = _edges(ranges)
        for lang in list(known):
            gram, check, doc, n = known.pop(lang)
            part, at = _dealt(gram, edges)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array([lang] * len(part), pa.string()), pa.nulls(len(part), pa.int64()), *(_bytes(c, at) for c in (gram, check, doc)),
                 *_number_bytes(n, at)], names)

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, total, many = {}, {}, {}, 0

        def add() -> None:
            for lang in list(held):
                parts = [*held.pop(lang), *([known[lang]] if lang in known else [])]
                known[lang] = _merged(*(np.concatenate(c) for c in zip(*parts)))

        for b in blocks(batches, "text", BLOCK):
            b, langs, row = _together(b, "lang")
            w, doc = Words(b.column("text")), b.column("doc").to_numpy().astype(np.uint32)
            begin = np.searchsorted(w.row, row)
            for lang, n in zip(langs, np.diff(begin, append=len(w.row)).tolist()):
                total[lang] = total.get(lang, 0) + n
            live = np.zeros(len(w.word) + WORDS, dtype=bool)
            for k, at, gram in w.grams(WORDS, live):
                use = candidates.value.has(gram)
                at, gram = at[use], gram[use]
                live[:] = False
                live[at] = True
                counts = gram, w.marks(at, k), doc[w.row[at]], np.ones(len(at), dtype=np.int32)
                cut = np.append(np.searchsorted(at, begin), len(at))
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    held.setdefault(langs[i], []).append(tuple(c[cut[i] : cut[i + 1]] for c in counts))
                many += len(at)
            if 4 * many >= GATHERED:
                add()
                many = 0
                if 2 * sum(len(x[0]) for x in known.values()) >= GATHERED:
                    yield from rows(known)
        add()
        yield from rows(known)
        total = {lang: n for lang, n in total.items() if n}
        none = pa.array([b""] * len(total), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(total), dtype=np.int32)), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), *[none] * 5], names)

    return tally


def _added(support: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, gram, check, k, n, doc) of the phrases that reach the support, from all rows of some ranges; k = 0: the words of a language."""

    def batch(lang: list[str], gram: np.ndarray, check: np.ndarray, k: np.ndarray, n: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(gram.view(np.int64)), pa.array(check.astype(np.int64)), pa.array(k.astype(np.int32)), pa.array(n.astype(np.int64)),
             pa.array(doc.astype(np.int64))], ["lang", "gram", "check", "k", "n", "doc"])

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[bytes, ...]]] = {}
        words: dict[str, int] = {}
        for b in batches:
            for lang, total, *x in zip(*(b.column(c).to_pylist() for c in ("lang", "words", "grams", "checks", "docs", "few", "many"))):
                if total is None:
                    held.setdefault(lang, []).append(x)
                else:
                    words[lang] = words.get(lang, 0) + total
        for lang in list(held):
            found = held.pop(lang)
            gram, check, doc = (np.frombuffer(b"".join(x[i] for x in found), dtype=kind) for i, kind in enumerate((np.uint64, np.uint32, np.uint32)))
            gram, check, doc, n = _merged(gram, check, doc, np.concatenate([_numbers(*x[3:]) for x in found]))
            use = n >= support
            gram, check, doc, n = (c[use] for c in (gram, check, doc, n))
            yield batch([lang] * len(n), gram, check, (check & 3) + 1, n, doc)
        none = np.zeros(len(words), dtype=np.uint64)
        yield batch(list(words), none, none, none, np.array(list(words.values()), dtype=np.int64), none)

    return added


def _texts(marked: Broadcast, chosen: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, gram, check, phrase) of the phrases whose hash is in ``chosen`` with the mark of the document; ``marked`` has all those marks."""

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            use = marked.value.has(mix(whole.column("doc").to_numpy().view(np.uint64)))
            for b in blocks([whole.filter(pa.array(use))], "text", BLOCK):
                b, langs, row = _together(b, "lang")
                w, doc = Words(b.column("text")), b.column("doc").to_numpy().view(np.uint64)
                begin = np.searchsorted(w.row, row)
                for k, at, gram in w.grams(WORDS):
                    use = chosen.value.has(mix(gram ^ doc[w.row[at]]))
                    at, gram = at[use], gram[use]
                    check = w.marks(at, k)
                    cut = np.append(np.searchsorted(at, begin), len(at))
                    for i in np.flatnonzero(np.diff(cut)).tolist():
                        mine = [c[cut[i] : cut[i + 1]] for c in (at, gram, check)]
                        order, first = _groups(*mine[1:])
                        place, *hashes = (c[order[first]] for c in mine)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([langs[i]] * len(place), pa.string()), *(pa.array(c.astype(np.int64)) for c in hashes),
                             pa.array(w.texts(place, k), pa.binary()).cast(pa.string())], ["lang", "gram", "check", "phrase"])

    return texts


def _few_tasks(df: DataFrame) -> DataFrame:
    """``df`` in ``WAVES`` tasks a core at most: every task gives out each candidate that it meets, so with one task for each
    16 MB, say, the rows would grow with the tasks times the candidates."""
    return df.coalesce(WAVES * df.sparkSession.sparkContext.defaultParallelism)


def _keys(columns: list[pa.Array]) -> np.ndarray:
    """The hashes of one column, or of two together."""
    one, *two = (c.to_numpy().view(np.uint64) for c in columns)
    return mix(one ^ two[0]) if two else one


def _cut_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of a task by slices of a filter."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.unique(np.concatenate(held))
        part, at = _dealt(keys, _edges(SLICES))
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), _bytes(keys, at)], ["part", "keys"])

    held, many = [], 0
    for b in batches:
        held.append(_keys(b.columns))
        many += b.num_rows
        if many >= GATHERED:
            yield rows(held)
            held, many = [], 0
    if many:
        yield rows(held)


def _slices(size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for b in batches:
            for part, keys in zip(*(c.to_pylist() for c in b.columns)):
                found = Filter.slice(np.frombuffer(keys, dtype=np.uint64), size)
                bits[part] = found | bits[part] if part in bits else found
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array([x.tobytes() for x in bits.values()], pa.binary())], ["part", "bits"])

    return slices


def _sent(hashes: DataFrame, most: int) -> Broadcast:
    """The set of the rows' hashes (of the two columns together, if there are two): as it is if they are ``most`` or fewer, else as a filter."""
    n = hashes.count()
    if n <= most:
        found = Members(_keys([c.combine_chunks() for c in hashes.toArrow().columns]))
    else:
        size = Filter.size(n)
        rows = hashes.mapInArrow(_cut_keys, "part int, keys binary").repartitionById(SLICES, "part").mapInArrow(_slices(size), "part int, bits binary").toArrow()
        found = Filter(np.zeros(size // 8, dtype=np.uint8))
        for part, bits in zip(rows.column("part").to_pylist(), rows.column("bits")):
            found.bits[part * len(found.bits) // SLICES :][: len(found.bits) // SLICES] = np.frombuffer(bits.as_buffer(), dtype=np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(found)


def _counted_by_text(rows: DataFrame, candidates: Broadcast, support: int) -> DataFrame:
    """lang, phrase, k, n of the candidates with ``support`` or more occurrences, and of k = 0."""
    counted = _few_tasks(rows.select("text", "lang")).mapInArrow(_count(candidates), COUNTED)
    counted = counted.groupBy("lang", "gram", "phrase", "k").agg(F.sum("n").alias("n")).where((F.col("k") == 0) | (F.col("n") >= support))
    return written(counted.select("lang", "phrase", "k", "n"), "phrases")


def _counted_by_hash(rows: DataFrame, candidates: Broadcast, support: int, broadcast: int, ranges: int) -> DataFrame:
    """The same for any number of candidates.  The text of a frequent phrase is told by the document with the least mark, so
    few documents are read for that, and a text is given out about once."""
    read = rows.select("text", "lang", "doc")
    tally = read.mapInArrow(_tally(candidates, ranges), "part int, lang string, words long, grams binary, checks binary, docs binary, few binary, many binary")
    added = tally.repartitionById(ranges, "part").mapInArrow(_added(support), "lang string, gram long, check long, k int, n long, doc long")
    found = written(added, "phrase-counts")
    told = found.where("k > 0")
    marked, chosen = (_sent(x, broadcast) for x in (told.select("doc", F.lit(0).cast("long")).distinct(), told.select("gram", "doc")))
    told = read.mapInArrow(_texts(marked, chosen), "lang string, gram long, check long, phrase string")
    both = found.select("lang", "gram", "check", "k", "n", F.lit(None).cast("string").alias("phrase")).unionByName(
        told.select("lang", "gram", "check", F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("n"), "phrase"))
    both = both.groupBy("lang", "gram", "check").agg(*(F.max(c).alias(c) for c in ("phrase", "k", "n"))).where("k IS NOT NULL")
    phrase = F.when((F.col("k") > 0) & F.col("phrase").isNull(), F.raise_error(F.lit("a frequent phrase has no text"))).otherwise(F.col("phrase"))
    return written(both.select("lang", phrase.alias("phrase"), "k", "n"), "phrases")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, broadcast: int = BROADCAST) -> DataFrame:
    """lang, phrase, k, n of all phrases of 1 to ``WORDS`` words with ``support`` or more occurrences, and per
    language a row of k = 0 with the number of its words (in a table of the shared folder)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    rows = rows.select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)).alias("doc"))
    rows = rows.withColumn("cell", F.xxhash64("lang", "shard"))
    share = rows.groupBy("lang", "cell").agg(F.sum(F.octet_length("text").cast("long") + 1).alias("m"))
    whole = F.sum("m").over(Window.partitionBy("lang"))
    need = share.select("cell", "m", F.floor((F.lit(support).cast("decimal(20,0)") * F.col("m") + whole - 1) / whole).cast("long").alias("need"))
    need = written(need.groupBy("cell").agg(F.min("need").alias("need"), F.sum("m").alias("m")), "phrase-supports")
    size = need.agg(F.sum("m")).first()[0] or 0
    ranges = max(spark.sparkContext.defaultParallelism, -(-size // RANGE))
    celled = rows.join(need, "cell").select("text", "cell", "need")

    def frequent(lengths: tuple[int, ...], parts: int, known: DataFrame | None) -> DataFrame:
        sent = None if known is None else _sent(known, broadcast)
        mined = celled.mapInArrow(_mine(lengths, parts, sent, ranges), "part int, cell long, need long, grams binary, few binary, many binary")
        return written(mined.repartitionById(ranges, "part").mapInArrow(_locally_frequent, "cell long, gram long"), "phrase-candidates")

    words = frequent((1,), 0, None)
    pairs = frequent((2,), 1, words)
    longer = frequent(tuple(range(3, WORDS + 1)), 2, pairs)
    candidates = written(words.union(pairs).union(longer).select("gram").distinct(), "phrase-union")
    sent = _sent(candidates, broadcast)
    if candidates.count() <= broadcast:
        return _counted_by_text(rows, sent, support)
    return _counted_by_hash(rows, sent, support, broadcast, ranges)


def collocations(docs: DataFrame, top: int = TOP, cover: int = COVER, **more) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best ``top`` phrases of two or more words."""
    found = frequent_phrases(docs, **more)
    total = found.where("k = 0").select("lang", F.col("n").alias("n"))
    f = found.where("k > 0").select("lang", "phrase", "k", F.col("n").alias("a"))
    long = f.where("k > 1").withColumn("w", F.split("phrase", " "))
    cuts = long.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "k", "a", "c", F.array_join(F.slice("w", F.lit(1), F.col("c")), " ").alias("first"),
                       F.array_join(F.slice("w", F.col("c") + 1, F.col("k") - F.col("c")), " ").alias("rest"))
    one = f.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    two = f.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    score = F.expr("CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0)) DIV CAST(l + r AS DECIMAL(20,0))")
    worst = (cuts.join(one, ["lang", "first"]).join(two, ["lang", "rest"]).withColumn("score", score)
             .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "c", "l", "r")).alias("m")))
    inner = F.sequence(F.lit(2), F.col("k") - 1)
    parts = F.flatten(F.transform(inner, lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))))
    inside = (long.where("k > 2").select("lang", "a", F.explode(F.array_distinct(parts)).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("held")))
    kept = worst.join(inside, ["lang", "phrase"], "left").where(
        F.expr(f"held IS NULL OR CAST(held AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * {int(cover)}"))
    order = Window.partitionBy("lang").orderBy(F.desc("m.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n", F.col("m.score").alias("score"))


_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest(range(1, 5)) AS k) ks WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
y AS (SELECT x.lang, x.phrase, x.a, x.cut, l.a AS l, r.a AS r, (2000000::HUGEINT * x.a) // (l.a + r.a) AS score FROM x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1 : cut], ' ')
  JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[cut + 1 : x.k], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(w[s : s + m - 1], ' ') AS phrase, max(a) AS held FROM (
  SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY ALL),
o AS (SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, z.phrase) AS rank, z.phrase, a, l, r, score::BIGINT AS score
  FROM z LEFT JOIN i USING (lang, phrase) WHERE held IS NULL OR 100 * held < 80 * a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op13_son_phrases", _SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of the documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # whole texts: smaller batches, less memory
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return collocations(table(spark, sf_dir, "documents"))
