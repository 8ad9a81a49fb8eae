"""Phrases against a plain count: every support, shards, sets that are sent or joined, odd texts, hash collisions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wardline.llm import phrases

KIND = "doc_id long, text string, lang string, source string, n_chars long, phrase string, gram long, cell long"


def counted(rows):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, support, top):
    f, n = counted(rows)
    f = {p: a for p, a in f.items() if a >= support}
    held, out = Counter(), {}
    for (lang, w), a in f.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                held[lang, w[i : i + size]] = max(held[lang, w[i : i + size]], a)
    for (lang, w), a in f.items():
        if len(w) > 1 and not 100 * held[lang, w] >= 80 * a:
            score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for r, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", 2, 3) for i, t, lang in rows], KIND).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "New", "York", "city", "é", "ñandú", "z z", "it's"]
    def text():
        out = []
        for _ in range(rng.randrange(1, 60)):
            out.append(rng.choice(["New York city hall", "new\tyork  City", rng.choice(words), rng.choice(words) + rng.choice([".", ",", "\n", " ;", "!?"])]))
        return rng.choice([" ", "  ", "\t"]).join(out)
    rows = [(i, text(), rng.choice(["en", "de", None])) for i in range(120)]
    rows += [(None, text(), "en"), (None, text(), "en"), (1, None, "en"), (2, "", None), (3, " \t.\n", "fr"), rows[0], rows[0], (500, "very long text indeed " * 30_000, "fr")]
    return rows


@pytest.mark.parametrize("more", [{}, {"shards": 1, "support": 5}, {"shards": 9, "support": 5, "broadcast": 0}])
def test_collocations_equal_a_plain_count(spark, texts, more):
    got = phrases.collocations(frame(spark, texts), top=40, **more).collect()
    assert sorted(tuple(r) for r in got) == plain(texts, more.get("support", 30), 40)


def test_frequent_phrases_of_all_lengths(spark, texts):
    f, n = counted(texts)
    got = {(r.lang, r.k, r.phrase): r.n for r in phrases.frequent_phrases(frame(spark, texts), 20).collect()}
    want = {(lang, len(w), " ".join(w)): a for (lang, w), a in f.items() if a >= 20}
    assert got == want | {(lang, 0, None): a for lang, a in n.items() if a}


def test_empty_tables(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [(1, None, None), (2, "", "en")])).collect() == []


def test_phrases_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(phrases, "mix", lambda x: np.zeros_like(x))  # every first hash is the same
    monkeypatch.setattr(phrases.Words, "checks", lambda self, at, k: np.array([zlib.crc32(t) for t in self.texts(at, k)], dtype=np.uint64))
    batch = pa.record_batch([pa.array(["a b a b c", "a b"]), pa.array(["en", "de"])], ["text", "lang"])
    rows = [r for b in phrases._count(None)([batch]) for r in b.to_pylist() if r["k"] == 2]
    assert sorted((r["lang"], r["phrase"], r["n"]) for r in rows) == [("de", "a b", 1), ("en", "a b", 2), ("en", "b a", 1), ("en", "b c", 1)]


def test_blocks_of_a_task_give_a_phrase_once(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 8)
    batch = pa.record_batch([pa.array(["a  b a b", "A b", None, "b a b"]), pa.array(["en", "en", "de", "de"])], ["text", "lang"])
    want = [("de", None, 3), ("de", "a b", 1), ("de", "b a", 1), ("en", None, 6), ("en", "a b", 3), ("en", "b a", 1)]
    got = [r for b in phrases._count(None)([batch, batch.slice(0, 0)]) for r in b.to_pylist() if r["k"] in (0, 2)]
    assert sorted(((r["lang"], r["phrase"], r["n"]) for r in got), key=str) == sorted(want, key=str)
    monkeypatch.setattr(phrases, "HELD", 1)  # each block by itself
    got = [r for b in phrases._count(None)([batch]) for r in b.to_pylist() if r["k"] == 2]
    assert sum(r["n"] for r in got) == 6


def test_a_phrase_is_a_row_once_for_a_task(monkeypatch):
    """The rows of a task are its different phrases, however many blocks and counts it reads (before: one for each ``HELD`` counts)."""
    monkeypatch.setattr(phrases, "BLOCK", 40)
    monkeypatch.setattr(phrases, "HELD", 300)  # there are 240 different phrases
    words = [f"w{i}" for i in range(6)]
    rng = random.Random(3)
    rows = [(i, "  ".join(rng.choices(words[:3] if i % 2 else words[3:], k=12)) + ".", "en") for i in range(200)]
    batches = [pa.record_batch([pa.array([t for _, t, _ in rows[i : i + 50]]), pa.array(["en"] * 50)], ["text", "lang"]) for i in range(0, 200, 50)]
    for most in (64 << 20, 500):  # in few bytes a task gives out what it holds, and no count is lost
        monkeypatch.setattr(phrases, "TEXTS", most)
        got = [r for b in phrases._count(None)(batches) for r in b.to_pylist() if r["k"]]
        total = Counter()
        for r in got:
            total[r["lang"], tuple(r["phrase"].split(" "))] += r["n"]
        assert total == counted(rows)[0]
        assert (len(got) == len(total)) == (most > 500)


def test_rows_do_not_grow_with_splits_times_phrases(spark, monkeypatch):
    """Many splits of the same phrases are counted in few tasks (before: a row of each phrase from every split)."""
    made, real = [], phrases._few_tasks
    monkeypatch.setattr(phrases, "_few_tasks", lambda df: made.append((df, real(df))) or made[-1][1])
    docs = frame(spark, [(i, "red fox runs home", "en") for i in range(200)]).repartition(40)
    assert {r.n for r in phrases.frequent_phrases(docs).where("k > 0").collect()} == {200}
    (before, after), = made
    assert before.rdd.getNumPartitions() == 40 and after.rdd.getNumPartitions() == phrases.WAVES * spark.sparkContext.defaultParallelism < 40
    assert after.count() == 200


@pytest.mark.parametrize("keys", [[], [0], [2**64 - 1], [0, 5, 2**63, 2**64 - 1], list(range(1000)), [k * 2**54 for k in range(1000)]])
def test_members(keys):
    import pickle

    asked = np.array([*keys, 0, 1, 5, 999, 1000, 2**54, 2**54 + 1, 2**63 - 1, 2**64 - 2, 2**64 - 1], dtype=np.uint64)
    held = pickle.loads(pickle.dumps(phrases.Members(np.array(keys, dtype=np.uint64))))
    assert held.has(asked).tolist() == [int(k) in set(keys) for k in asked]
    assert len(pickle.dumps(held)) < 8 * len(keys) + 500  # only the keys are sent


def test_large_sets_still_exclude(spark, texts, monkeypatch):
    """More hashes than are sent as they are: tasks still leave out what holds no frequent part (before: all phrases were counted)."""
    known, made, real = [], [], phrases._mine
    monkeypatch.setattr(phrases, "_mine", lambda *a: known.append(a[2]) or real(*a))
    monkeypatch.setattr(phrases, "_count", lambda *a: made.append(a))
    f, n = counted(texts)
    got = {(r.lang, r.k, r.phrase): r.n for r in phrases.frequent_phrases(frame(spark, texts), 20, broadcast=0).collect()}
    assert got == {(lang, len(w), " ".join(w)): a for (lang, w), a in f.items() if a >= 20} | {(lang, 0, None): a for lang, a in n.items() if a}
    assert [x is None for x in known] == [True, False, False] and not made
    assert all(isinstance(x.value, phrases.Filter) for x in known[1:])


@pytest.mark.parametrize("most", [1 << 29, 1 << 12])
def test_filter(monkeypatch, most):
    monkeypatch.setattr(phrases, "FILTER", most)
    keys = np.random.Generator(np.random.PCG64(1)).integers(0, 2**64, 40_000, dtype=np.uint64)
    keys[:2] = 0, 2**64 - 1
    held, others = keys[::2], keys[1::2]
    for found in (phrases.Filter.of(np.sort(held)), phrases.Members(held).filter):
        assert found.has(held).all() and 8 * len(found.bits) == min(1 << 19, most)
        assert most < 1 << 19 or found.has(others).mean() < 0.02
    assert not phrases.Filter.of(held[:0]).has(keys).any()


def mined(text, known, ranges=3, parts=1, lengths=(2,)):
    class Sent:
        value = phrases.Members(known)

    n = len(text)
    batch = pa.record_batch([pa.array(text), pa.array([7, 9] * (n // 2)), pa.array([2, 3] * (n // 2))], ["text", "cell", "need"])
    return list(phrases._mine(lengths, parts, Sent, ranges)([batch]))


def test_a_cell_has_its_own_support_and_counts():
    one = phrases.Words(pa.array(["a b c"]))
    gram = {k: dict(zip(at.tolist(), g)) for k, at, g in one.grams(2)}
    known = phrases.mix(np.array([gram[1][i] ^ np.uint64(cell) for cell in (7, 9) for i in (0, 1)]))  # "a" and "b"
    rows = mined(["a b. b c", "a b", "a c", "a  b", *["a b"] * 600], known)
    got = {(r["cell"], g): n for b in rows for r in b.to_pylist() for g, n in zip(np.frombuffer(r["grams"], np.uint64).tolist(), phrases._numbers(r["few"], r["many"]).tolist())}
    assert got == {(7, int(gram[2][0])): 301, (9, int(gram[2][0])): 302}
    rows = mined(["a b", "a b", "a", "a b"], known) + mined(["a b", "x"], known)
    found = [r for b in phrases._locally_frequent(rows) for r in b.to_pylist()]
    assert found == [{"cell": 7, "gram": int(gram[2][0].view(np.int64))}]  # 2 of 2 in cell 7, 2 of 3 in cell 9


def test_phrases_of_one_hash_are_counted_apart(monkeypatch):
    class Sent:
        value = phrases.Filter(np.full(512, 255, dtype=np.uint8))  # holds all

    monkeypatch.setattr(phrases, "mix", lambda x: np.zeros_like(x))  # every first hash is the same
    monkeypatch.setattr(phrases.Words, "checks", lambda self, at, k: np.array([zlib.crc32(t) << 32 for t in self.texts(at, k)], dtype=np.uint64))
    batches = [pa.record_batch([pa.array(["a b a b c", "a b"]), pa.array(["en", "de"]), pa.array([doc, doc + 1])], ["text", "lang", "doc"]) for doc in (5, 3)]
    found = [r for b in phrases._added(2)([r for b in batches for r in phrases._tally(Sent, 4)([b])]) for r in b.to_pylist()]
    told = [r for x in batches for b in phrases._texts(Sent, Sent)([x]) for r in b.to_pylist()]
    text = {(r["lang"], r["check"]): r["phrase"] for r in told}
    got = {(r["lang"], r["k"], text.get((r["lang"], r["check"]))): (r["n"], r["doc"]) for r in found}
    assert {x: n for x, n in got.items() if x[1] == 2} == {("en", 2, "a b"): (4, 3), ("en", 2, "b a"): (2, 3), ("en", 2, "b c"): (2, 3), ("de", 2, "a b"): (2, 4)}
    assert {(x, n[0]) for x, n in got.items() if x[1] == 0} == {(("en", 0, None), 10), (("de", 0, None), 4)}


def test_a_candidate_is_counted_once_for_a_task(monkeypatch):
    """However many blocks and sorts a task needs; in little room it gives out what it has and no count is lost."""
    class Sent:
        value = phrases.Filter(np.full(512, 255, dtype=np.uint8))

    monkeypatch.setattr(phrases, "BLOCK", 40)
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcd", k=12)) for _ in range(100)]
    batch = pa.record_batch([pa.array(texts), pa.array(["en"] * 100), pa.array(range(100))], ["text", "lang", "doc"])
    f, _ = counted([(0, t, "en") for t in texts])
    for room, once in ((2000, True), (40, False)):
        monkeypatch.setattr(phrases, "GATHERED", room)
        rows = list(phrases._tally(Sent, 3)([batch]))
        made = sum(len(r["grams"]) // 8 for b in rows for r in b.to_pylist())
        assert (made == len(f)) == once
        found = [r for b in phrases._added(2)(rows) for r in b.to_pylist() if r["k"]]
        assert sorted((r["k"], r["n"]) for r in found) == sorted((len(w), n) for (_, w), n in f.items() if n >= 2)


def test_one_document_in_two_languages(spark):
    """Rows that differ in their language alone have one mark, and each language gets its phrases."""
    rows = [(i % 3, "red fox", lang) for i in range(90) for lang in ("en", None, "de")]
    got = phrases.frequent_phrases(frame(spark, rows).coalesce(1), broadcast=0).where("k = 2").collect()
    assert sorted(tuple(r) for r in got) == [(lang, "red fox", 2, 90) for lang in ("de", "en", "und")]


def test_a_frequent_phrase_is_told_about_once(spark):
    docs = frame(spark, [(i, "red fox runs home", "en") for i in range(200)]).repartition(40)
    made = []
    real = phrases._texts
    phrases._texts = lambda *a: made.append(a) or real(*a)
    try:
        assert {r.n for r in phrases.frequent_phrases(docs, broadcast=5).where("k > 0").collect()} == {200}
    finally:
        phrases._texts = real
    (marked, chosen), = made
    assert len(marked.value.keys) == 1  # of 200 documents one tells all phrases
