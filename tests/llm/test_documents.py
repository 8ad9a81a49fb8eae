"""Operators on documents: edge rows, brute force and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardline.llm import bagminhash, leaks, packing, quality, slots, suffix_arrays, toxicity
from wardline.llm.components import components


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bag(text):
    w = words(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(3)
    a = [f"w{rng.randrange(200)}" for _ in range(400)]
    b = a[:180] + ["zz", "yy", "xx"] + a[180:] + ["a b c d e f"] * 6
    texts = pa.array([" ".join(a), " ".join(b)])
    r, s, w, _ = bagminhash.bags(texts)
    sig = bagminhash.signatures(r, s, w, 2, 4000)
    bags = bagminhash._bag_bytes(texts)
    assert abs((sig[0] == sig[1]).mean() - bagminhash.overlap(bags[0].as_py(), bags[1].as_py())) < 0.03


@pytest.mark.parametrize("widths", [bagminhash.WIDTHS, (1, 2, 4)])
def test_a_hot_bucket_of_near_and_stray_copies(spark, widths):
    """One text in many versions: some near it, some only near each other, most of them near nothing though they share buckets."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(240)]
    other = base[:170] + [f"v{k}" for k in range(70)]
    rows = []
    for n in range(120):
        w = list(other if n % 4 == 3 else base)
        for _ in range(rng.choice([1, 2, 5, 9, 14])):
            w[rng.randrange(len(w))] = f"x{n}y{rng.randrange(100)}"
        rows.append((n, " ".join(w)))
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), widths).collect()}
    assert got == {i: find(i) for i in range(len(rows))} and 10 < len(set(got.values())) < 110


def test_near_duplicates_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    rng, extra = random.Random(1), []
    for n, text in enumerate(docs.text[docs.text.str.len() > 1500].head(8)):
        w = text.split()
        for k in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = f"changed{n}x{k}"
            extra.append((10_000 + 4 * n + k, " ".join(v)))
    rows = [*zip(docs.doc_id.tolist(), docs.text.tolist()), *extra]
    bags = {i: bag(t) for i, t in rows}
    having = defaultdict(list)
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(bags):
        for j in {j for s in bags[i] or () for j in having[s]}:
            if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in bags[i] or ():
            having[s].append(i)
    got = {r.doc_id: r.class_id for r in bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in bags}


def test_near_duplicates_edge_rows(odd, none):
    got = sorted(((r.doc_id or 0, r.class_id or 0) for r in bagminhash.classes(odd).collect()))
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8)]
    kept = bagminhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert bagminhash.one_of_each(none).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (102, 101)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def removed_by_force(texts, n=200):
    seen = Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - n + 1):
            if seen[t[i:i + n]] > 1:
                mark[i:i + n] = True
        out.append(mark)
    return out


@pytest.mark.parametrize("split", [1000, 2])
def test_repeats_match_brute_force(spark, small, split, monkeypatch):
    monkeypatch.setattr(suffix_arrays, "SPLIT", split)
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    rows = [(i, t) for i, t in zip(docs.doc_id.tolist(), docs.text.tolist()) if len(t) < 6000] + [(10_001, "ab" * 400), (10_002, None), (10_003, "")]
    raw = [(t or "").encode() for _, t in rows]
    want = {}
    for (i, _), t, m in zip(rows, raw, removed_by_force(raw)):
        spans = int((np.diff(np.r_[0, m.astype(int), 0]) == 1).sum())
        want[i] = (len(t), int(m.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest())
    done = suffix_arrays._apply2(spark.createDataFrame(rows, "doc_id long, text string"), suffix_arrays._digest_row, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", "d")
    got = {r.doc_id: (r.d.n_bytes, r.d.n_removed, r.d.n_spans, r.d.kept_sha256) for r in done.collect()}
    assert got == want


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 9, 700):
        t = rng.integers(0, 3, n)
        if n > 500:
            t[300:500] = t[50:250]
        raw = bytes(t.tolist())
        order = suffix_arrays.suffix_array(t)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])

        def common(a, b):
            k = 0
            while max(a, b) + k < n and raw[a + k] == raw[b + k]:
                k += 1
            return k

        assert suffix_arrays.common_prefixes(t, order, None, 64).tolist() == [0] * bool(n) + [common(order[i - 1], order[i]) for i in range(1, n)]


def test_repeats_edge_rows(odd, none):
    got = suffix_arrays.without_repeats(odd)
    assert got.columns == odd.columns
    by = defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r)
    assert [r.text for r in by[1]] == ["", ""] and by[None][0].text == "" and by[3][0].text is None and by[5][0].text == "lone short text"
    assert by[2][0].text == odd.where("doc_id = 2").first().text and by[7][0].n_chars == len(by[7][0].text)
    assert suffix_arrays.without_repeats(none).count() == 0


@pytest.mark.parametrize("n", [168, 169, 856, 857, 1024, 1025, 5000])
def test_anchors_of_blocks_longer_than_their_place_bits(n):
    keys = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    keys[n // 2:] = keys[: n - n // 2]  # the same hashes again, far away
    high = keys >> np.uint64(10)
    want = [s + int(np.argmin(high[s: s + 169])) for s in range(n - 168)]
    assert suffix_arrays._anchors(keys, 169, bits=10).tolist() == want


def test_texts_longer_than_the_place_bits_share_anchors(monkeypatch):
    monkeypatch.setattr(suffix_arrays._anchors, "__defaults__", (12,))
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 600, dtype=np.uint8)
    data = np.concatenate([rng.integers(97, 123, 3000, dtype=np.uint8), passage, rng.integers(97, 123, 9000, dtype=np.uint8), passage])
    _, _, name, start, _ = suffix_arrays.contexts(data, np.array([0, len(data)]))
    assert len(set(name.tolist())) < len(name) and start.max() > 1 << 12


def test_leaks(spark, odd, none):
    item = "seven small boats left the harbour at dawn and none of the sailors knew which of the islands they would reach before the storm came in from the north west"
    w = item.split()
    near = " ".join(w[:-1] + ["east"])
    docs = spark.createDataFrame([(1, f"before it {item.upper()}, after it"), (2, near), (3, "no relation at all to it"), (4, " ".join(w[:12])), (5, None), (6, ""), (7, f"{item}. {item}")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(10, item), (11, "tiny item"), (12, None), (13, "")], "item_id long, text string")
    got = {r.doc_id: sorted(m.item_id for m in r.matches) for r in leaks.matched(docs, benchmark).collect()}
    assert got == {1: [10], 2: [10], 3: [], 4: [], 5: [], 6: [], 7: [10, 10]}
    parts = leaks.matched(docs, benchmark, items=1)
    assert {r.doc_id: sorted(m.item_id for m in r.matches) for r in parts.collect()} == got
    assert leaks.clean(odd, benchmark).columns == odd.columns and leaks.clean(odd, benchmark).count() == odd.count()
    assert leaks.clean(none, benchmark).count() == 0 and leaks.clean(odd, benchmark.where("false")).count() == odd.count()


def test_leaks_match_brute_force_at_the_threshold():
    """Words replaced at an edge, passages cut short at a text's ends and halves in the other order, at the similarity or just below."""
    rng = random.Random(5)
    item_texts, texts = [], []

    def fresh(n, at):
        return [f"{at}{rng.randrange(10**9)}" for _ in range(n)]

    for n in (4, 5, 13, 22, 31, 40, 76, 148, 199):
        for repeats in (0, max(0, (n - 4) // 9)):
            w = ["same"] * repeats + fresh(n - repeats, "w")
            i, k = len(item_texts), max(0, (n - 4) // 9)
            item_texts.append(w)
            for lost in (k, k + 1):
                texts += [fresh(30, "x") + fresh(lost, "y") + w[lost:] + fresh(30, "x"), fresh(30, "x") + w[: n - lost] + fresh(lost + 30, "x")]
                texts += [fresh(30, "x") + w[: n - 2 * lost], w[2 * lost:] + fresh(30, "x"), w[lost: n - lost]]
            texts += [w[n // 2:] + w[: n // 2], fresh(9, "x") + w[n // 2:] + w[: n // 2] + fresh(9, "x"), fresh(9, "x") + w[: n // 2] + fresh(1, "x") + w[n // 2:]]
    index = leaks.Index(list(range(len(item_texts))), [" ".join(w) for w in item_texts])
    got = [{m["item_id"]: m["similarity"] for m in sorted(found, key=lambda m: m["similarity"])} for found in index.matches(pa.array([" ".join(t) for t in texts])).to_pylist()]
    bags = [bag(" ".join(w)) for w in item_texts]
    some = 0
    for t, found in zip(texts, got):
        want = {}
        for i, w in enumerate(item_texts):
            if not set(w) & set(t):
                continue
            best = 0.0
            for s in range(-len(w) + 1, len(t)):
                b = bag(" ".join(t[max(s, 0): s + len(w)]))
                best = max(best, (b & bags[i]).total() / (b | bags[i]).total())
            if best >= 0.8:
                want[i] = best
        some += len(want)
        assert found == want
    assert some >= 70


def test_packing_round_trip(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(odd, path).toPandas()
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[(r.doc_id or -1, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(np.array(ids[k:k + 2048], dtype="<u4").tobytes()))] += 1
    got = Counter((-1 if d != d or d is None else int(d), p, s, n, c) for d, p, s, n, c in zip(rows.doc_id, rows.piece, rows.start, rows.length, rows.ids_crc32))
    assert got == want
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize("text", ["It's <|endoftext|> don't ÉCOLE Straße ΟΔΟΣ İstanbul", "e\u0301cole a\x1cb c\u00a0d", "x9y!! --a-- \u2003 q'll 12,5 <b>"])
def test_words_encode_like_the_whole(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoded([text], path)[0], dtype="<u4").tolist() == ids


def test_sum_of_squares_packs_tightly():
    rng = random.Random(5)
    sizes = Counter(min(2047, int(rng.expovariate(1 / 600)) + 1) for _ in range(20_000))
    placed = packing.sum_of_squares(dict(sizes))
    used = max(p[3] + p[2] for p in placed)
    assert sum(p[2] for p in placed) == 20_000 and used <= 1.003 * sum(s * n for s, n in sizes.items()) / 2048 + 2


def test_sharding(odd, none):
    got = slots.shard(odd, 5, 64).toPandas()
    assert len(got) == 10
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert ((got.grown_shard == got["shard"]) | (got.grown_shard == 5)).all()
    a, b = slots.key_map(40), slots.key_map(41)
    assert all(x == y or y == 40 for x, y in zip(a, b)) and max(Counter(b).values()) - min(Counter(b).values()) <= 1
    assert slots.shard(none, 5, 64).count() == 0
    load = [0] * 4
    for s, shard in enumerate(slots.rebalanced([0] * 64, list(range(64)), 4)):
        load[shard] += s
    assert max(load) - min(load) < 64


def test_quality_accuracy_and_edge_rows(spark, odd, none, no_labels):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.op2(spark, d).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    assert quality.accepted(odd, no_labels, 0.5).columns == odd.columns
    assert quality.accepted(odd, no_labels, 0.5).count() == 10 and quality.accepted(none, no_labels).count() == 0


def test_toxicity_accuracy_and_edge_rows(spark, odd, none, no_labels):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.op1(spark, d).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.9
    assert {r.score for r in toxicity.score(odd.select("doc_id", "text"), no_labels).collect()} == {0.5}
    assert toxicity.score(none, no_labels).count() == 0


def test_toxicity_ratios_are_kept_by_whole_gram(spark, odd):
    """Each text has the ratios of a plain sum over its own grams, by the broadcast and by the joins; an unseen gram backs off."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij\u00e9", k=rng.randrange(1, 12)))
    texts = [" ".join(word() for _ in range(30)) for _ in range(60)]
    seen = spark.createDataFrame([(t, k % 3) for k, t in enumerate(texts)], "text string, cls long").unionByName(odd.select("text", F.lit(2).cast("long").alias("cls"))).cache()
    counts = toxicity.count(seen).cache()
    by_gram, by_ctx = ({r.gram: r.llr for r in x.collect()} for x in toxicity.ratios(counts))
    want = Counter()
    for t, in seen.select("text").collect():
        sums, size, n = [], 0, 0
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode()):
            g, s = 0, 0.0
            for b in w:
                g = (g << 8 | b) & (1 << 48) - 1
                s += by_gram.get(g, by_ctx.get(g >> 8, 0.0))
            sums.append((s, len(w)))
        want[tuple(round(x, 9) + 0.0 for x in (sum(s for s, _ in sums) / max(sum(k for _, k in sums), 1), max([0.0, *(s / (k + 2) for s, k in sums)]), np.log1p(len(sums))))] += 1
    assert len(want) > 60
    for most in (10**6, 0):
        got = toxicity.with_ratios(seen, toxicity.model(counts, most)).select("_r.*").collect()
        assert Counter(tuple(round(x, 9) + 0.0 for x in r) for r in got) == want


def test_pipeline_runs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = corpus_pipeline.run(spark, small).toPandas()
    assert 0 < rows.doc_id.nunique() <= docs.count() and rows.groupby("sequence_id").length.sum().max() <= 2048


def test_narrowed_contexts_keep_every_shared_window():
    rng = np.random.default_rng(7)
    length, gram = suffix_arrays.LENGTH, suffix_arrays.GRAM
    core = rng.integers(97, 123, 1200, dtype=np.uint8)
    texts = []
    for k in range(14):  # copies cut and edited at different places, and texts that share one gram only
        t = core[rng.integers(0, 300): rng.integers(700, 1200)].copy()
        t[rng.integers(0, len(t), 3)] = 35
        texts += [t, np.concatenate([rng.integers(97, 123, 300, dtype=np.uint8), core[500:540], rng.integers(97, 123, 300, dtype=np.uint8)])]
    data, offsets = np.concatenate(texts), np.r_[0, np.cumsum([len(t) for t in texts])]
    row, anchor, name, start, end = suffix_arrays.contexts(data, offsets)
    _, keep = np.unique(np.stack([anchor, name]), axis=1, return_index=True)
    pieces = [data[offsets[row[i]] + start[i]: offsets[row[i]] + end[i]].tobytes() for i in keep]
    begin, end = suffix_arrays.narrowed(pieces, anchor[keep], length, gram)
    seen = Counter(p[i: i + length] for p in pieces for i in range(len(p) - length + 1))
    left = Counter(p[a:b][i: i + length] for p, a, b in zip(pieces, begin, end) for i in range(b - a - length + 1))
    assert {w: n for w, n in seen.items() if n > 1} == {w: n for w, n in left.items() if n > 1} != {}
    assert sum(end - begin) < sum(map(len, pieces)) and (end - begin == 0).any()
