"""Toxicity: class-conditional Kneser-Ney models over byte n-grams inside words.

The event is a byte given the ``ORDER - 1`` bytes before it in its word.  Counts of toxic and
ordinary training texts discount each seen event; what is left goes to one shared backoff
model, the continuation counts of all documents, labelled or not.  So an expression that
one class lacks is smoothed alike in both, and unseen variants of a toxic stem still score.

    P_c(b | h) = max(n_c(hb) - D, 0) / n_c(h) + D * types_c(h) / n_c(h) * shared(b | h')

Where an event is unseen in both classes the shared part cancels and only the context's
backoff weights remain.  Both ratios are kept by whole gram, none is merged with another or dropped: as many
numbers as the corpus has grams in a class.  Up to ``BROADCAST_GRAMS`` of them are broadcast; more are joined to the
grams of the distinct words by salted shuffles, with the same results.  A text has two length-normalised log-likelihood ratios, per byte of
the text and per byte of its most toxic word; a logistic fit on a fold kept out of the
counts makes the score.  Counting covers every document; that fit takes ``SAMPLE`` rows at most.

Empty and null texts have ratios of 0.  Repeated rows count and are scored each.  Without
both classes among the labels every score is their share (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.arrays import WORD_BYTE, blocks, lowered, runs, utf8
from wardline.llm.registry import query
from wardline.llm.tables import fold, scalar, table, with_label, written
from wardline.operators.segmented import salted_join

ORDER, SAMPLE, DISCOUNT, FLUSH, BROADCAST_GRAMS = 6, 50_000, 0.75, 1 << 20, 4_000_000
FEATURES = ["per_byte", "worst", "log_words"]


def events(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word number, gram, word row): ``gram`` packs the byte and its ORDER-1 predecessors in the word."""
    return _events(*lowered(text))


def _events(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end = runs(WORD_BYTE[data], offsets)
    length = end - start
    word = np.repeat(np.arange(len(start)), length)
    at = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
    source = np.repeat(start, length) + at
    gram = np.zeros(len(word), dtype=np.int64)
    for d in range(ORDER):
        byte = data[np.maximum(source - d, 0)].astype(np.int64)
        byte[at < d] = 0
        gram |= byte << (8 * d)
    word_row = np.searchsorted(offsets, start, side="right") - 1
    return word_row[word] if len(word) else word, word, gram, word_row


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, toxic, ordinary, total: counted per task, flushed when the table of distinct grams is large."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        grams = np.concatenate([g for g, _ in held])
        order = np.argsort(grams, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(grams[order]) != 0])
        return grams[order][first], np.add.reduceat(np.concatenate([c for _, c in held])[order], first)

    def batch(grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(grams), *[pa.array(counts[:, i]) for i in range(3)]], ["gram", "toxic", "ordinary", "total"])

    for part in blocks(batches, "text"):
        row, _, gram, _ = events(part.column("text"))
        label = part.column("cls").to_numpy(zero_copy_only=False)[row] if len(row) else row
        packed = np.sort((gram << 2) | label)
        if len(packed) == 0:
            continue
        first = np.flatnonzero(np.r_[True, np.diff(packed) != 0])
        n = np.diff(np.r_[first, len(packed)])
        cls = packed[first] & 3
        held.append((packed[first] >> 2, np.stack([n * (cls == 1), n * (cls == 0), n], axis=1)))
        if len(held) >= 16:
            held = [merged()]
        if held and len(held[0][0]) > FLUSH:
            yield batch(*merged())
            held = []
    if held:
        yield batch(*merged())


def count(docs: DataFrame) -> DataFrame:
    """Counts of every gram over ``docs`` (text, cls: 1 toxic, 0 ordinary, 2 neither)."""
    out = docs.select("text", "cls").mapInArrow(_count, "gram long, toxic long, ordinary long, total long")
    return out.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("toxic", "ordinary", "total")])


def shared_model(counts: DataFrame) -> DataFrame:
    """gram (of ORDER-1 bytes), p: interpolated Kneser-Ney over continuation counts of all documents."""
    levels = {ORDER: counts.select("gram")}
    types = {}
    for n in range(ORDER - 1, 0, -1):
        types[n] = levels[n + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("k"))
        levels[n] = types[n].select("gram")
    p = None
    for n in range(1, ORDER):
        t = types[n].withColumn("ctx", F.shiftright("gram", 8))
        s = t.groupBy("ctx").agg(F.sum("k").alias("s"), F.count(F.lit(1)).alias("v"))
        t = t.join(s, "ctx")
        if p is None:
            low = F.lit(1 / 256)
        else:
            t = t.withColumn("low_gram", F.col("gram").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(p.select(F.col("gram").alias("low_gram"), F.col("p").alias("low")), "low_gram")
            low = F.col("low")
        p = t.select("gram", ((F.col("k") - DISCOUNT) / F.col("s") + DISCOUNT * F.col("v") / F.col("s") * low).alias("p"))
    return p


def ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, llr) of events seen in a class, and (gram: their context, llr) of backoff weights."""
    seen = counts.where(F.col("toxic") + F.col("ordinary") > 0).withColumn("ctx", F.shiftright("gram", 8))
    ctx = seen.groupBy("ctx").agg(*[e for c in ("toxic", "ordinary") for e in (F.sum(c).alias(f"s_{c}"), F.sum((F.col(c) > 0).cast("long")).alias(f"v_{c}"))])

    def left(c: str):
        return F.when(F.col(f"s_{c}") > 0, DISCOUNT * F.col(f"v_{c}") / F.col(f"s_{c}")).otherwise(1.0)

    def p(c: str):
        own = F.when(F.col(f"s_{c}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"s_{c}")).otherwise(0.0)
        return own + left(c) * F.col("p")

    full = (seen.join(ctx, "ctx").withColumn("low_gram", F.col("gram").bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1)))
            .join(shared_model(counts).withColumnRenamed("gram", "low_gram"), "low_gram"))
    return (full.select("gram", F.log(p("toxic") / p("ordinary")).alias("llr")),
            ctx.select(F.col("ctx").alias("gram"), F.log(left("toxic") / left("ordinary")).alias("llr")))


def _sorted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = rows.toArrow()
    gram, llr = (got.column(c).to_numpy() for c in ("gram", "llr"))
    order = np.argsort(gram)
    return gram[order], llr[order]


def model(counts: DataFrame, most: int = BROADCAST_GRAMS) -> Broadcast | DataFrame:
    """The two tables of :func:`ratios` sorted by gram, or if that is over ``most`` grams, (gram, llr) of every gram of ``counts``."""
    grams, contexts = ratios(counts)
    if counts.where(F.col("toxic") + F.col("ordinary") > 0).count() <= most:
        return counts.sparkSession.sparkContext.broadcast((_sorted(grams), _sorted(contexts)))
    # a context has at most 256 grams here, as each gram is one row
    every = counts.select("gram", F.shiftright("gram", 8).alias("ctx")).join(grams, "gram", "left").join(
        contexts.select(F.col("gram").alias("ctx"), F.col("llr").alias("_backoff")), "ctx", "left")
    return written(every.select("gram", F.coalesce("llr", "_backoff", F.lit(0.0)).alias("llr")), "toxicity-ratios")


def _found(table_: tuple[np.ndarray, np.ndarray], gram: np.ndarray) -> np.ndarray:
    """The number of each gram; NaN for one that the table lacks."""
    key, llr = table_
    if len(key) == 0:
        return np.full(len(gram), np.nan)
    at = np.minimum(np.searchsorted(key, gram), len(key) - 1)
    return np.where(key[at] == gram, llr[at], np.nan)


def with_ratios(docs: DataFrame, known: Broadcast | DataFrame) -> DataFrame:
    """``docs`` with ``_r``: the normalised log-likelihood ratios of each text."""
    if isinstance(known, DataFrame):
        return _joined_ratios(docs, known)

    def measure(text: pa.Array) -> pa.Array:
        by_gram, by_ctx = known.value
        row, word, gram, word_row = events(text)
        n = len(text)
        if len(row):
            distinct, which = np.unique(gram, return_inverse=True)
            llr = _found(by_gram, distinct)
            new = np.isnan(llr)
            llr[new] = np.nan_to_num(_found(by_ctx, distinct[new] >> 8))
            per_word, length = np.bincount(word, llr[which]), np.bincount(word)
            total = np.bincount(word_row, per_word, minlength=n) / np.maximum(np.bincount(row, minlength=n), 1)
            worst = np.zeros(n)
            np.maximum.at(worst, word_row, per_word / (length + 2))
            many = np.log1p(np.bincount(word_row, minlength=n))
        else:
            total = worst = many = np.zeros(n)
        return pa.StructArray.from_arrays([pa.array(np.asarray(x, dtype=np.float64)) for x in (total, worst, many)], FEATURES)

    return docs.withColumn("_r", scalar(measure, ", ".join(f"{f} double" for f in FEATURES))(F.col("text")))


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_id, word: every word of every text."""
    for part in blocks(batches, "text"):
        data, offsets = lowered(part.column("text"))
        flag = WORD_BYTE[data]
        start, end = runs(flag, offsets)
        cut = np.r_[0, np.cumsum(end - start)]
        word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cut.astype(np.int64).tobytes()), pa.py_buffer(data[flag].tobytes())])
        row = np.searchsorted(offsets, start, side="right") - 1
        yield pa.RecordBatch.from_arrays([part.column("_id").take(pa.array(row, pa.int64())), word.cast(pa.binary())], ["_id", "word"])


def _word_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """w, gram, n: the distinct grams of each word."""
    for part in blocks(batches, "word"):
        row, _, gram, _ = _events(*utf8(part.column("word").cast(pa.large_binary()).cast(pa.large_string())))
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])][: len(row)])
        n = np.diff(np.r_[first, len(row)])
        yield pa.RecordBatch.from_arrays([part.column("w").take(pa.array(row[first], pa.int64())), pa.array(gram[first]), pa.array(n, pa.int64())], ["w", "gram", "n"])


def _joined_ratios(docs: DataFrame, llr: DataFrame) -> DataFrame:
    """:func:`with_ratios` by shuffles: grams of distinct words are joined to ``llr``, and sums of words to the texts' words."""
    rows = written(docs.withColumn("_id", F.monotonically_increasing_id()), "toxicity-texts")
    words = rows.select("_id", "text").mapInArrow(_words, "_id long, word binary").groupBy("_id", "word").agg(F.count(F.lit(1)).alias("k"))
    words = written(words.withColumn("w", F.unhex(F.md5("word"))), "toxicity-words")
    grams = words.select("w", "word").dropDuplicates(["w"]).mapInArrow(_word_grams, "w binary, gram long, n long")
    sums = salted_join(grams, llr, ["gram"], "left").groupBy("w").agg(F.sum(F.col("n") * F.coalesce("llr", F.lit(0.0))).alias("s"))
    length = F.octet_length("word")
    by_text = salted_join(words, sums, ["w"], "left").groupBy("_id").agg(
        (F.sum(F.col("k") * F.col("s")) / F.sum(F.col("k") * length)).alias("per_byte"), F.greatest(F.max(F.col("s") / (length + 2)), F.lit(0.0)).alias("worst"),
        F.log1p(F.sum("k")).alias("log_words"))
    return rows.join(by_text, "_id", "left").withColumn("_r", F.struct(*[F.coalesce(f, F.lit(0.0)).alias(f) for f in FEATURES])).drop("_id", *FEATURES)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (intercept first) by Newton steps."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(a.shape[1])
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``docs`` (doc_id, text) with ``score``; labels come only from rows whose fold of 5 is not 0.

    Fold 1 fits the logistic weights, folds 2 to 4 give the class counts.
    """
    part = fold(F.col("doc_id"), 5)
    known = with_label(docs.select("doc_id", "text"), labels, label)
    cls = F.when(part >= 2, F.coalesce("y", F.lit(2))).otherwise(2).cast("long")
    counts = written(count(known.select("text", cls.alias("cls"))), "toxicity-counts")
    by_gram = model(counts, broadcast_grams)
    sample = with_ratios(known.where((part == 1) & F.col("y").isNotNull()), by_gram).select("y", "_r", F.xxhash64("doc_id").alias("h"), "doc_id")
    picked = sample.orderBy("h", "doc_id").limit(SAMPLE).select("y", "_r.*").toPandas()
    x, y = picked[FEATURES].to_numpy(float), picked["y"].to_numpy(float)
    rows = with_ratios(docs, by_gram)
    if len(y) == 0 or y.min() == y.max():
        return rows.withColumn("score", F.lit(float(y.mean()) if len(y) else 0.5)).drop("_r")
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    w = logistic((x - centre) / spread, y)
    z = F.lit(float(w[0])) + sum((F.col(f"_r.{f}") - float(centre[i])) / float(spread[i]) * float(w[i + 1]) for i, f in enumerate(FEATURES))
    return rows.withColumn("score", 1 / (1 + F.exp(-z))).drop("_r")


@query("op1_kneser_ney")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
