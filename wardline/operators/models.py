"""Feature tables and models (M-*)."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wardline import fixed_values as fv
from wardline.functions.names import url_features
from wardline.functions.scoring import payload_get, severity_weight
from wardline.functions.text import char_entropy
from wardline.session import checkpoint, forget


# --- features ----------------------------------------------------------------------------
def _number(data: str, name: str) -> Column:
    return F.coalesce(payload_get(F.col(data), name).try_cast("double"), F.lit(0.0))


def domain_features(events: DataFrame, domain: str, data: str = "data") -> DataFrame:
    """The fixed features of a domain in order; missing or non-numeric values are 0."""
    return events.select("*", *[_number(data, f).alias(f) for f in fv.DOMAIN_FEATURES[domain]])


def assemble(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid="keep").transform(df)


def event_features(events: DataFrame, data: str = "data") -> DataFrame:
    """(event_id, feature, value) rows of each event by its sensor, plus severity and time."""
    pair = lambda n, v: F.struct(F.lit(n).alias("feature"), v.cast("double").alias("value"))
    by_sensor = {s: [pair(f, _number(data, f)) for f in names] for s, names in fv.EVENT_FEATURES.items()}
    by_sensor["process"].append(pair("cmdline_entropy", char_entropy(F.coalesce(payload_get(F.col(data), "cmdline"), F.lit("")))))
    fields = F.size(F.json_object_keys(data))
    chosen = F.coalesce(*[F.when(F.col("sensor") == s, F.array(*p)) for s, p in by_sensor.items()],
                        F.array(pair("data_field_count", fields)))
    common = F.array(pair("severity_ordinal", severity_weight(F.col("severity"))), pair("timestamp", F.col("ts_us") / 1e6))
    return events.select("event_id", F.inline(F.concat(chosen, common)))


def feature_matrix(rows: DataFrame, names: list[str] | None = None, key: str = "event_id") -> DataFrame:
    """One column per feature name in sorted order, 0 where absent."""
    if names is None:
        names = [r[0] for r in rows.select("feature").distinct().limit(1001).collect()]
        if len(names) > 1000:
            raise ValueError("more than 1000 feature names")
    names = sorted(names)
    return rows.groupBy(key).pivot("feature", names).agg(F.first("value")).na.fill(0.0, names).select(key, *names)


# --- isolation forest -----------------------------------------------------------------------
def _average_path(n):
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + 0.5772156649015329) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator):
    """Arrays (feature, split, left, right, size) of one random isolation tree."""
    feature, split, left, right, size = [], [], [], [], []

    def node(rows, depth):
        at = len(size)
        for a, v in ((feature, -1), (split, 0.0), (left, -1), (right, -1), (size, len(rows))):
            a.append(v)
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            return at
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        goes_left = x[rows, f] <= cut
        if goes_left.all():  # rounding put the cut on the maximum
            return at
        feature[at], split[at] = f, cut
        left[at] = node(rows[goes_left], depth + 1)
        right[at] = node(rows[~goes_left], depth + 1)
        return at

    node(np.arange(len(x)), 0)
    return feature, split, left, right, size


class IsolationForest:
    """Trees grown from per-tree samples in tasks, scored by an Arrow function.

    The model is at most ``trees`` × 511 nodes, so it travels with the scoring
    function; training rows never reach the driver.
    """

    def __init__(self, trees: list[tuple], sample: int, offset: float = -0.5) -> None:
        self.trees, self.sample, self.offset = trees, sample, offset

    @staticmethod
    def fit(df: DataFrame, vector: str, row_id: str, trees: int = 100, sample: int = 256, seed: int = 42,
            contamination: float | None = None, min_rows: int = 50) -> "IsolationForest":
        """``vector`` is ARRAY<DOUBLE>.  Each tree sees up to ``sample`` rows chosen by hash."""
        n = df.count()
        if n < min_rows:
            raise ValueError(f"need at least {min_rows} rows, got {n}")
        unit = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 40)) / float(1 << 40)
        share = min(1.0, 1.5 * sample / n)
        base = df.select(row_id, F.col(vector).cast("array<double>").alias("v"))
        # every (row, tree) is drawn by itself, whatever the row count
        drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: unit(row_id, tree, F.lit(seed)) < share)
        picked = base.withColumn("tree", F.explode(drawn))
        limit = math.ceil(math.log2(sample))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(row_id)
            tree = int(pdf["tree"].iloc[0])
            rng = np.random.default_rng(seed * 1000 + tree)
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            x = x[rng.permutation(len(x))[:sample]]
            f, s, a, b, c = _grow(x, limit, rng)
            return pd.DataFrame({"tree": [tree], "f": [f], "s": [s], "a": [a], "b": [b], "c": [c]})

        grown = picked.groupBy("tree").applyInPandas(grow, "tree int, f array<int>, s array<double>, a array<int>, b array<int>, c array<int>")
        model = IsolationForest([tuple(map(np.array, (r.f, r.s, r.a, r.b, r.c))) for r in grown.orderBy("tree").collect()], min(sample, n))
        if contamination is not None:
            raw = df.select(model.score_samples(F.col(vector).cast("array<double>")).alias("s"))
            model.offset = raw.agg(F.percentile_approx("s", contamination, 100000)).first()[0]
        return model

    def score_samples(self, vector: Column) -> Column:
        trees, norm = self.trees, float(_average_path(np.array([self.sample]))[0]) or 1.0

        @F.pandas_udf(DoubleType())
        def score(batch: pd.Series) -> pd.Series:
            if len(batch) == 0:
                return pd.Series([], dtype="float64")
            x = np.stack(batch.to_numpy()).astype(float)
            total = np.zeros(len(x))
            for f, s, a, b, c in trees:
                at, depth = np.zeros(len(x), dtype=int), np.zeros(len(x))
                moving = f[at] >= 0
                while moving.any():
                    i = np.flatnonzero(moving)
                    here = at[i]
                    at[i] = np.where(x[i, f[here]] <= s[here], a[here], b[here])
                    depth[i] += 1
                    moving = f[at] >= 0
                total += depth + _average_path(c[at])
            return pd.Series(-np.power(2.0, -(total / len(trees)) / norm))

        return score(vector)

    def score(self, df: DataFrame, vector: str, name: str = "score") -> DataFrame:
        """Anomaly score in [0, 1]: 0.5 minus the decision value, clamped."""
        decision = self.score_samples(F.col(vector).cast("array<double>")) - F.lit(self.offset)
        return df.withColumn(name, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 - decision)), 4))


def sequence_anomaly(features: DataFrame, keys: list[str], min_sequences: int = 30, trees: int = 100) -> DataFrame:
    """Isolation-forest scores of sequence features (W-09)."""
    from wardline.functions.scoring import anomaly_class

    columns = [c for c in features.columns if c not in keys]
    rows = features.withColumn("_v", F.array(*[F.col(c).cast("double") for c in columns])).withColumn("_id", F.xxhash64(*keys))
    model = IsolationForest.fit(rows, "_v", "_id", trees=trees, contamination=0.02, min_rows=min_sequences)
    return model.score(rows, "_v").withColumn("class", anomaly_class(F.col("score"))).drop("_v", "_id")


# --- reconstruction ----------------------------------------------------------------------------
class ReconstructionVerifier:
    """Rows that a low-dimensional linear model cannot rebuild are anomalies."""

    def __init__(self, model: PipelineModel, width: int, threshold: float) -> None:
        self.model, self.width, self.threshold = model, width, threshold

    @staticmethod
    def fit(df: DataFrame, vector: str, width: int, latent: int = 8, threshold: float | None = None, min_rows: int = 50) -> "ReconstructionVerifier":
        n = df.count()
        if n < min_rows:
            raise ValueError(f"need at least {min_rows} rows, got {n}")
        pipeline = Pipeline(stages=[
            StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=False),
            PCA(k=min(latent, width), inputCol="_z", outputCol="_p")])
        model = pipeline.fit(df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_x")))
        out = ReconstructionVerifier(model, width, 0.0)
        if threshold is None:
            mean, std = out.errors(df, vector).agg(F.avg("error"), F.stddev_pop("error")).first()
            threshold = mean + 2.0 * std
        out.threshold = threshold
        return out

    def errors(self, df: DataFrame, vector: str) -> DataFrame:
        """Mean squared error; components are orthonormal, so it is the norm they leave over."""
        rows = self.model.transform(df.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>"))))
        norm = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, v: a + v * v)
        return rows.withColumn("error", F.greatest(F.lit(0.0), (norm("_z") - norm("_p")) / self.width)).drop("_x", "_z", "_p")

    def verify(self, df: DataFrame, vector: str) -> DataFrame:
        return self.errors(df, vector).withColumn("verified", F.col("error") > self.threshold)


# --- URL classifier ------------------------------------------------------------------------------
def url_feature_table(df: DataFrame, url: str = "url") -> DataFrame:
    f = url_features(F.col(url))
    return df.select("*", F.array(*f.values()).alias("_v")).withColumn("features", array_to_vector("_v")).drop("_v")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def url_classifier_fit(labelled: DataFrame, url: str = "url", label: str = "label", trees: int = 200, depth: int = 20, min_rows: int = 100):
    """Random forest on the 22 lexical features.

    Rows are few bytes and much work, so they are dealt by number, not by size.  Features are made once.
    """
    dealt = checkpoint(labelled.select(url, label).repartition(_tasks(labelled)))
    n = dealt.count()
    if n < min_rows:
        raise ValueError(f"need at least {min_rows} rows, got {n}")
    rows = checkpoint(url_feature_table(dealt, url).select("features", F.col(label).cast("double").alias("label")))
    parts = max(min(-(-n // 1000), 64), -(-n // 50_000))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=42, featuresCol="features", labelCol="label").fit(rows.repartition(parts))
    forget(dealt, rows)
    return model


def url_classifier_predict(model, df: DataFrame, url: str = "url") -> DataFrame:
    """Probability, label (malicious ≥ 0.7, suspicious ≥ 0.5) and confidence."""
    p = vector_to_array("probability")[1]
    out = model.transform(url_feature_table(df.repartition(_tasks(df)), url)).withColumn("p", p)
    label = F.when(F.col("p") >= 0.7, "malicious").when(F.col("p") >= 0.5, "suspicious").otherwise("benign")
    return out.select(*df.columns, "p", label.alias("label"), F.round(F.greatest("p", 1 - F.col("p")), 4).alias("confidence"))


# --- registry ------------------------------------------------------------------------------------
REGISTRY = "seq BIGINT, version INT, previous INT, model_type STRING, metrics STRING, path STRING, at_us BIGINT"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(REGISTRY).parquet(path)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], REGISTRY)
        raise


def active_version(registry: DataFrame):
    """The row activated last, or None."""
    return registry.orderBy(F.desc("seq")).first()


def score_metrics(scored: DataFrame, n_features: int, score: str = "score") -> dict:
    row = scored.agg(F.avg(score), F.stddev_pop(score), F.count(F.lit(1))).first()
    return {"mean_score": row[0], "std_score": row[1], "n_samples": row[2], "n_features": n_features}


def register_model(spark: SparkSession, registry_path: str, model_type: str, metrics: dict, model_path: str, at_us: int) -> int:
    """Append the next version and make it active."""
    reg = read_registry(spark, registry_path)
    top = reg.agg(F.max("version"), F.max("seq")).first()
    now = active_version(reg)
    version, seq = (top[0] or 0) + 1, (top[1] or 0) + 1
    row = [(seq, version, now["version"] if now else None, model_type, json.dumps(metrics), model_path, at_us)]
    spark.createDataFrame(row, REGISTRY).coalesce(1).write.mode("append").parquet(registry_path)
    return version


def rollback_model(spark: SparkSession, registry_path: str) -> int:
    """Make the version before the active one active again."""
    reg = read_registry(spark, registry_path)
    now = active_version(reg)
    if now is None or now["previous"] is None:
        raise RuntimeError("no previous model version")
    back = reg.where(F.col("version") == now["previous"]).orderBy("seq").first()
    row = [(now["seq"] + 1, *[back[c] for c in ("version", "previous", "model_type", "metrics", "path", "at_us")])]
    spark.createDataFrame(row, REGISTRY).coalesce(1).write.mode("append").parquet(registry_path)
    return back["version"]


FOREST = "version INT, tree INT, node INT, feature INT, cut DOUBLE, lo INT, hi INT, size INT"


def forest_rows(spark: SparkSession, model: IsolationForest, version: int) -> DataFrame:
    """The nodes of a forest as rows; a leaf has feature -1, an inner node goes to ``lo`` up to its cut, else to ``hi``."""
    rows = [(version, t, n, int(f[n]), float(s[n]), int(a[n]), int(b[n]), int(c[n])) for t, (f, s, a, b, c) in enumerate(model.trees) for n in range(len(f))]
    return spark.createDataFrame(rows, FOREST)


def store_forest(nodes: DataFrame, path: str) -> None:
    """Keep a version's nodes beside those of the others; a version stored again replaces itself."""
    nodes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_forest(spark: SparkSession, path: str, version: int, sample: int = 256, offset: float = -0.5, most: int = 1_000_000) -> IsolationForest:
    """A stored version as a model; trees are small by construction, and more than ``most`` nodes are an error."""
    nodes = spark.read.schema(FOREST).parquet(path).where(F.col("version") == version).orderBy("tree", "node").limit(most + 1).toPandas()
    if len(nodes) == 0 or len(nodes) > most:
        raise ValueError(f"version {version} has {len(nodes)} nodes")
    trees = [tuple(t[c].to_numpy() for c in ("feature", "cut", "lo", "hi", "size")) for _, t in nodes.groupby("tree", sort=True)]
    return IsolationForest(trees, sample, offset)
