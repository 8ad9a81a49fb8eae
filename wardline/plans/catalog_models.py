"""Queries for features and models (M-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline import fixed_values as fv
from wardline.operators import detect, models
from wardline.operators.windows import sequence_features
from wardline.plans.catalog_text import sql_case
from wardline.plans.registry import query
from wardline.session import checkpoint


def _payload(t):
    p = F.col("sensor") == "process"
    return t.tele.withColumn("data", F.to_json(F.struct(
        F.when(p, F.col("value")).alias("cpu_percent"), F.when(p, F.concat(F.lit("x"), "k")).alias("memory_mb"), F.when(p, F.col("pid")).alias("num_threads"),
        F.when(p, F.col("name")).alias("cmdline"), F.when(F.col("sensor") == "network", F.col("k")).alias("total_connections"),
        F.when(F.col("sensor") == "file", F.col("pid")).alias("files_changed"), F.lit("z").alias("note"))))


@query("m01_domain_features", "M-01", """
    SELECT seq, CASE WHEN sensor = 'process' THEN value ELSE 0.0 END AS cpu_percent, 0.0::DOUBLE AS memory_mb, CASE WHEN sensor = 'process' THEN pid ELSE 0 END::DOUBLE AS num_threads, 0.0::DOUBLE AS lineage_depth FROM tele""")
def _(t):
    return models.domain_features(_payload(t), "process").select("seq", "cpu_percent", "memory_mb", "num_threads", "lineage_depth")


@query("m02_event_features", "M-02 M-03", f"""
    WITH c AS (SELECT seq, name, unnest(regexp_extract_all(name, '.')) AS ch FROM tele WHERE sensor = 'process'), f AS (SELECT seq, name, ch, count(*) AS k FROM c GROUP BY ALL),
    h AS (SELECT seq, round(sum(-(k / length(name)) * log2(k / length(name))), 4) AS e FROM f GROUP BY seq)
    SELECT event_id, coalesce(e, 0.0) AS cmdline_entropy, CASE WHEN sensor = 'process' THEN value ELSE 0.0 END AS cpu_percent, CASE WHEN sensor = 'eventlog' THEN 1 ELSE 0 END::DOUBLE AS data_field_count,
        CASE WHEN sensor = 'file' THEN pid ELSE 0 END::DOUBLE AS files_changed, {sql_case('severity', fv.SEVERITY_WEIGHT)}::DOUBLE AS severity_ordinal, CASE WHEN sensor = 'network' THEN k ELSE 0 END::DOUBLE AS total_connections
    FROM tele LEFT JOIN h USING (seq)""")
def _(t):
    m = models.feature_matrix(models.event_features(_payload(t)))
    return m.select("event_id", "cmdline_entropy", "cpu_percent", "data_field_count", "files_changed", "severity_ordinal", "total_connections")


@query("m04_isolation_forest", "M-04")
def _(t):
    model = models.IsolationForest.fit(t.embeddings, "embedding", "vec_id", contamination=0.01)
    return model.score(t.embeddings, "embedding").select("vec_id", "label", "score")


@query("m05_reconstruction_verify", "M-05")
def _(t):
    v = models.ReconstructionVerifier.fit(t.embeddings, "embedding", 64)
    return v.verify(t.embeddings, "embedding").select("vec_id", F.round("error", 9).alias("error"), "verified")


@query("m06_sequence_anomaly", "M-06")
def _(t):
    data = F.to_json(F.struct("pid", "name", F.when(F.col("sensor") == "network", F.col("remote_ip")).alias("ip")))
    seqs = sequence_features(t.tele.select("host", "ts_us", "seq", "event_type", "sensor", "severity", data.alias("data")), ["host"])
    return models.sequence_anomaly(seqs, ["host", "chunk"]).select("host", "chunk", "score", "class")


@query("m07_url_classifier", "M-07")
def _(t):
    # weak label: bait words and odd suffixes in the addresses of pages and queried names
    names = t.tele.select(F.concat(F.lit("http://"), "domain", F.lit("/")).alias("url")).distinct()
    rows = t.pages.select("url").distinct().unionByName(names).withColumn("truth", F.col("url").rlike(r"pills|cheap|\.xyz|zx\.com").cast("int"))
    rows = checkpoint(rows.where("url IS NOT NULL").withColumn("held_out", F.crc32(F.col("url").cast("binary")) % 5 == 0))
    model = models.url_classifier_fit(rows.where("NOT held_out"), "url", "truth")
    return models.url_classifier_predict(model, rows).select("url", "truth", "held_out", "label", F.round("p", 6).alias("p"), "confidence")


# a forest of 20 trees of depth 3 by rule: both versions are stored, the second is activated and rolled back
_NODE = {"feature": "({t} * 7 + {n} * 3) % 64", "cut": "(({t} * 5 + {n} * 11 + {v} * 13) % 21 - 10) / 100.0", "size": "1 + ({t} + {n}) % 9"}


def _go(n):
    """DuckDB: the child that an embedding takes at a node of version 1."""
    f, c = _NODE["feature"].format(t="t", n=n), _NODE["cut"].format(t="t", n=n, v=1)
    return f"2 * ({n}) + CASE WHEN e[{f} + 1]::DOUBLE <= ({c})::DOUBLE THEN 1 ELSE 2 END"


_PATH = "CASE WHEN {0} <= 1 THEN 0 WHEN {0} = 2 THEN 1 ELSE 2 * (ln({0} - 1) + 0.5772156649015329) - 2 * ({0} - 1) / ({0})::DOUBLE END"


@query("m08_model_registry", "M-08 M-04", f"""
    WITH a AS (SELECT vec_id, embedding AS e, unnest(range(20)) AS t FROM embeddings), b AS (SELECT *, {_go('0')} AS n1 FROM a), c AS (SELECT *, {_go('n1')} AS n2 FROM b),
    d AS (SELECT *, {_go('n2')} AS n3 FROM c), s AS (SELECT *, {_NODE['size'].format(t='t', n='n3')} AS size FROM d),
    p AS (SELECT vec_id, avg(3 + {_PATH.format('size')}) AS h FROM s GROUP BY vec_id)
    SELECT vec_id, 1 AS version, round(greatest(0.0, least(1.0, 0.5 - (0.5 - pow(2.0, -h / ({_PATH.format('256')}))))), 4)::DOUBLE AS score FROM p""")
def _(t):
    import uuid

    from wardline.session import checkpoint_folder

    spark, base = t.spark, f"{checkpoint_folder(t.spark)}/registry-{uuid.uuid4().hex}"
    for version in (1, 2):
        of = lambda name, v=version: F.expr(_NODE[name].format(t="tree", n="node", v=v))
        nodes = spark.range(20 * 15).select((F.col("id") % 20).cast("int").alias("tree"), F.floor(F.col("id") / 20).cast("int").alias("node"))
        inner = F.col("node") < 7
        nodes = nodes.select(F.lit(version).alias("version"), "tree", "node", F.when(inner, of("feature")).otherwise(-1).cast("int").alias("feature"), of("cut").cast("double").alias("cut"),
                             (2 * F.col("node") + 1).alias("lo"), (2 * F.col("node") + 2).alias("hi"), F.when(inner, 0).otherwise(of("size")).cast("int").alias("size"))
        models.store_forest(nodes, f"{base}/nodes")
        models.register_model(spark, f"{base}/registry", "isolation_forest", {}, f"{base}/nodes", version)
    models.rollback_model(spark, f"{base}/registry")
    now = models.active_version(models.read_registry(spark, f"{base}/registry"))
    model = models.load_forest(spark, now["path"], now["version"])
    return model.score(t.embeddings, "embedding").select("vec_id", F.lit(now["version"]).alias("version"), "score")


@query("m09_anomaly_cascade", "M-09 M-04 M-05")
def _(t):
    rows = t.embeddings.select("vec_id", "embedding", F.concat(F.lit("evt-"), "vec_id").alias("event_id"), F.col("vec_id").alias("seq"),
                               (F.col("vec_id") * 1000000).alias("ts_us"), F.lit("h").alias("host"), F.lit("process").alias("sensor"))
    scored = models.IsolationForest.fit(rows, "embedding", "vec_id").score(rows, "embedding")
    suspects = models.ReconstructionVerifier.fit(rows, "embedding", 64).verify(scored.where("score >= 0.4"), "embedding")
    return detect.anomaly_cascade(suspects).select("event_id", "alert_type", "severity", "confidence")
