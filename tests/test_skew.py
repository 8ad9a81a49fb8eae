"""Hot keys, repeated ids and sizes of dimensions must not change results."""

import time

from pyspark.sql import functions as F

from wardline.operators import joins
from wardline.operators.graph import process_tree
from wardline.operators.segmented import salted_join, trailing_count


def test_indicator_hits_do_not_depend_on_the_table_size(spark, monkeypatch):
    events = spark.createDataFrame([(None, "1.1.1.1", None), ("e", "1.1.1.1", "2.2.2.2"), ("e", None, "9.9.9.9"), ("e", "2.2.2.2", "1.1.1.1"), (None, "", None)],
                                   "event_id string, dst_ip string, src_ip string")
    iocs = spark.createDataFrame([("1.1.1.1", "ip", 1, "a", "high"), ("2.2.2.2", "ip", 2, "b", "low")], "value string, ioc_type string, first_us long, source string, severity string")
    found = {}
    for name, few in (("small", True), ("large", False)):
        monkeypatch.setattr(joins, "bounded_broadcast", lambda df, few=few: ((F.broadcast(df) if few else df), few))
        rows = joins.enrich_network(events, iocs, "event_id").collect()
        found[name] = sorted([repr(tuple(r)) for r in rows])
    assert found["small"] == found["large"] and len(found["small"]) == 5
    assert sum("True" in r for r in found["small"]) == 3


def test_trailing_count_matches_definition(spark):
    rows = [("a", 0), ("a", 0), ("a", 59), ("a", 60), ("a", 61), ("a", 119), ("b", 60), (None, 5), (None, 60), ("a", -1), ("a", None)]
    df = spark.createDataFrame(rows, "k string, t long")
    for include, reach in ((False, 59), (True, 60)):
        got = sorted((repr(r.k), r.t, r.n) for r in trailing_count(df, ["k"], "t", 60, "n", include).collect())
        want = sorted((repr(k), t, sum(1 for j, u in rows if j == k and u is not None and t - reach <= u <= t)) for k, t in rows if t is not None)
        assert got == want


def test_trailing_count_of_one_hot_key(spark):
    df = spark.range(300_000).select(F.lit("k").alias("k"), (F.col("id") * 180).alias("t"))
    start = time.time()
    assert trailing_count(df, ["k"], "t", 60_000_000, "n").agg(F.max("n")).first()[0] == 300_000
    assert time.time() - start < 30


def test_process_tree_with_repeated_pids(spark):
    rows = [("h", 1, 0, 1), ("h", 2, 1, 2), ("h", 2, 3, 5), ("h", 3, 1, 3), ("h", 3, 1, 4), ("h", 4, 2, 6)]
    got = sorted((r.pid, r.depth) for r in process_tree(spark.createDataFrame(rows, "host string, pid long, ppid long, ts_us long")).collect())
    assert got == [(1, 0), (2, 2), (2, 2), (3, 1), (3, 1), (4, 3)]


def test_copies_of_a_salted_side_are_never_broadcast(spark):
    """The estimate of a side leaves out that it is repeated once a salt."""
    left, right = spark.range(50).withColumnRenamed("id", "k"), spark.range(50).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    joined = salted_join(left, right, ["k"])
    assert "Broadcast" not in joined._jdf.queryExecution().sparkPlan().toString()
    assert joined.count() == 50


def test_registered_queries_broadcast_by_measured_sizes_only(spark, tmp_path):
    from wardline.plans.registry import Query

    spark.range(3).write.parquet(str(tmp_path / "part.parquet"))
    plan = lambda t: t.part.join(t.part.groupBy("id").agg(F.count("*").alias("n")), "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        joined = Query("x", (), plan, None)(spark, str(tmp_path))
        assert "Broadcast" not in joined._jdf.queryExecution().sparkPlan().toString()
        assert joined.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_estimates_of_checkpoints_do_not_multiply(spark):
    """A loop that joins a checkpoint with itself must not square the planner's estimate every round."""
    from wardline.session import checkpoint

    df = checkpoint(spark.range(10))
    for _ in range(6):
        df = checkpoint(df.join(df.withColumnRenamed("id", "other"), F.col("id") == F.col("other")).select("id"))
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1_000_000
    assert df.count() == 10


def test_incidents_along_a_long_chain(spark):
    """Alerts a second apart share an entity with the next one only: one incident, found in few rounds."""
    from wardline.operators.correlate import connected_components, correlate_alerts

    n = 3000
    shared = F.transform(F.sequence(F.col("id"), F.col("id") + 1), lambda i: F.concat(F.lit("ip:"), i.cast("string")))
    rows = spark.range(n).select(F.lit("h").alias("host"), F.concat(F.lit("a"), (F.col("id") * 7919 % n).cast("string")).alias("alert_id"), (F.col("id") * 1_000_000).alias("ts_us"),
                                 F.col("id").alias("seq"), F.lit("s").alias("sensor"), F.array().cast("array<string>").alias("mitre_ids"), shared.alias("entities"))
    start = time.time()
    got = correlate_alerts(rows, "components").groupBy("incident_id").count().collect()
    assert [(r.incident_id, r["count"]) for r in got] == [("inc-a0", n)]
    assert time.time() - start < 90
    lone = connected_components(spark.range(4), spark.createDataFrame([(1, 2), (2, 2), (None, 3)], "a long, b long"))
    assert sorted((r.id, r.component) for r in lone.collect()) == [(0, 0), (1, 1), (2, 1), (3, 3)]


def test_incidents_with_ties_gaps_and_nulls(spark):
    """Runs are cut by gaps above the window, ties meet, and rows without time, host or id link as before."""
    from wardline.operators.correlate import correlate_alerts

    w = 300_000_000
    rows = [("h", "a", 0), ("h", "b", 0), ("h", "c", w), ("h", "d", 2 * w + 1), ("h", "e", None), ("h", None, 2 * w + 2), ("h", "f", 2 * w + 3), (None, "g", 5), (None, "i", 6), ("h", "b", 0)]
    df = spark.createDataFrame([(*r, 1, "s", [], ["x"]) for r in rows], "host string, alert_id string, ts_us long, seq long, sensor string, mitre_ids array<string>, entities array<string>")
    got = sorted((r.alert_id, r.incident_id) for r in correlate_alerts(df, "components").collect())
    assert got == [("a", "inc-a"), ("b", "inc-a"), ("c", "inc-a"), ("d", "inc-d"), ("e", "inc-e"), ("f", "inc-f"), ("g", "inc-g"), ("i", "inc-g")]


def test_few_but_wide_rows_are_not_broadcast(spark):
    from wardline.operators.segmented import bounded_broadcast, dimension_join

    dim = spark.range(300).select(F.col("id").alias("k"), F.struct(F.repeat(F.lit("x"), F.lit(100)).alias("v")).alias("s"))
    assert bounded_broadcast(dim, max_bytes=100_000)[1] and bounded_broadcast(dim.limit(0))[1]
    assert not bounded_broadcast(dim, max_bytes=20_000)[1] and not bounded_broadcast(dim, 299)[1]
    assert dimension_join(spark.range(400).withColumnRenamed("id", "k"), dim, ["k"], "left").where("s IS NOT NULL").count() == 300


def test_known_findings_are_made_once(spark):
    """However often ``dispatch`` reads them, the plans that find them run once."""
    from wardline.operators import detect

    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    events = spark.createDataFrame([("e1", 1, 1, "h", "s", "x"), ("e2", 2, 2, "h", "s", "x")], "event_id string, ts_us long, seq long, host string, sensor string, event_type string")
    patterns = spark.createDataFrame([("e1", None, None), ("e9", "d", 0.5)], "event_id string, description string, confidence double").mapInArrow(seen, "event_id string, description string, confidence double")
    rule = dict(id="none", severity="low", mitre=["T1"], sensor="", event_type="none", conditions=[("host", "eq", "none")])
    out = detect.dispatch(events, detect.pattern_findings(patterns), rule_set=[rule])
    assert [(r.event_id, r.stage, r.severity) for r in out.collect()] == [("e1", "pattern", "high")]
    assert runs.value == 2
