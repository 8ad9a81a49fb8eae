"""Ordered operators against plain Python, with random order and a hot key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline import fixed_values as fv
from wardline.operators import aggregates as agg
from wardline.operators import correlate, graph, memory, snapshots
from wardline.operators import windows as win
from wardline.operators.quantiles import grouped_median
from wardline.operators.segmented import gap_islands, salted_join, segmented_scan, trailing_count

S = 1_000_000


def rows(spark, data, schema):
    data = list(data)
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def hot(spark):
    """Key h holds most rows, some at the same instant."""
    r = random.Random(7)
    data = [("h" if r.random() < 0.8 else f"k{r.randrange(4)}", r.randrange(3000) * S // 2, i, r.choice([None, r.randrange(100)])) for i in range(900)]
    return data, rows(spark, data, "k string, ts_us bigint, seq bigint, v int")


def test_segmented_scans(hot):
    data, df = hot
    out = segmented_scan(df, ["k"], F.floor(F.col("ts_us") / (20 * S)).cast("bigint"), ["ts_us", "seq"], {
        "prev": ("lag", F.col("ts_us")), "total": ("sum", F.coalesce("v", F.lit(0))), "last_v": ("last", F.col("v")), "top": ("max", F.col("v")), "n": ("count", F.lit(1))})
    want = {}
    for key in {d[0] for d in data}:
        prev = last = top = None
        total = n = 0
        for k, ts, seq, v in sorted((d for d in data if d[0] == key), key=lambda d: d[1:3]):
            total, n = total + (v or 0), n + 1
            last = v if v is not None else last
            top = v if top is None else (top if v is None else max(top, v))
            want[seq] = (prev, total, last, top, n)
            prev = ts
    assert {r.seq: (r.prev, r.total, r.last_v, r.top, r.n) for r in out.collect()} == want


def test_islands_and_trailing_counts(hot):
    data, df = hot
    got = {r.seq: r.island for r in gap_islands(df, ["k"], "ts_us", "seq", 2 * S).collect()}
    counts = {r.seq: r.c for r in trailing_count(df, ["k"], "ts_us", 60 * S, "c").collect()}
    for key in {d[0] for d in data}:
        island, prev = 0, None
        mine = sorted((d for d in data if d[0] == key), key=lambda d: d[1:3])
        for _, ts, seq, _ in mine:
            island += prev is None or ts - prev >= 2 * S
            prev = ts
            assert got[seq] == island
            assert counts[seq] == sum(1 for d in mine if ts - 60 * S < d[1] <= ts)


def test_salted_join_equals_join(spark, hot):
    _, df = hot
    dim = spark.createDataFrame([("h", 1), ("k1", 2)], "k string, w int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a = sorted(map(tuple, salted_join(df, dim, ["k"], how).select(*df.columns).collect()), key=repr)
        b = sorted(map(tuple, df.join(dim, "k", how).select(*df.columns).collect()), key=repr)
        assert a == b


@pytest.mark.parametrize("values", [[5], [1, 2], [3, 3, 3, 9], [0, 1 << 40, (1 << 40) + 1], list(range(0, 70000, 7))])
def test_median(spark, values):
    df = spark.createDataFrame([("a", v, 1) for v in values], "k string, v bigint, n bigint").groupBy("k", "v").agg(F.sum("n").alias("n"))
    assert grouped_median(df, ["k"], "v", "n").first()["median"] == float(np.median(values))


def alert_rows(pairs):
    return [(f"a{i}", "h", "network", k, t * S, i, "low") for i, (k, t) in enumerate(pairs)]


ALERT = "alert_id string, host string, sensor string, alert_type string, ts_us bigint, seq bigint, severity string"


def test_dedup_refreshes_the_timer(spark):
    df = rows(spark, alert_rows([("K", 0), ("K", 30), ("K", 80), ("K", 150), ("L", 10)]), ALERT)
    got = sorted((r.alert_type, r.ts_us // S, r.run_count) for r in win.dedup_alerts(df).collect())
    assert got == [("K", 0, 3), ("K", 150, 1), ("L", 10, 1)]


def test_dedup_gap_of_exactly_60s_passes(spark):
    data = [("a", "h", "network", "K", t, i, "low") for i, t in enumerate((0, 60 * S, 120 * S - 1))]
    df = rows(spark, data, ALERT)
    assert sorted(r.ts_us for r in win.dedup_alerts(df).collect()) == [0, 60 * S]
    once = win.dedup_alerts(df).drop("run_count")
    assert sorted(r.ts_us for r in win.dedup_alerts(once).collect()) == [0, 60 * S]


def test_beacon(spark):
    r = random.Random(42)
    data = [("a", 1000 * S + i * 60 * S, i) for i in range(12)] + [("b", i * 60 * S, i) for i in range(9)] + [("c", int((1000 + 60 * i + r.uniform(-3, 3)) * S), i) for i in range(20)] + [("d", 5, i) for i in range(12)]
    out = {x.dest: x for x in win.beacon_stats(rows(spark, data, "dest string, ts_us bigint, seq bigint"), ["dest"]).collect()}
    assert set(out) == {"a", "c", "d"}
    a = out["a"]
    assert (a.cv, a.share, a.score, a.is_beacon, a.median_interval) == (0.0, 1.0, 1.0, True, 60.0)
    assert out["c"].is_beacon and not out["d"].is_beacon
    gaps = np.diff(sorted(t for d, t, _ in data if d == "c"))
    assert out["c"].cv == pytest.approx(gaps.std() / np.median(gaps))


def test_fft_finds_the_period(spark):
    data = [("a", i * 10 * S, i) for i in range(120)] + [("b", t * S, t) for t in random.Random(3).sample(range(1200), 100)]
    out = {r.dest: r for r in win.fft_periodicity(rows(spark, data, "dest string, ts_us bigint, seq bigint"), ["dest"]).collect()}
    assert out["a"].periodic and not out["b"].periodic
    ratio = 10 / out["a"].dominant_period  # a pulse train peaks at the period or a harmonic
    assert abs(ratio - round(ratio)) < 0.02


def chains_of(events, window=300):
    found = []
    for name, (pattern, _) in fv.LOG_CHAINS.items():
        idx, first = 0, None
        for code, t in events:
            if code == pattern[idx]:
                first = t if idx == 0 else first
                idx += 1
                if idx == len(pattern):
                    if t - first <= window:
                        found.append((name, first, t))
                    idx = 0
    return sorted(found)


@pytest.mark.parametrize("events", [[(4625, 0), (4625, 10), (4672, 20)], [(4625, 0), (4625, 10), (4672, 400)], "random"])
def test_log_chains(spark, events):
    if events == "random":
        r = random.Random(5)
        events = sorted(((r.choice([4625, 4672, 4688, 7045, 4720, 4732, 4724, 4104, 1]), i * 7 + r.randrange(7)) for i in range(300)), key=lambda e: e[1])
    df = rows(spark, [("h", t * S, i, c) for i, (c, t) in enumerate(events)], "host string, ts_us bigint, seq bigint, code int")
    got = sorted((r.chain, r.first_us // S, r.last_us // S) for r in win.eventlog_chains(df, segment_us=60 * S).collect())
    assert got == chains_of(events)


def test_drift(spark):
    data = [(f, i, i, float(v)) for f, vs in {"up": [1, 1, 5, 5], "flat": [1, 1, 1, 1], "short": [1, 2, 3]}.items() for i, v in enumerate(vs)]
    out = {r.feature: r.drifted for r in win.drift_check(rows(spark, data, "feature string, ts_us bigint, seq bigint, value double"), 2).collect()}
    assert out == {"up": True, "flat": False}


def test_reputation(spark):
    data = [("a", 0, 0, -5.0)] + [("a", i * 40 * S, i, 10.0) for i in range(1, 7)]
    df = rows(spark, data, "address string, ts_us bigint, seq bigint, delta double")
    for n, want in enumerate((45, 55, 65, 75, 85, 95, 100), 1):
        assert agg.reputation_fold(df.where(F.col("seq") < n)).first()["score"] == want
    r = random.Random(9)
    steps = [("b", i * 25 * S, i, float(r.choice([-30, -10, 10, 25]))) for i in range(200)]
    score = 50.0
    for s in steps:
        score = min(100.0, max(0.0, score + s[3]))
    assert agg.reputation_fold(rows(spark, steps, "address string, ts_us bigint, seq bigint, delta double")).first()["score"] == score
    # a busy address in one minute, dealt over tasks, in blocks of two
    hot = [("c", i, i % 3, s[3]) for i, s in enumerate(steps)] + [(None, 5, 0, 10.0)]
    many = rows(spark, hot, "address string, ts_us bigint, seq bigint, delta double")
    got = {x.address: x for x in agg.reputation_fold(many, block_bits=1).collect()}
    assert (got["c"].score, got["c"].total_connections, got["c"].first_us, got["c"].last_us) == (score, 200, 0, 199)
    assert (got[None].score, got[None].total_connections) == (60.0, 1)


def test_feedback_and_feeds(spark):
    fb = [("x", "n", "dismiss")] * 3 + [("y", "n", "dismiss")] * 3 + [("y", "n", "investigate")] + [("z", "n", "dismiss")]
    out = {r.alert_type: r.multiplier for r in agg.feedback_multiplier(rows(spark, fb, "alert_type string, sensor string, action string")).collect()}
    assert out == {"x": 0.5, "y": 0.75, "z": 1.0}
    runs = rows(spark, [("f", 1, 0, 1, 4, ""), ("g", 2, 0, 0, 0, "bad")], "feed_name string, run_id int, ts_us bigint, ok int, n_iocs bigint, error string")
    assert {r.feed_name: r.is_stale for r in agg.feed_health(runs, 7200 * S).collect()} == {"f": False, "g": True}
    assert {r.feed_name: r.state for r in agg.feed_health(runs, 7201 * S).collect()} == {"f": "stale", "g": "errored"}


def test_next_technique(spark):
    chains = spark.createDataFrame([(0, 0, "A"), (0, 1, "B"), (1, 0, "A"), (1, 1, "B"), (2, 0, "A"), (2, 1, "C")], "chain_id int, pos int, technique_id string")
    alerts = spark.createDataFrame([("x", ["Z", "A"]), ("y", [])], "alert_id string, mitre_ids array<string>")
    got = {r.next_technique: round(r.probability, 4) for r in win.next_technique(alerts, chains).collect()}
    assert got == {"B": 0.6608, "C": 0.3392}


def test_lineage(spark):
    df = spark.createDataFrame([("h", 1, 0), ("h", 2, 1), ("h", 3, 2), ("h", 9, 9), ("h", 8, 77), ("h", 20, 21), ("h", 21, 22), ("h", 22, 20), ("h", 30, 22), ("h", 31, 30)], "host string, pid bigint, ppid bigint")
    got = {r.pid: (r.depth, r.in_cycle) for r in graph.hierarchy(df).collect()}
    assert got == {1: (0, False), 2: (1, False), 3: (2, False), 9: (0, False), 8: (0, False), 20: (0, True), 21: (0, True), 22: (0, True), 30: (1, False), 31: (2, False)}


def test_deep_lineage(spark):
    df = spark.createDataFrame([("h", i, i - 1) for i in range(1, 300)], "host string, pid bigint, ppid bigint")
    assert {r.pid: r.depth for r in graph.lineage_depth(df).collect()} == {i: i - 1 for i in range(1, 300)}


def test_threads(spark):
    m = spark.createDataFrame([(1, 100, 100), (1, 150, 10)], "pid int, base bigint, size bigint")
    t = spark.createDataFrame([(1, i, a) for i, a in enumerate((0, 100, 199, 200, 99))], "pid int, thread_id bigint, start_address bigint")
    assert sorted(r.start_address for r in memory.thread_outside_modules(m, t, block=64).collect()) == [99, 200]


def ransom_graph(spark, n, span):
    ev = [("p", "h", 0, 0, "process", "process_new", 7, 0, "x.exe", "c:\\x.exe", None, None)]
    ev += [(f"f{i}", "h", 1 + int(i * span * S / max(n - 1, 1)), i + 1, "file", "file_change", 7, 0, None, None, f"c:\\d\\{i}.txt", None) for i in range(n)]
    df = rows(spark, ev, "event_id string, host string, ts_us bigint, seq bigint, sensor string, event_type string, pid int, ppid int, name string, exe string, path string, cmdline string")
    nodes = graph.build_nodes(df)
    return nodes, graph.build_edges(nodes)


@pytest.mark.parametrize("n,span,match", [(50, 60, 1), (49, 60, 0), (50, 61, 0)])
def test_ransomware(spark, n, span, match):
    assert graph.chain_ransomware(*ransom_graph(spark, n, span)).count() == match


def test_ransomware_sliding(spark):
    assert graph.chain_ransomware(*ransom_graph(spark, 100, 110), sliding=True).count() == 1


def test_first_snapshot_is_silent(spark):
    df = rows(spark, [("h", 1, "a", 1), ("h", 1, "b", 1), ("h", 2, "b", 2), ("h", 2, "c", 1)], "host string, cycle int, key string, v int")
    got = sorted((r.cycle, r.key, r.change) for r in snapshots.diff_snapshots(df, ["key"], "v").collect())
    assert got == [(2, "a", "deleted"), (2, "b", "modified"), (2, "c", "created")]


def fold(alerts, window=300):
    """The ordered rules, row by row."""
    incidents, out = [], {}
    for aid, ts, sensor, mitre, ents in alerts:
        tactics = {fv.TECHNIQUE_TACTIC[m] for m in mitre if m in fv.TECHNIQUE_TACTIC}
        home = None
        live = [i for i in incidents if ts - i["last"] <= window]
        for test in (lambda i: set(ents) & i["e"], lambda i: tactics - i["t"], lambda i: i["s"] == sensor):
            home = home or next((i for i in live if test(i)), None)
        if home is None:
            home = {"id": f"inc-{aid}", "e": set(), "t": set()}
            incidents.append(home)
        home["e"] |= set(ents)
        home["t"] |= tactics
        home.update(last=ts, s=sensor)
        out[aid] = home["id"]
    return out


def test_correlation_exact_is_the_ordered_fold(spark):
    r = random.Random(11)
    data = []
    for i in range(250):
        data.append((f"a{i:03}", r.choice("xy"), r.randrange(20000), r.choice(["network", "file", "process", "etw"]),
                     r.choice([[], ["T1059"], ["T1486", "T1071"], ["T9"]]), r.sample([f"ip:{j}" for j in range(25)], r.randrange(3))))
    df = rows(spark, [(a, h, t * S, i, s, m, e) for i, (a, h, t, s, m, e) in enumerate(data)],
              "alert_id string, host string, ts_us bigint, seq bigint, sensor string, mitre_ids array<string>, entities array<string>")
    got = {x.alert_id: x.incident_id for x in correlate.correlate_alerts(df).collect()}
    want = {}
    for host in "xy":
        mine = sorted(((t, i, a, s, m, e) for i, (a, h, t, s, m, e) in enumerate(data) if h == host))
        want.update(fold([(a, t, s, m, e) for t, i, a, s, m, e in mine]))
    assert got == want


def test_correlation_modes_agree_without_bridges(spark):
    data = [(f"a{i}", f"h{i % 3}", i * 10 * S, i, f"s{i}", [], [f"ip:{i % 6}"]) for i in range(60)]
    df = rows(spark, data, "alert_id string, host string, ts_us bigint, seq bigint, sensor string, mitre_ids array<string>, entities array<string>")
    a = {r.alert_id: r.incident_id for r in correlate.correlate_alerts(df).collect()}
    b = {r.alert_id: r.incident_id for r in correlate.correlate_alerts(df, "components").collect()}
    assert a == b


def test_campaigns_replay_the_greedy_order(spark):
    r = random.Random(2)
    inc = [(f"i{i:02}", i, "closed" if r.random() < 0.8 else "open", i * S, i * S + 5) for i in range(60)]
    ent = {k[0]: {f"e{r.randrange(40)}" for _ in range(r.randrange(1, 4))} for k in inc}
    used, want = set(), {}
    closed = [k[0] for k in inc if k[2] == "closed"]
    for n, a in enumerate(closed):
        if a in used:
            continue
        group = [a] + [b for b in closed[n + 1:] if b not in used and ent[a] & ent[b]]
        used |= set(group[1:])
        if len(group) > 1:
            want[a] = (sorted(group), sorted(set.intersection(*[ent[g] for g in group])))
    incidents = rows(spark, inc, "incident_id string, ord int, status string, first_us bigint, last_us bigint")
    entities = rows(spark, [(k, e) for k, es in ent.items() for e in es], "incident_id string, entity string")
    members = correlate.campaign_members(incidents, entities)
    got = {}
    for row in members.collect():
        got.setdefault(row.seed_id, []).append(row.incident_id)
    assert {k: sorted(v) for k, v in got.items() if len(v) > 1} == {k: v[0] for k, v in want.items()}
    camps = {c.seed_id: (c.n_incidents, c.n_shared) for c in correlate.detect_campaigns(incidents, entities).collect()}
    assert camps == {k: (len(v[0]), len(v[1])) for k, v in want.items()}


def test_mixed_bag_of_rollups(spark):
    al = spark.createDataFrame([("i", "a1", 2, 1, "low", "t1", ["T2", "T1"], ["x"]), ("i", "a2", 1, 0, "high", "t2", ["T1"], ["y", "x"])],
                               "incident_id string, alert_id string, ts_us bigint, seq bigint, severity string, title string, mitre_ids array<string>, entities array<string>")
    row = agg.incident_rollup(al).first()
    assert (row.title, row.severity, row.mitre_chain, row.entity_count, row.first_us, row.last_us) == ("Incident: 2 related alerts", "high", ["T1", "T2"], 2, 1, 2)
