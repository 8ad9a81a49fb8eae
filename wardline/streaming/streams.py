"""Structured Streaming forms (S-*).

Stateless and windowed operators are the batch expressions on a watermarked
stream.  Keyed automata hold typed state on the RocksDB store and read the rows
of a batch in event-time order (:mod:`wardline.streaming.keyed`).
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as fv
from wardline.streaming.keyed import as_of, in_order


def with_event_time(df: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Event time with a watermark; later rows are dropped and counted by the query metrics."""
    return df.withWatermark(ts, delay)


def dedup_alert_stream(alerts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First alert of each run of same-key alerts less than 60 s apart.

    The session gap is one microsecond under 60 s because a session merges rows
    exactly one gap apart, and a gap of 60 s starts a new alert.
    """
    keys = keys or ["host", "sensor", "alert_type"]
    first = F.min(F.struct("ts", "seq", "alert_id", "severity"))
    return alerts.groupBy(*keys, F.session_window("ts", "59999999 microseconds")).agg(
        first.alias("_f"), F.count(F.lit(1)).alias("run_count")).select(
        *keys, F.col("_f.alert_id").alias("alert_id"), F.col("_f.ts").alias("ts"), F.col("_f.severity").alias("severity"), "run_count")


def flow_stats_stream(connections: DataFrame, width: str = "30 seconds") -> DataFrame:
    """Connection counts and exact distinct addresses and ports per host and window.

    Two chained windowed counts: the first holds one row of state per value of a window, the second counts them.
    """
    facts = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in (
        ("protocol", F.coalesce("protocol", F.lit(""))), ("ip", F.col("remote_ip")), ("port", F.col("remote_port")))])
    values = connections.select("host", "ts", F.explode(facts).alias("f")).select("host", "ts", "f.*")
    values = values.groupBy("host", F.window("ts", width), "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    of = lambda kind, value=None: (F.col("kind") == kind) & (F.lit(True) if value is None else F.col("value") == value)
    held = lambda kind: F.count_if(of(kind) & F.col("value").isNotNull())
    rows = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return values.groupBy("host", F.window(F.window_time("window"), width)).agg(
        rows(of("protocol")).alias("total_connections"), held("ip").alias("unique_remote_ips"), held("port").alias("unique_remote_ports"),
        rows(of("protocol", "TCP")).alias("tcp"), rows(of("protocol", "UDP")).alias("udp"),
    ).select("host", F.col("window.start").alias("window_start"), "total_connections", "unique_remote_ips", "unique_remote_ports", "tcp", "udp")


def edge_stream(nodes: DataFrame, processes: DataFrame, window: str = "30 minutes") -> DataFrame:
    """Typed edges from the latest earlier process event of the pid, at most ``window`` old, on streams.

    Keyed by host and pid, events and processes wait until the watermark is ``window`` past the event's minute; then each
    event takes one process, so no pairs arise however busy a pid is.  ``nodes`` and ``processes`` come from
    ``build_nodes`` with a watermarked column ``ts``.  A repeated event has its edge as often: see ``latest_edges``.
    """
    from wardline.operators.graph import EDGE_OF

    pid, ppid = F.coalesce(F.col("pid"), F.lit(0)), F.coalesce(F.col("ppid"), F.lit(0))
    own = F.coalesce(*[F.when(F.col("node_type") == t, F.lit(e)) for t, e in EDGE_OF.items()])
    wanted = F.array_compact(F.array(
        F.when((pid != 0) & (ppid != 0), F.struct(F.lit("spawned").alias("edge_type"), ppid.cast("bigint").alias("by"))),
        F.when((pid != 0) & own.isNotNull(), F.struct(own.alias("edge_type"), pid.cast("bigint").alias("by")))))
    time = ["ts", F.col("ts_us").cast("bigint").alias("ts_us"), F.col("seq").cast("bigint").alias("seq")]
    look = nodes.select("host", *time, "node_id", F.inline(wanted)).withColumnRenamed("by", "pid")
    procs = processes.where("node_type = 'process'").select(
        "host", *time, "node_id", F.lit(None).cast("string").alias("edge_type"), F.col("pid").cast("bigint").alias("pid"))
    rows = look.unionByName(procs).where("host IS NOT NULL AND pid IS NOT NULL AND ts IS NOT NULL")
    return as_of(rows, pd.Timedelta(window) // pd.Timedelta(microseconds=1)).drop("pid")


def latest_edges(edges: DataFrame) -> DataFrame:
    """One edge per event and type from what ``edge_stream`` wrote, by the latest process if the event was repeated."""
    return edges.groupBy("host", "dst", "edge_type", "ts_us").agg(F.max_by("src", F.struct("src_us", "src_seq")).alias("src")).select(
        "host", "src", "dst", "edge_type", "ts_us")


def failed_login_stream(log: DataFrame, width: str = "15 seconds", slide: str | None = None, threshold: int = 5) -> DataFrame:
    """Windows with at least ``threshold`` failed logins per host."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return log.where("code = 4625").groupBy("host", window).agg(F.count(F.lit(1)).alias("failed_logins")).where(
        F.col("failed_logins") >= threshold).select("host", F.col("window.start").alias("window_start"), "failed_logins")


def rule_stream(events: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    from wardline.operators.rules import apply_rules

    return apply_rules(events, rules)


def ioc_enrich_stream(events: DataFrame, iocs: DataFrame, column: str) -> DataFrame:
    """Stream-static join with the current indicators."""
    from wardline.operators.joins import ioc_by_value

    dim = ioc_by_value(iocs).select(F.col("value").alias(column), F.col("source").alias("ioc_source"), F.col("severity").alias("ioc_severity"))
    return events.join(dim, column, "left")


def prediction_enrich(alerts: DataFrame, predictions: DataFrame) -> DataFrame:
    """Alerts joined to the ranked successors of their last technique."""
    return alerts.withColumn("technique_id", F.try_element_at("mitre_ids", F.lit(-1))).join(predictions, "technique_id", "left")


# --- keyed state ---------------------------------------------------------------------------
def chain_stream(log: DataFrame, window_us: int = 300_000_000) -> DataFrame:
    """Log-code chains per host; the state is one position and time per pattern."""
    from wardline.operators.windows import step_pattern

    patterns = {k: v[0] for k, v in fv.LOG_CHAINS.items()}

    def fold(key, memory, rows):
        at, out = {name: (idx, first) for name, idx, first in memory}, []
        for code, ts in zip(rows["code"], rows["ts_us"]):
            for name, pattern in patterns.items():
                idx, first = at.get(name, (0, None))
                idx, first, begun = step_pattern(pattern, idx, first, int(code), int(ts))
                at[name] = (idx, first)
                if begun is not None and ts - begun <= window_us:
                    out.append((key[0], name, int(begun), int(ts)))
        return [(name, idx, first) for name, (idx, first) in at.items() if idx], out

    return in_order(log, ["host"], "ts_us bigint, seq bigint, code bigint", "pattern string, position int, first_us bigint",
                    "host string, chain string, first_us bigint, last_us bigint", fold)


def beacon_stream(contacts: DataFrame, min_events: int = 15, threshold: float = 0.5) -> DataFrame:
    """Beacon alert per destination on the first crossing; all contact times are held until then."""

    def fold(key, memory, rows):
        if memory and memory[0][1]:
            return memory, []
        times = [ts for ts, _ in memory]
        gaps = sorted(b - a for a, b in zip(times, times[1:]))
        total, squares = sum(gaps), sum(g * g for g in gaps)
        for ts in (int(x) for x in rows["ts_us"]):
            k = bisect_right(times, ts)
            times.insert(k, ts)
            old = [times[k + 1] - times[k - 1]] if 0 < k < len(times) - 1 else []
            for gap in old:
                del gaps[bisect_left(gaps, gap)]
            new = [b - a for a, b in zip(times[max(k - 1, 0):k + 1], times[max(k, 1):k + 2])]
            for gap in new:
                insort(gaps, gap)
            total += sum(new) - sum(old)
            squares += sum(g * g for g in new) - sum(g * g for g in old)
            n = len(gaps)
            if len(times) < min_events or n == 0:
                continue
            median = (gaps[(n - 1) // 2] + gaps[n // 2]) / 2
            if median == 0:
                continue
            share = (bisect_right(gaps, 1.2 * median) - bisect_left(gaps, 0.8 * median)) / n
            spread = math.sqrt(n * squares - total * total) / n
            score = 0.4 * (1.0 - min(spread / median, 1.0)) + 0.6 * share
            if score >= threshold:
                return [(ts, True)], [(key[0], key[1], ts, score, len(times))]
        return [(ts, False) for ts in times], []

    return in_order(contacts, ["host", "dest"], "ts_us bigint, seq bigint", "ts_us bigint, alerted boolean",
                    "host string, dest string, ts_us bigint, score double, n_events int", fold, 86_400_000)


def dns_rate_stream(queries: DataFrame) -> DataFrame:
    """Exact trailing 60 s query rate per base domain; all times of the last 60 s are held."""

    def fold(key, memory, rows):
        times, out = [ts for ts, in memory], []
        for ts, seq in zip(rows["ts_us"], rows["seq"]):
            del times[:bisect_right(times, int(ts) - 60_000_000)]
            insort(times, int(ts))
            out.append((key[0], int(seq), int(ts), len(times)))
        return [(ts,) for ts in times], out

    return in_order(queries, ["base"], "ts_us bigint, seq bigint", "ts_us bigint",
                    "base string, seq bigint, ts_us bigint, rate int", fold, 120_000)


def reputation_stream(observations: DataFrame, start: float = 50.0) -> DataFrame:
    """Running clamped score per address, one row per observation."""

    def fold(key, memory, rows):
        (score, n), out = memory[0] if memory else (start, 0), []
        for ts, seq, delta in zip(rows["ts_us"], rows["seq"], rows["delta"]):
            score, n = min(100.0, max(0.0, score + float(delta))), n + 1
            out.append((key[0], int(ts), int(seq), score, n))
        return [(score, n)], out

    return in_order(observations, ["address"], "ts_us bigint, seq bigint, delta double", "score double, n bigint",
                    "address string, ts_us bigint, seq bigint, score double, total_connections bigint", fold)


def correlate_stream(alerts: DataFrame, window_us: int = 300_000_000) -> DataFrame:
    """Incident of each alert per host by the ordered rules; a timer drops what is open once the window is past."""
    tactic_of = dict(fv.TECHNIQUE_TACTIC)

    def fold(key, memory, rows):
        # tags and tactics grow in place as sets and become lists once a part
        live, out = [[m[0], set(m[1]), set(m[2]), m[3], m[4]] for m in memory], []
        for alert, ts, sensor, mitre, entities in zip(rows["alert_id"], rows["ts_us"], rows["sensor"], rows["mitre_ids"], rows["entities"]):
            tags, tactics = set(entities), {tactic_of[m] for m in mitre if m in tactic_of}
            live = [i for i in live if ts - i[4] <= window_us]
            tests = (("entity", lambda i: not tags.isdisjoint(i[1])), ("tactic", lambda i: bool(tactics - i[2])),
                     ("sensor", lambda i: i[3] == sensor))
            rule, home = next(((r, i) for r, test in tests for i in live if test(i)), ("new", None))
            if home is None:
                home = [f"inc-{alert}", set(), set(), sensor, 0]
                live.append(home)
            home[1] |= tags
            home[2] |= tactics
            home[3], home[4] = sensor, int(ts)
            out.append((key[0], alert, home[0], rule))
        return [(name, sorted(tags), sorted(tactics), sensor, last) for name, tags, tactics, sensor, last in live], out

    return in_order(alerts, ["host"], "ts_us bigint, seq bigint, alert_id string, sensor string, mitre_ids array<string>, entities array<string>",
                    "incident_id string, tags array<string>, tactics array<string>, sensor string, last_us bigint",
                    "host string, alert_id string, incident_id string, rule string", fold, window_us // 1000 + 1)


# --- foreachBatch sinks ---------------------------------------------------------------------------
def graph_batch(events_path: str, matches_path: str, window_us: int = 1_800_000_000):
    """Sink that stores a batch of events by hour and re-evaluates the chains over the last 30 minutes.

    The window is a range of hours, so a batch opens the folders of its own window only, however long the stream has run.
    """
    hour_us = 3_600_000_000

    def write(batch: DataFrame, epoch: int) -> None:
        from wardline.operators import graph

        if batch.isEmpty():
            return
        spark = batch.sparkSession
        hour = F.floor(F.col("ts_us") / hour_us).cast("bigint")
        stored = batch.withColumn("hour", hour).withColumn("epoch", F.lit(epoch).cast("bigint"))
        # a replayed epoch overwrites its own folders and no others
        stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "epoch").parquet(events_path)
        newest = batch.agg(F.max("ts_us")).first()[0]
        oldest = newest - window_us
        hours = F.col("hour").between(oldest // hour_us, newest // hour_us)
        recent = spark.read.schema(stored.schema).parquet(events_path).where(hours & (F.col("epoch") <= epoch) & F.col("ts_us").between(oldest, newest)).drop("hour", "epoch")
        nodes = graph.build_nodes(recent)
        graph.attack_chains(nodes, graph.build_edges(nodes)).write.mode("overwrite").parquet(f"{matches_path}/epoch={epoch}")

    return write


def alert_batch(alerts_path: str, audit_path: str):
    """Sink that writes deduplicated alerts and their audit rows; a replayed epoch overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        from wardline.operators.detect import process_alerts
        from wardline.sources.sinks import audit_alerts

        if batch.isEmpty():
            return
        alerts = process_alerts(batch)
        alerts.write.mode("overwrite").parquet(f"{alerts_path}/epoch={epoch}")
        stored = batch.sparkSession.read.parquet(f"{alerts_path}/epoch={epoch}")
        audit_alerts(stored).write.mode("overwrite").parquet(f"{audit_path}/epoch={epoch}")

    return write


def incident_batch(incidents_path: str):
    """Sink that keeps one row per incident: a batch's links are appended, the view takes the latest."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{incidents_path}/epoch={epoch}")

    return write
