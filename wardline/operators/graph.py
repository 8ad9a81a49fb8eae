"""Context graph: as-of edges, hierarchy and attack chains (J-15, J-20, J-21, W-14, G-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as fv
from wardline.operators import rules
from wardline.operators.segmented import salted_join, segmented_scan, time_segment
from wardline.operators.substrings import containing_pairs
from wardline.session import checkpoint, forget

NODE_TYPES = {"process": "process", "file": "file", "network": "network"}
EDGE_OF = {"file": "modified", "network": "opened", "log": "triggered"}
WINDOW_US = 1_800_000_000


def build_nodes(events: DataFrame) -> DataFrame:
    """Events as graph nodes; sensors other than process, file and network are log nodes."""
    kind = F.coalesce(*[F.when(F.col("sensor") == s, F.lit(t)) for s, t in NODE_TYPES.items()], F.lit("log"))
    return events.withColumn("node_id", F.col("event_id")).withColumn("node_type", kind)


def _as_of_process(lookups: DataFrame, processes: DataFrame) -> DataFrame:
    """Latest process node of (host, pid) strictly before each lookup row, as ``src``."""
    src = processes.select("host", F.col("pid").alias("_pid"), "ts_us", "seq", F.lit(1).alias("_kind"), F.col("node_id").alias("_node"))
    both = lookups.withColumn("_kind", F.lit(0)).unionByName(src, allowMissingColumns=True)
    scanned = segmented_scan(both, ["host", "_pid"], time_segment(F.col("ts_us")), ["ts_us", "seq", "_kind"], {"src": ("last", F.col("_node"))})
    return scanned.where("_kind = 0").drop("_kind", "_node")


def last_process_node(events: DataFrame, pid: str, name: str) -> DataFrame:
    """Add the id of the latest earlier process event whose pid equals the column ``pid``."""
    nodes = build_nodes(events)
    look = nodes.select("host", F.col(pid).alias("_pid"), "ts_us", "seq", "event_id")
    found = _as_of_process(look, nodes.where("node_type = 'process'")).select("event_id", F.col("src").alias(name))
    return events.join(found, "event_id", "left")


def build_edges(nodes: DataFrame) -> DataFrame:
    """Typed edges (host, src, dst, edge_type, ts_us) to the latest earlier process node of the pid.

    A parent pid gives ``spawned``; a file, network or log event of a pid gives
    ``modified``, ``opened`` or ``triggered``.
    """
    pid, ppid = F.coalesce(F.col("pid"), F.lit(0)), F.coalesce(F.col("ppid"), F.lit(0))
    own = F.coalesce(*[F.when(F.col("node_type") == t, F.lit(e)) for t, e in EDGE_OF.items()])
    wanted = F.array_compact(F.array(
        F.when((pid != 0) & (ppid != 0), F.struct(F.lit("spawned").alias("edge_type"), ppid.alias("_pid"))),
        F.when((pid != 0) & own.isNotNull(), F.struct(own.alias("edge_type"), pid.alias("_pid")))))
    look = nodes.select("host", "ts_us", "seq", F.col("node_id").alias("dst"), F.inline(wanted))
    out = _as_of_process(look, nodes.where("node_type = 'process'"))
    return out.where("src IS NOT NULL").select("host", "src", "dst", "edge_type", "ts_us")


def prune_graph(nodes: DataFrame, edges: DataFrame, as_of_us: int, window_us: int = WINDOW_US) -> tuple[DataFrame, DataFrame]:
    """Nodes of the window and the edges whose two ends are both in it."""
    kept = nodes.where(F.col("ts_us") >= as_of_us - window_us)
    ids = kept.select("node_id")
    live = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return kept, live


def graph_neighbors(nodes: DataFrame, edges: DataFrame, edge_type: str | None = None) -> DataFrame:
    """(src, neighbour node) pairs along an edge type."""
    picked = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    far = nodes.select(F.col("node_id").alias("dst"), F.col("node_type").alias("dst_type"), F.col("name").alias("dst_name"))
    return picked.join(far, "dst")


def nodes_by_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.where(F.col("node_type") == node_type)


# --- hierarchy ----------------------------------------------------------------------------------
def _double(ptr: DataFrame, keys: list[str]) -> DataFrame:
    """Replace each pointer by the pointer of its target."""
    far = ptr.select(*keys, F.col("node").alias("ptr"), F.col("ptr").alias("_p2"), F.col("dist").alias("_d2"), F.col("root").alias("_r2"))
    return salted_join(ptr, far, [*keys, "ptr"], "inner").select(
        *keys, "node", F.col("_p2").alias("ptr"), (F.col("dist") + F.col("_d2")).alias("dist"), F.col("_r2").alias("root"))


def hierarchy(procs: DataFrame, scope: list[str] | None = None, pid: str = "pid", ppid: str = "ppid") -> DataFrame:
    """Depth and root of every process by pointer doubling (logarithmic rounds).

    A pid that occurs more than once in a scope is one process, its latest row (by ``ts_us``
    if there is one, else the greatest parent).
    A process without a known parent, or its own parent, is a root of depth 0.
    So is every member of a parent cycle; what hangs below a cycle counts from it.
    ``in_cycle`` marks those members.
    """
    scope = scope or ["host"]
    latest = F.struct("ts_us", ppid) if "ts_us" in procs.columns else F.struct(ppid)
    procs = procs.groupBy(*scope, pid).agg(F.max(latest)[ppid].alias(ppid))
    known = procs.select(*scope, F.col(pid).alias(ppid), F.lit(True).alias("_known"))
    base = salted_join(procs.select(*scope, pid, ppid), known, [*scope, ppid], "left")
    is_root = F.col("_known").isNull() | (F.coalesce(F.col(ppid), F.lit(0)) == 0) | (F.col(ppid) == F.col(pid))
    # ``root``: the pointer has arrived at a root
    start = base.select(*scope, F.col(pid).alias("node"), F.when(is_root, F.col(pid)).otherwise(F.col(ppid)).alias("ptr"),
                        F.when(is_root, 0).otherwise(1).cast("bigint").alias("dist"), is_root.alias("root"))

    def resolve(ptr):
        first, previous = ptr, None
        while True:
            last, ptr = ptr, checkpoint(_double(ptr, scope))
            if last is not first:
                forget(last)
            open_rows = ptr.where("NOT root")
            state = open_rows.agg(F.count(F.lit(1)), F.count_distinct(F.struct(*scope, "ptr"))).first()
            if state[0] == 0 or tuple(state) == previous:
                return ptr, state[0]
            previous = tuple(state)

    start = checkpoint(start)
    done, n_open = resolve(start)
    if n_open == 0:
        return done.select(*scope, F.col("node").alias(pid), F.col("dist").alias("depth"), F.col("ptr").alias("root_pid"), F.lit(False).alias("in_cycle"))
    # images of a power of the parent map on what never reaches a root are exactly the cycle members
    members = done.where("NOT root").select(*scope, F.col("ptr").alias("node")).distinct().withColumn("_c", F.lit(True))
    stuck = done.where("NOT root").select(*scope, "node")
    again = start.join(stuck, [*scope, "node"], "left_semi").join(members, [*scope, "node"], "left").select(
        *scope, "node", F.when(F.col("_c"), F.col("node")).otherwise(F.col("ptr")).alias("ptr"),
        F.when(F.col("_c"), 0).otherwise(F.col("dist")).cast("bigint").alias("dist"), F.coalesce(F.col("_c"), F.lit(False)).alias("root"))
    below, _ = resolve(checkpoint(again))
    whole = done.where("root").unionByName(below)
    return whole.join(members, [*scope, "node"], "left").select(
        *scope, F.col("node").alias(pid), F.col("dist").alias("depth"), F.col("ptr").alias("root_pid"), F.coalesce(F.col("_c"), F.lit(False)).alias("in_cycle"))


def process_tree(procs: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Processes with depth, root and whether they hang from a displayed root."""
    scope = scope or ["host"]
    tree = hierarchy(procs, scope)
    return procs.join(tree, [*scope, "pid"])


def lineage_depth(procs: DataFrame, scope: list[str] | None = None) -> DataFrame:
    scope = scope or ["host"]
    return hierarchy(procs, scope).select(*scope, "pid", "depth")


# --- attack chains ---------------------------------------------------------------------------------
def _name(prefix: str = "") -> Column:
    return F.lower(F.coalesce(F.nullif(F.col(f"{prefix}name"), F.lit("")), F.nullif(F.col(f"{prefix}exe"), F.lit("")),
                              F.nullif(F.col(f"{prefix}path"), F.lit("")), F.lit("unknown")))


def _chain(df: DataFrame, name: str, confidence: Column | None = None, evidence: list[str] | None = None,
           target: Column | None = None) -> DataFrame:
    mitre, base, severity = fv.GRAPH_CHAINS[name]
    conf = F.lit(base) if confidence is None else confidence
    counts = F.create_map(*[x for e in (evidence or []) for x in (F.lit(e), F.col(e).cast("bigint"))]) if evidence else F.create_map().cast("map<string,bigint>")
    return df.select("host", F.lit(name).alias("chain_name"), F.col("src").alias("node_id"),
                     (F.lit(None) if target is None else target).cast("string").alias("target_id"), conf.cast("double").alias("confidence"),
                     F.lit(severity).alias("severity"), F.array(*map(F.lit, mitre)).alias("mitre_ids"), counts.alias("evidence"))


def _far(nodes: DataFrame, edges: DataFrame, edge_type: str, *columns: str) -> DataFrame:
    """Edges of a type with columns of the target node."""
    side = nodes.select(F.col("node_id").alias("dst"), F.col("node_type").alias("dst_type"), F.col("ts_us").alias("dst_us"), *columns)
    return edges.where(F.col("edge_type") == edge_type).select("host", "src", "dst").join(side, "dst")


def _procs(nodes: DataFrame, *columns: str) -> DataFrame:
    return nodes.where("node_type = 'process'").select(F.col("node_id").alias("src"), *[F.col(c).alias(f"p_{c}") for c in columns])


def chain_drive_by(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Browser wrote an executable; a process whose name contains its path or is part of it ran on the host.

    File paths and process names are made distinct per host and meet through an index of character runs; the number of
    processes then comes back to the written files by an equi-join.  The browser itself does not count as an execution.
    """
    files = _far(nodes, edges, "modified", "path").where("dst_type = 'file'").where(rules.is_executable(F.col("path")))
    browsers = _procs(nodes, "name", "exe", "path").where(_name("p_").isin(*fv.GRAPH_BROWSERS))
    written = salted_join(files, browsers, ["src"], "inner").select("host", "src", "dst", _name("p_").alias("_browser"), F.lower("path").alias("_file"))
    ran = nodes.where("node_type = 'process'").select("host", _name().alias("_exec")).groupBy("host", "_exec").agg(F.count(F.lit(1)).alias("_n"))
    met = containing_pairs(written, ran, ["host"], "_file", "_exec").join(ran, ["host", "_exec"]).groupBy("host", "_file").agg(F.sum("_n").alias("_all"))
    itself = (F.col("_file").contains(F.col("_browser")) | F.col("_browser").contains(F.col("_file"))).cast("int")
    per = salted_join(written, met, ["host", "_file"], "inner").withColumn("executions", F.col("_all") - itself).where("executions > 0")
    per = per.groupBy("host", "src", "dst").agg(F.sum("executions").alias("executions"))
    return _chain(per, "drive_by_download", evidence=["executions"], target=F.col("dst"))


def chain_credential_theft(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Non-browser process with a credential file and a network connection."""
    files = _far(nodes, edges, "modified", "path").where("dst_type = 'file'").where(rules.is_credential_path(F.col("path"))) \
        .groupBy("host", "src").agg(F.count(F.lit(1)).alias("credential_files"))
    nets = edges.where("edge_type = 'opened'").groupBy("src").agg(F.count(F.lit(1)).alias("connections"))
    procs = _procs(nodes, "name", "exe", "path").where(~_name("p_").isin(*fv.GRAPH_BROWSERS))
    return _chain(files.join(nets, "src").join(procs.select("src"), "src"), "credential_theft", evidence=["credential_files", "connections"])


def chain_ransomware(nodes: DataFrame, edges: DataFrame, min_files: int = 50, span_us: int = 60_000_000, sliding: bool = False) -> DataFrame:
    """Many files changed by one process within the span.

    By default the whole activity of the process must fit the span; ``sliding``
    accepts any burst of ``min_files`` within it.
    """
    extra = ["entropy_before", "entropy_after"] if "entropy_before" in nodes.columns else []
    files = _far(nodes, edges, "modified", *extra).where("dst_type = 'file'")
    rising = F.count_if(rules.entropy_increase(F.col("entropy_before"), F.col("entropy_after"))) if extra else F.lit(0)
    per = files.groupBy("host", "src").agg(F.count(F.lit(1)).alias("files"), F.min("dst_us").alias("_a"), F.max("dst_us").alias("_b"), rising.alias("entropy_rises"))
    if sliding:
        from wardline.operators.segmented import trailing_count
        bursts = trailing_count(files.select("src", "dst_us"), ["src"], "dst_us", span_us, "_n", include_start=True).where(F.col("_n") >= min_files)
        hit = per.join(bursts.select("src").distinct(), "src", "left_semi")
    else:
        hit = per.where((F.col("files") >= min_files) & (F.col("_b") - F.col("_a") <= span_us))
    return _chain(hit, "ransomware", evidence=["files", "entropy_rises"])


def chain_persistence(nodes: DataFrame, edges: DataFrame, signature: str | None = None) -> DataFrame:
    """Unsigned or temp-folder process with a start-up write or a persistence log event."""
    writes = _far(nodes, edges, "modified", "path").where("dst_type = 'file'").where(rules.is_persistence_path(F.col("path"))).select("host", "src")
    logs = _far(nodes, edges, "triggered", "code", "event_type").where(rules.persistence_event(F.col("code"), F.col("event_type"))).select("host", "src")
    targets = writes.unionByName(logs).groupBy("host", "src").agg(F.count(F.lit(1)).alias("targets"))
    sig = F.lit("signed") if signature is None else F.col(signature)
    path = F.coalesce(F.nullif(F.col("path"), F.lit("")), F.col("exe")) if signature else F.col("exe")
    suspects = nodes.where("node_type = 'process'").where(rules.suspicious_origin(sig, path)).select(F.col("node_id").alias("src"))
    return _chain(targets.join(suspects, "src"), "persistence_installation", evidence=["targets"])


def chain_fileless(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Spawned encoded PowerShell that opened a connection; weaker if it also wrote files."""
    children = _far(nodes, edges, "spawned", "name", "exe", "path", "cmdline").where(
        _name().isin("powershell.exe", "pwsh.exe") & rules.has_encoded_flag(F.col("cmdline"))).select("host", "src", F.col("dst").alias("child"))
    used = edges.where(F.col("edge_type").isin("opened", "modified")).groupBy(F.col("src").alias("child")).agg(
        F.count_if(F.col("edge_type") == "opened").alias("connections"), F.count_if(F.col("edge_type") == "modified").alias("files"))
    hit = children.join(used.where("connections > 0"), "child")
    base = fv.GRAPH_CHAINS["fileless_attack"][1]
    return _chain(hit, "fileless_attack", F.when(F.col("files") > 0, base * 0.7).otherwise(base), ["connections", "files"], F.col("child"))


def chain_lateral(nodes: DataFrame, min_failures: int = 3) -> DataFrame:
    """Failed logons, a success at or after the first, then the first new service after that success."""
    code, kind = F.coalesce(F.col("code").cast("string"), F.lit("")), F.coalesce(F.col("event_type"), F.lit(""))
    logon = F.coalesce(F.col("logon_type").cast("string"), F.lit("")) if "logon_type" in nodes.columns else F.lit("")
    role = (F.when((code == "4625") | kind.contains("failed_login"), "failed")
            .when((code == "4624") | kind.contains("successful_login"), F.when(logon.isin("3", "10", ""), "success"))
            .when(code.isin("7045", "4697") | kind.contains("service_install"), "service"))
    logs = nodes.where("node_type = 'log'").select("host", "node_id", "ts_us", "seq", role.alias("role")).where("role IS NOT NULL")
    per = logs.groupBy("host").agg(F.count_if(F.col("role") == "failed").alias("failures"), F.min(F.when(F.col("role") == "failed", F.col("ts_us"))).alias("_first"))
    late = nodes.where("node_type = 'network'").groupBy("host").agg(F.max("ts_us").alias("_net"))
    hosts = per.where(F.col("failures") >= min_failures).join(late, "host", "left")
    # walk back in time: the last service met is the first one after the success; at equal times it counts
    back = logs.where("role <> 'failed'").withColumn("_t", -F.col("ts_us")).withColumn("_k", F.when(F.col("role") == "service", 0).otherwise(1)) \
        .withColumn("_svc", F.when(F.col("role") == "service", F.col("ts_us")))
    seen = segmented_scan(back, ["host"], time_segment(F.col("_t")), ["_t", "_k", "seq"], {"service_us": ("last", F.col("_svc"))})
    hit = salted_join(seen.where("role = 'success' AND service_us IS NOT NULL"), hosts, ["host"], "inner").where(F.col("ts_us") >= F.col("_first"))
    hit = hit.withColumn("outbound", F.coalesce(F.col("_net") >= F.col("service_us"), F.lit(False)).cast("int")).withColumn("src", F.col("node_id"))
    return _chain(hit, "lateral_movement", evidence=["failures", "outbound"])


def chain_exfiltration(nodes: DataFrame, edges: DataFrame, min_files: int = 20, min_bytes: int = 50_000_000) -> DataFrame:
    """Many files and an external connection; weaker below the data volume."""
    files = _far(nodes, edges, "modified").where("dst_type = 'file'").groupBy("host", "src").agg(F.count(F.lit(1)).alias("files"))
    nets = _far(nodes, edges, "opened", "remote_ip", "bytes_sent").where("dst_type = 'network'").where(rules.external_address(F.col("remote_ip"))) \
        .groupBy("src").agg(F.count(F.lit(1)).alias("connections"), F.sum(F.coalesce("bytes_sent", F.lit(0))).alias("bytes"))
    hit = files.where(F.col("files") >= min_files).join(nets, "src")
    base = fv.GRAPH_CHAINS["data_exfiltration"][1]
    return _chain(hit, "data_exfiltration", F.when(F.col("bytes") < min_bytes, base * 0.6).otherwise(base), ["files", "connections", "bytes"])


def chain_injection(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Process with the three API calls, or a remote-thread event of a process without them."""
    text = F.lower(F.concat_ws(" ", "api_call", "event_type"))
    logs = _far(nodes, edges, "triggered", "api_call", "event_type")
    calls = {n: F.bool_or(text.contains(n)) for n in ("virtualallocex", "writeprocessmemory", "createremotethread")}
    full = logs.groupBy("host", "src").agg(*[c.alias(n) for n, c in calls.items()], F.count(F.lit(1)).alias("calls")).where(" AND ".join(calls))
    kind = F.lower("event_type")
    remote = nodes.where("node_type = 'log'").where((F.col("code") == 8) | kind.contains("createremotethread") | kind.contains("sysmon_8"))
    by = edges.where("edge_type = 'triggered'").select(F.col("dst").alias("node_id"), F.col("src").alias("_by"))
    alone = remote.join(by, "node_id", "left").join(full.select(F.col("src").alias("_by")), "_by", "left_anti")
    single = alone.select("host", F.col("node_id").alias("src"), F.lit(1).cast("bigint").alias("calls"))
    return _chain(full.select("host", "src", "calls").unionByName(single), "dll_injection", evidence=["calls"])


def attack_chains(nodes: DataFrame, edges: DataFrame, **limits: int) -> DataFrame:
    """All chain matches over a graph."""
    parts = [chain_drive_by(nodes, edges), chain_credential_theft(nodes, edges),
             chain_ransomware(nodes, edges, limits.get("ransom_files", 50)), chain_persistence(nodes, edges), chain_fileless(nodes, edges),
             chain_lateral(nodes), chain_exfiltration(nodes, edges, limits.get("exfil_files", 20))]
    if "api_call" in nodes.columns:
        parts.append(chain_injection(nodes, edges))
    return reduce(lambda a, b: a.unionByName(b), parts)


