"""Entities, incidents and campaigns (P-03, A-12, W-01, W-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extract_entities(**columns: str) -> Column:
    """Distinct ``pid:``/``ip:``/``file:``/``domain:`` tags of the named columns.

    Keyword names start with pid, ip, path or domain; an address needs a dot.
    """
    tags = []
    for kind, name in columns.items():
        value = F.col(name).cast("string")
        ok = F.length(value) > 0
        if kind.startswith("pid"):
            tags.append(F.when(ok & (value != "0"), F.concat(F.lit("pid:"), value)))
        elif kind.startswith("ip"):
            tags.append(F.when(ok & value.contains("."), F.concat(F.lit("ip:"), value)))
        elif kind.startswith("path"):
            tags.append(F.when(ok, F.concat(F.lit("file:"), value)))
        else:
            tags.append(F.when(ok, F.concat(F.lit("domain:"), value)))
    return F.array_distinct(F.array_compact(F.array(*tags)))


# --- W-16 -------------------------------------------------------------------------------------
WINDOW_US = 300_000_000


def correlate_alerts(alerts: DataFrame, mode: str = "exact", window_us: int = WINDOW_US, keys: list[str] | None = None) -> DataFrame:
    """Assign each alert to an incident: (alert_id, incident_id, rule).

    Needs ``alert_id, ts_us, seq, sensor, mitre_ids, entities`` and the key columns
    (``host``).

    ``exact`` replays the ordered rules per host: the first open incident that
    shares an entity, else the first that gains a tactic, else the first whose
    last alert has the same sensor, all within the window; else a new incident.
    The order matters, so a host is one stream, but a quiet gap longer than the
    window closes every incident and the stream is split there.  Rows flow through
    the task in batches and only open incidents are held.

    ``components`` joins alerts that share an entity within the window of each
    other, transitively, and scales out over a host that is never quiet.  Both
    modes agree when only the entity rule fires and no alert bridges two incidents.
    """
    keys = keys or ["host"]
    if mode == "components":
        return _correlate_components(alerts, window_us, keys)
    if mode != "exact":
        raise ValueError(mode)
    import pandas as pd

    from wardline import fixed_values as fv
    from wardline.operators.segmented import gap_islands

    columns = [*keys, "alert_id", "ts_us", "seq", "sensor", "mitre_ids", "entities"]
    split = gap_islands(alerts.select(*columns), keys, "ts_us", "seq", window_us + 1, "_island")
    group = [*keys, "_island"]
    ready = split.repartition(*group).sortWithinPartitions(*group, "ts_us", "seq")
    tactic_of = dict(fv.TECHNIQUE_TACTIC)
    n_keys = len(group)

    def assign(batches):
        current, open_incidents = None, []
        for pdf in batches:
            out = []
            for row in pdf[[*group, "alert_id", "ts_us", "sensor", "mitre_ids", "entities"]].itertuples(index=False, name=None):
                key, (alert, ts, sensor, mitre, entities) = row[:n_keys], row[n_keys:]
                if key != current:
                    current, open_incidents = key, []
                tags = set(entities) if entities is not None else set()
                tactics = {tactic_of[m] for m in (mitre if mitre is not None else []) if m in tactic_of}
                open_incidents = [i for i in open_incidents if ts - i["last"] <= window_us]
                rule, home = "new", None
                for name, test in (("entity", lambda i: not tags.isdisjoint(i["tags"])), ("tactic", lambda i: bool(tactics - i["tactics"])),
                                   ("sensor", lambda i: i["sensor"] == sensor)):
                    home = next((i for i in open_incidents if test(i)), None)
                    if home is not None:
                        rule = name
                        break
                if home is None:
                    home = {"id": f"inc-{alert}", "tags": set(), "tactics": set()}
                    open_incidents.append(home)
                home["tags"] |= tags
                home["tactics"] |= tactics
                home["last"], home["sensor"] = ts, sensor
                out.append((alert, home["id"], rule))
            yield pd.DataFrame(out, columns=["alert_id", "incident_id", "rule"])

    return ready.mapInPandas(assign, "alert_id string, incident_id string, rule string")


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) with the least id of each component, by alternating large-star and small-star rounds.

    Every round moves neighbours to the least neighbour, until all edges are stars around the least ids; the rounds
    grow with the logarithm of a component, not with its diameter.  Hot stars are salted, edges are checkpointed per round.
    """
    from wardline.operators.segmented import salted_join
    from wardline.session import checkpoint, forget

    stars, mark = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = checkpoint(salted_join(both, least, ["u"], "inner").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = salted_join(large, least, ["u"], "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, stars = stars, checkpoint(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        forget(last, large)
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return vertices.select("id").join(stars.select(F.col("u").alias("id"), F.col("v").alias("_root")), "id", "left").select(
        "id", F.coalesce("_root", "id").alias("component"))


def _correlate_components(alerts: DataFrame, window_us: int, keys: list[str]) -> DataFrame:
    """A run of alerts of one entity without a gap above the window meets at its first alert, so no long paths arise."""
    from wardline.operators.segmented import salted_join, segmented_scan, time_segment
    from wardline.session import checkpoint

    group, segment, order = [*keys, "entity"], time_segment(F.col("ts_us")), ["ts_us", "seq", "alert_id"]
    rows = checkpoint(alerts.select(*keys, "alert_id", "ts_us", "seq", F.explode("entities").alias("entity")))
    near = segmented_scan(rows, group, segment, order, {"_prev": ("lag", F.col("alert_id")), "_prev_us": ("lag", F.col("ts_us"))})
    linked = F.coalesce((F.col("ts_us") - F.col("_prev_us") <= window_us) & F.col("_prev").isNotNull(), F.lit(False))
    near = checkpoint(near.select(*group, *order, linked.alias("_linked")))
    runs = segmented_scan(near, group, segment, [*order, "_linked"], {"_first": ("last", F.when(~F.col("_linked"), F.col("alert_id")))})
    edges = runs.where("_linked").select(F.col("alert_id").alias("a"), F.col("_first").alias("b"))
    comp = checkpoint(connected_components(alerts.select(F.col("alert_id").alias("id")).distinct(), edges))
    first = alerts.join(comp, alerts["alert_id"] == comp["id"]).groupBy("component").agg(
        F.min(F.struct("ts_us", "seq", "alert_id"))["alert_id"].alias("_first"))
    return salted_join(comp, first, ["component"], "inner").select(F.col("id").alias("alert_id"), F.concat(F.lit("inc-"), "_first").alias("incident_id"),
                                                                   F.lit("component").alias("rule"))


# --- A-12 -------------------------------------------------------------------------------------
REPLAY_ROWS = 200_000


def _replay(frames):
    """Ids of the seeds among link rows (incident_id, entity) that come in incident order."""
    import pandas as pd

    taken: set = set()
    current, held = None, []

    def close():
        if current is not None and taken.isdisjoint(held):
            taken.update(held)
            return [current]
        return []

    for frame in frames:
        seeds = []
        for incident, entity in zip(frame["incident_id"], frame["entity"]):
            if incident != current:
                seeds += close()
                current, held = incident, []
            held.append(entity)
        yield pd.DataFrame({"incident_id": seeds}, dtype="object")
    yield pd.DataFrame({"incident_id": close()}, dtype="object")


def _forced(undecided: DataFrame) -> DataFrame:
    """Seeds that can be told at once: incidents first in all their entities, and those at an even distance from one
    of them along single links, where an incident has one earlier undecided neighbour only.

    Such an incident is a seed exactly if that neighbour is none, so a chain is settled by pointer doubling.
    """
    from wardline.operators.segmented import salted_join
    from wardline.session import checkpoint, forget

    least = undecided.groupBy("entity").agg(F.min("o").alias("_first"))
    marked = salted_join(undecided, least, ["entity"], "inner")
    second = marked.where("o > _first").groupBy("entity").agg(F.min("o").alias("_second"))
    marked = salted_join(marked, second, ["entity"], "left")
    later = F.col("o") > F.col("_first")
    told = checkpoint(marked.groupBy("incident_id").agg(
        F.max(F.when(later, F.col("_first.incident_id"))).alias("up"),
        F.bool_and(~later | ((F.col("o") == F.col("_second")))).alias("_second_only"),
        F.count_distinct(F.when(later, F.col("_first.incident_id"))).alias("_n")))
    first = told.where("_n = 0").select("incident_id")
    last = links = checkpoint(told.where("_n = 1 AND _second_only").select("incident_id", "up", F.lit(True).alias("odd")))
    while True:
        far = links.select(F.col("incident_id").alias("up"), F.col("up").alias("_up"), F.col("odd").alias("_odd"))
        longer = checkpoint(links.join(far, "up", "left").select(
            "incident_id", F.coalesce("_up", "up").alias("up"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"), F.col("_up").isNotNull().alias("_moved")))
        forget(last)
        last, links, moved = longer, longer.drop("_moved"), longer.where("_moved").limit(1).count()
        if moved == 0:
            break
    even = links.where("NOT odd").join(first.select(F.col("incident_id").alias("up")), "up", "left_semi").select("incident_id")
    return first.unionByName(even)


def campaign_members(incidents: DataFrame, entities: DataFrame, replay_rows: int = REPLAY_ROWS) -> DataFrame:
    """(incident_id, seed_id) of campaigns among closed incidents.

    Incidents are taken in order (``ord``).  A seed takes every later unused
    incident that shares an entity with it; so an incident is a seed exactly when
    it shares no entity with an earlier seed.  Each round finds the seeds that are certain, drops
    whatever touches them and goes on with the rest: exact, and without bringing a group together.
    Once a count proves that at most ``replay_rows`` links are left, one task replays them in order.
    """
    from wardline.operators.segmented import salted_join
    from wardline.session import checkpoint, forget

    closed = incidents.where("status = 'closed'").select("incident_id", F.struct("ord", "incident_id").alias("o"))
    links = checkpoint(salted_join(entities, closed, ["incident_id"], "inner").select("incident_id", "entity", "o").distinct())
    undecided, seeds = links, links.limit(0)
    while (left := undecided.count()) > 0:
        if left <= replay_rows:
            ordered = undecided.repartition(1).sortWithinPartitions("o").select("incident_id", "entity")
            kind = links.schema["incident_id"].dataType.simpleString()
            new, settled = ordered.mapInPandas(_replay, f"incident_id {kind}"), True
        else:
            new, settled = _forced(undecided), False
        new_links = checkpoint(undecided.join(new, "incident_id", "left_semi"))
        seeds = seeds.unionByName(new_links)
        if settled:
            break
        touched = salted_join(undecided, new_links.select("entity").distinct(), ["entity"], "left_semi").select("incident_id").distinct()
        last, undecided = undecided, checkpoint(undecided.join(touched, "incident_id", "left_anti"))
        if last is not links:
            forget(last)
    seeds = checkpoint(seeds)
    owner = seeds.select("entity", F.col("o").alias("_owner"))  # one seed at most per entity
    return salted_join(links, owner, ["entity"], "inner").groupBy("incident_id").agg(F.min("_owner").alias("_s")).select(
        "incident_id", F.col("_s.incident_id").alias("seed_id"))


def detect_campaigns(incidents: DataFrame, entities: DataFrame) -> DataFrame:
    """Campaigns of at least two incidents: size, span and number of entities all members share."""
    members = campaign_members(incidents, entities)
    sizes = members.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n_incidents")).where("n_incidents >= 2")
    span = members.join(incidents.select("incident_id", "first_us", "last_us"), "incident_id").groupBy("seed_id").agg(
        F.least(F.min("first_us"), F.min("last_us")).alias("first_us"), F.greatest(F.max("first_us"), F.max("last_us")).alias("last_us"))
    common = shared_entities(members, entities).groupBy("seed_id").agg(F.count(F.lit(1)).alias("n_shared"))
    return sizes.join(span, "seed_id").join(common, "seed_id", "left").select(
        F.concat(F.lit("camp-"), "seed_id").alias("campaign_id"), "seed_id", "n_incidents", "first_us", "last_us", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


def shared_entities(members: DataFrame, entities: DataFrame) -> DataFrame:
    """(seed_id, entity) present in every member of a campaign."""
    sizes = members.groupBy("seed_id").agg(F.count(F.lit(1)).alias("_n"))
    from wardline.operators.segmented import salted_join

    held = salted_join(entities.select("incident_id", "entity").distinct(), members, ["incident_id"], "inner").groupBy("seed_id", "entity").agg(F.count(F.lit(1)).alias("_k"))
    return held.join(sizes, "seed_id").where("_k = _n").select("seed_id", "entity")
