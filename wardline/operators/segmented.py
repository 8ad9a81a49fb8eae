"""Windows that survive hot keys: scans split into bounded segments with a carry.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  When
one key owns a third of the data that task never ends.  Here a scan runs inside
(key, segment) partitions, each segment is reduced to one summary row, a window
over the few summaries of a key yields what to carry in, and a join on
(key, segment) adds it.  Rows are shuffled once, by (key, segment).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SEGMENT_US = 60_000_000


def time_segment(ts_us: Column, segment_us: int = DEFAULT_SEGMENT_US) -> Column:
    return F.floor(ts_us / F.lit(segment_us)).cast("bigint")


def null_safe(left: str, right: str, columns: list[str]) -> Column:
    """Equality of columns under two join aliases, NULL equal to NULL."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def segmented_scan(df: DataFrame, keys: list[str], segment: Column, order: list[str],
                   scans: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add running columns over all rows of ``keys`` in ``order``.

    ``scans`` maps the new column to (kind, value):
    ``lag`` value of the previous row, ``sum``/``max``/``min`` up to and including
    the row, ``last`` latest non-null value up to the row, ``count`` rows so far.
    ``segment`` must not decrease along ``order``.
    """
    work = df.withColumn("_seg", segment)
    for name, (_, value) in scans.items():
        work = work.withColumn(f"_v_{name}", value)
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.struct(*order)

    local, summary, carry = {}, [], {}
    for name, (kind, _) in scans.items():
        v, s = F.col(f"_v_{name}"), f"_s_{name}"
        if kind == "lag":
            local[name] = F.lag(v).over(inside)
            summary.append(F.max_by(v, rank).alias(s))
            carry[name] = F.last(F.col(s)).over(earlier)
        elif kind == "last":
            local[name] = F.last(v, ignorenulls=True).over(upto)
            summary.append(F.max_by(v, F.when(v.isNotNull(), rank)).alias(s))
            carry[name] = F.last(F.col(s), ignorenulls=True).over(earlier)
        elif kind == "count":
            local[name] = F.count(F.lit(1)).over(upto)
            summary.append(F.count(F.lit(1)).alias(s))
            carry[name] = F.sum(s).over(earlier)
        else:
            fn = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
            local[name] = fn(v).over(upto)
            summary.append(fn(v).alias(s))
            carry[name] = fn(F.col(s)).over(earlier)

    totals = work.groupBy(*keys, "_seg").agg(*summary)
    carried = totals.select(*keys, "_seg", *[c.alias(f"_c_{n}") for n, c in carry.items()])
    first = F.row_number().over(inside) == 1
    rows = work.select("*", first.alias("_first"), *[c.alias(f"_l_{n}") for n, c in local.items()])
    joined = rows.alias("l").join(carried.alias("r"), null_safe("l", "r", [*keys, "_seg"]), "left")

    out = []
    for name, (kind, _) in scans.items():
        here, before = F.col(f"l._l_{name}"), F.col(f"r._c_{name}")
        if kind == "lag":
            value = F.when(F.col("l._first"), before).otherwise(here)
        elif kind == "last":
            value = F.coalesce(here, before)
        elif kind in ("sum", "count"):
            value = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        else:
            value = {"max": F.greatest, "min": F.least}[kind](here, before)
        out.append(value.alias(name))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], *out)


def trailing_count(df: DataFrame, keys: list[str], ts_us: str, width_us: int, name: str,
                   include_start: bool = False) -> DataFrame:
    """Rows of the same key in the trailing window ending at each row.

    A row adds 1 at its time and takes it back when it leaves the window, so the count is
    one running sum (a growing frame, linear in the rows).  A row counts in its own and the
    next width-sized bucket: a window partition holds two widths of one key and never the
    whole key.  ``include_start`` keeps rows exactly ``width_us`` old.  Rows without a time are dropped.
    """
    reach = width_us if include_start else width_us - 1
    t = F.col(ts_us)
    here = F.floor(t / width_us).cast("bigint")
    entry = lambda b, at, w, row: F.struct(b.alias("b"), at.cast("bigint").alias("at"), F.lit(w).alias("w"), row.alias("row"))
    row = F.struct(*[F.col(c) for c in df.columns])
    none = F.lit(None).cast(df.select(row.alias("r")).schema["r"].dataType)
    # a row leaves at t + reach + 1, which is never in its own bucket
    steps = F.array(entry(here, t, 1, row), entry(here + 1, t, 1, none), entry(here + 1, t + reach + 1, -1, none))
    spread = df.where(t.isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.explode(steps).alias("_e"))
    frame = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))], "_e.b").orderBy("_e.at").rangeBetween(Window.unboundedPreceding, 0)
    counted = spread.withColumn("_n", F.sum("_e.w").over(frame)).where("_e.row IS NOT NULL")
    return counted.select(*[F.col(f"_e.row.{c}") for c in df.columns], F.col("_n").alias(name))


def gap_islands(df: DataFrame, keys: list[str], ts_us: str, tie: str, gap_us: int,
                island: str = "island") -> DataFrame:
    """Number the runs of each key that are separated by gaps of at least ``gap_us``.

    Breaks inside a segment are counted there; whether a segment begins with a
    break follows from the end of the one before it.
    """
    work = df.withColumn("_seg", time_segment(F.col(ts_us), max(gap_us, DEFAULT_SEGMENT_US)))
    inside = Window.partitionBy(*keys, "_seg").orderBy(ts_us, tie)
    starts = F.when(F.col(ts_us) - F.lag(ts_us).over(inside) >= gap_us, 1).otherwise(0)
    marked = work.withColumn("_start", starts)
    rows = marked.withColumn("_local", F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy(*keys, "_seg").agg(F.min(ts_us).alias("_a"), F.max(ts_us).alias("_b"), F.sum("_start").alias("_n"))
    by_key = Window.partitionBy(*keys).orderBy("_seg")
    before = F.lag("_b").over(by_key)
    ends = ends.withColumn("_new", F.when(before.isNull() | (F.col("_a") - before >= gap_us), 1).otherwise(0))
    carry = F.sum(F.col("_n") + F.col("_new")).over(by_key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ends = ends.select(*keys, "_seg", carry.alias("_carry"))
    joined = rows.alias("l").join(ends.alias("r"), null_safe("l", "r", [*keys, "_seg"]), "inner")
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._local") + F.col("r._carry")).alias(island))


def first_seen(df: DataFrame, keys: list[str], value: str, name: str = "first_seen") -> DataFrame:
    """Add the least ``value`` of each key by aggregate and join (no window over the key)."""
    least = df.groupBy(*keys).agg(F.min(value).alias(name))
    return salted_join(df, least, keys, "left")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
                salts: int = 16) -> DataFrame:
    """Equi-join to a side with few rows per key; hot keys of ``left`` are spread.

    ``left`` rows get one of ``salts`` numbers from the hash of the whole row and
    ``right`` is repeated once per number.  Results are those of the plain join.
    The copies are always shuffled: Spark's size estimate leaves out their repetition
    and would have the driver collect a large side for a broadcast.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(how)
    hashable = [f.name for f in left.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return spread.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def bounded_broadcast(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 10 << 20) -> tuple[DataFrame, bool]:
    """Broadcast hint if a count proves the table holds at most ``max_rows`` rows and ``max_bytes`` of values as text."""
    width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("bigint") for c in df.columns])
    rows, size = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    small = rows <= max_rows and (size or 0) <= max_bytes
    return (F.broadcast(df) if small else df), small


def dimension_join(left: DataFrame, dim: DataFrame, keys: list[str], how: str = "left",
                   max_rows: int = 200_000) -> DataFrame:
    """Join a dimension: broadcast when its size is proven small, else salted."""
    hinted, small = bounded_broadcast(dim, max_rows)
    return left.join(hinted, keys, how) if small else salted_join(left, dim, keys, how)
