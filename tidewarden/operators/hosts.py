"""What a source host has done: distinct destinations so far, and flows, bytes and packets of late.

Times are event times. A record or window sees everything its host did up to and including its own last
moment; "recent" reaches back ``width`` before its first moment, exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.functions.records import micros, or_default, total_bytes, total_packets
from tidewarden.operators.running import running_totals, totals_between
from tidewarden.session import materialize

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DISTINCT = ("unique_dst_ips", "unique_dst_ports")
RECENT = ("recent_flows", "recent_bytes", "recent_packets")


def host_records(records: DataFrame) -> DataFrame:
    """Records that count for a host: the source must be known."""
    return records.filter(or_default("src_ip", "") != "")


def first_contacts(records: DataFrame) -> DataFrame:
    """When each host first reached each address and port; reduced per pair before the shuffle."""
    address = F.when(or_default("dst_ip", "") != "", F.struct(F.lit(DISTINCT[0]).alias("kind"), F.col("dst_ip").alias("dst")))
    port = F.when(
        or_default("dst_port", 0) != 0,
        F.struct(F.lit(DISTINCT[1]).alias("kind"), F.col("dst_port").cast("string").alias("dst")),
    )
    return (
        host_records(records)
        .select("src_ip", micros().alias("at"), F.explode(F.array_compact(F.array(address, port))).alias("to"))
        .groupBy("src_ip", "to.kind", "to.dst")
        .agg(F.min("at").alias("at"))
    )


def contact_events(records: DataFrame) -> DataFrame:
    one = lambda kind: (F.col("kind") == kind).cast("int").alias(kind)
    return first_contacts(records).select("src_ip", "at", *[one(kind) for kind in DISTINCT])


def host_events(records: DataFrame) -> DataFrame:
    """(src_ip, at) rows carrying what each adds to its host's totals."""
    seen = host_records(records).select(
        "src_ip", micros().alias("at"), F.lit(1).alias("recent_flows"),
        total_bytes().alias("recent_bytes"), total_packets().alias("recent_packets"),
    )
    return seen.unionByName(contact_events(records), allowMissingColumns=True)


def slice_for(width: int) -> int:
    """Slices of an hour, narrower for narrow windows down to a minute.

    A sliding sum is the difference of two running totals, so a slice need not hold a whole window; a busy host's
    day is sorted in many tasks.
    """
    return min(max(width, MINUTE), HOUR)


def host_context(
    records: DataFrame, probes: DataFrame, probe_id: list[str], width: int, slice_width: int | None = None,
    max_history: int | None = None,
) -> DataFrame:
    """Host totals for probes (src_ip, *probe_id, first_at, last_at), linear in records whatever the width.

    ``max_history`` limits "recent" to a host's newest that many records at the probe's last moment.
    """
    slices = slice_width or slice_for(width)
    asked = probes.select("src_ip", *probe_id, (F.col("first_at") - width).alias("since"), F.col("last_at").alias("until"))
    totals = {n: F.col(n) for n in (*DISTINCT, *RECENT)}
    if max_history is None:
        return totals_between(host_events(records), asked, ["src_ip"], probe_id, totals, slices, since_start=DISTINCT)
    ever = {f"_ever_{n}": F.col(n) for n in RECENT}
    context = materialize(totals_between(
        host_events(records), asked, ["src_ip"], probe_id, {**totals, **ever}, slices, since_start=(*DISTINCT, *ever)
    ))
    # The second sort of all records is planned only if some host was that busy.
    if context.filter(F.col("recent_flows") > max_history).isEmpty():
        return context.drop(*ever)
    return _newest_only(context, records, probe_id, slices, max_history)


def _newest_only(context: DataFrame, records: DataFrame, probe_id: list[str], slices: int, limit: int) -> DataFrame:
    """Where more than ``limit`` records are recent, subtract what lies before the newest ``limit``.

    The totals at that place are found by position, an equality join without skew.
    """
    seen = host_records(records).select(
        "src_ip", micros().alias("at"), "record_id", total_bytes().alias("b"), total_packets().alias("p")
    )
    placed = running_totals(
        seen, ["src_ip"], ["at", "record_id"], {"_pos": F.lit(1), "_b": F.col("b"), "_p": F.col("p")}, slices
    ).select("src_ip", "_pos", "_b", "_p")
    over = F.col("recent_flows") > limit
    before = context.withColumn("_pos", F.when(over, F.col("_ever_recent_flows") - limit))
    joined = before.join(placed, ["src_ip", "_pos"], "left")
    return joined.select(
        "src_ip", *probe_id, *DISTINCT,
        F.least("recent_flows", F.lit(limit).cast("long")).alias("recent_flows"),
        F.when(over, F.col("_ever_recent_bytes") - F.col("_b")).otherwise(F.col("recent_bytes")).alias("recent_bytes"),
        F.when(over, F.col("_ever_recent_packets") - F.col("_p")).otherwise(F.col("recent_packets")).alias("recent_packets"),
    )


def distinct_so_far(records: DataFrame, slice_width: int = HOUR) -> DataFrame:
    """Per record: distinct destination addresses and ports of its host up to its time."""
    at = micros()
    probes = host_records(records).select("src_ip", "record_id", at.alias("since"), at.alias("until"))
    return totals_between(
        contact_events(records), probes, ["src_ip"], ["record_id"], {n: F.col(n) for n in DISTINCT}, slice_width, since_start=DISTINCT
    )


def trailing_totals(records: DataFrame, width: int, slice_width: int | None = None) -> DataFrame:
    """Per record: flows, bytes and packets of its host in ``(ts - width, ts]``."""
    at = micros()
    probes = host_records(records).select("src_ip", "record_id", (at - width).alias("since"), at.alias("until"))
    events = host_records(records).select("src_ip", at.alias("at"), total_bytes().alias("b"), total_packets().alias("p"))
    totals = dict(zip(RECENT, (F.lit(1), F.col("b"), F.col("p"))))
    return totals_between(events, probes, ["src_ip"], ["record_id"], totals, slice_width or slice_for(width))


def last_per_key(df: DataFrame, keys: list[str], newest: list[str], limit: int) -> DataFrame:
    """The newest ``limit`` rows of each key; Spark applies the limit before the shuffle too."""
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in newest])
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit).drop("_rank")


def destination_counts(records: DataFrame, approximate: bool = False) -> DataFrame:
    """Whole-history distinct destinations per host; the approximate form keeps one sketch per host."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    known = lambda c, empty: F.when(or_default(c, empty) != empty, F.col(c))
    return host_records(records).groupBy("src_ip").agg(
        count(known("dst_ip", "")).alias("unique_dst_ips"), count(known("dst_port", 0)).alias("unique_dst_ports")
    )
