"""Packets to flows, directions and stream coverage."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.functions import ids, labels
from postern.functions.columns import col
from postern.operators.folds import fold_groups
from postern.operators.slices import sliced_running_max

U32 = 4_294_967_296
FLOW = ["capture_id", "flow"]
DIRECTION = [*FLOW, "direction"]
LOCATED = ["flow", "direction", "a_ip", "a_port", "b_ip", "b_port"]
SLICE_BYTES = 1 << 20


def _address(ip: str) -> Column:
    """A dotted address as its numbers, which order like the address; the text is split once, and Spark compiles all of it."""
    return F.split(F.col(ip), r"\.").cast("array<bigint>")


def with_flow(packets: DataFrame) -> DataFrame:
    """Canonical flow (endpoints by numeric address, then port) and the packet's direction a or b; packets that have them stay as they are.

    Endpoints are compared once and everything else follows from that flag: nested
    endpoint structs made generated code of which the JVM compiles no part.
    """
    if set(LOCATED) <= set(packets.columns):
        return packets
    numbered = packets.withColumns({"_s": _address("src_ip"), "_t": _address("dst_ip")})
    p = numbered.withColumn("_forward", F.struct("_s", "src_ip", "src_port") <= F.struct("_t", "dst_ip", "dst_port"))
    pick = lambda forward, backward: F.when(F.col("_forward"), F.col(forward)).otherwise(F.col(backward))
    p = p.select(
        *packets.columns, F.when(F.col("_forward"), "a").otherwise("b").alias("direction"), pick("src_ip", "dst_ip").alias("a_ip"),
        pick("src_port", "dst_port").alias("a_port"), pick("dst_ip", "src_ip").alias("b_ip"), pick("dst_port", "src_port").alias("b_port"),
    )
    part = lambda e: F.concat(F.col(f"{e}_ip"), F.lit("|"), F.col(f"{e}_port").cast("string"))
    return p.select(
        *packets.columns, F.concat(F.lit("tcp|"), part("a"), F.lit("|"), part("b")).alias("flow"), *LOCATED[1:]
    )


def _identity_and_counts() -> list[Column]:
    point = F.struct("ts", "number", "tcp_flags")
    return [
        F.first("a_ip").alias("a_ip"), F.first("a_port").alias("a_port"), F.first("b_ip").alias("b_ip"), F.first("b_port").alias("b_port"),
        F.count("*").alias("packet_count"), F.count_if(F.col("direction") == "a").alias("packets_a"),
        F.count_if(F.col("direction") == "b").alias("packets_b"), F.min(point).alias("first"), F.max(point).alias("last"),
    ]


def _syn_flags() -> list[Column]:
    syn = (F.col("tcp_flags").bitwiseAND(2) != 0) & (F.col("tcp_flags").bitwiseAND(16) == 0)
    synack = F.col("tcp_flags").bitwiseAND(18) == 18
    seen = lambda flag, d: F.bool_or(flag & (F.col("direction") == d))
    return [seen(syn, "a").alias("syn_a"), seen(syn, "b").alias("syn_b"), seen(synack, "a").alias("synack_a"), seen(synack, "b").alias("synack_b")]


def build_flows(packets: DataFrame) -> DataFrame:
    """One row per flow: identity, packets per direction, first and last packet by (time, number)."""
    return with_flow(packets).groupBy(*FLOW).agg(*_identity_and_counts()).withColumn("session_id", ids.session_id("capture_id", "flow"))


def oriented_flows(packets: DataFrame) -> DataFrame:
    """Rows of ``build_flows`` with ``server_side`` and ``basis`` of ``flow_orientation`` and whether a FIN or RST was seen, by one pass over the packets."""
    terminated = F.bool_or(F.col("tcp_flags").bitwiseAND(5) != 0).alias("terminated")
    flows = with_flow(packets).groupBy(*FLOW).agg(*_identity_and_counts(), *_syn_flags(), terminated).withColumn("session_id", ids.session_id("capture_id", "flow"))
    server, basis = _orientation()
    return flows.withColumns({"server_side": server, "basis": basis}).drop("syn_a", "syn_b", "synack_a", "synack_b")


def flow_orientation(packets: DataFrame) -> DataFrame:
    """Client and server per flow: SYN evidence, else exactly one well-known port, else unknown."""
    flags = with_flow(packets).groupBy(*FLOW, "a_ip", "a_port", "b_ip", "b_port").agg(*_syn_flags())
    server, basis = _orientation()
    return flags.select(*FLOW, "a_ip", "a_port", "b_ip", "b_port", server.alias("server_side"), basis.alias("basis"))


def _orientation() -> tuple[Column, Column]:
    port_a, port_b = labels.port_protocol("a_port").isNotNull(), labels.port_protocol("b_port").isNotNull()
    server = (
        F.when(F.col("syn_a") & F.col("synack_b"), "b").when(F.col("syn_b") & F.col("synack_a"), "a")
        .when(port_b & ~port_a, "b").when(port_a & ~port_b, "a")
    )
    basis = F.when((F.col("syn_a") & F.col("synack_b")) | (F.col("syn_b") & F.col("synack_a")), "syn").when(server.isNotNull(), "well_known_service_port")
    return server, basis


def normalize_sequence(packets: DataFrame) -> DataFrame:
    """Data segments with stream offsets: base is the sequence of the last SYN of the file + 1, else the smallest sequence.

    A direction without data, or of packets that miss an address, is one row without a segment. Packets meet once, in
    windows over their direction. A ``session_id`` they carry stays and is part of the windows, so that packets which are
    partitioned by it are not shuffled again.
    """
    p = with_flow(packets)
    keys = [*DIRECTION, *(["session_id"] if "session_id" in p.columns else [])]
    stream = W.partitionBy(*keys)
    syn = F.col("tcp_flags").bitwiseAND(2) != 0
    data = F.coalesce(F.length("payload") > 0, F.lit(False))
    located = p.select(*keys, "number", "ts", "tcp_seq", "tcp_flags", "payload").withColumn("place", F.row_number().over(stream.orderBy("number"))).withColumns({
        "isn": F.max_by(F.when(syn, F.col("tcp_seq")), F.when(syn, F.col("number"))).over(stream),
        "lowest": F.min(F.when(data, F.col("tcp_seq"))).over(stream), "held": F.bool_or(data).over(stream),
        "fin": F.bool_or(F.col("tcp_flags").bitwiseAND(1) != 0).over(stream), "rst": F.bool_or(F.col("tcp_flags").bitwiseAND(4) != 0).over(stream),
    }).withColumn("base", F.coalesce(F.pmod(F.col("isn") + 1, F.lit(U32)), F.col("lowest"), F.lit(0)))
    whole = F.col("held") & F.col("capture_id").isNotNull() & F.col("flow").isNotNull()
    segment = lambda c: F.when(whole, F.col(c)).alias(c)
    start = F.pmod(F.col("tcp_seq") - F.col("base"), F.lit(U32))
    return (
        located.where(F.when(whole, data).otherwise(F.col("place") == 1)).select(*keys, "fin", "rst", "base", *[segment(c) for c in ("number", "ts", "tcp_seq", "payload")])
        .withColumn("start", start).withColumn("stale", F.coalesce(F.col("start") >= U32 // 2, F.lit(False)))
        .withColumn("end", F.col("start") + F.length("payload"))
        .select(*keys, "fin", "rst", "base", "number", "ts", "start", "end", "stale", "payload")
    )


def stream_coverage(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes reconstructed and gaps per stream: union of the intervals, independent of arrival order.

    The running end is computed by slices of stream offset, so one giant stream
    is spread over many tasks.
    """
    rows = segments.select(*keys, "start", "end")
    running = sliced_running_max(rows, keys, F.call_function("div", F.col("start"), F.lit(SLICE_BYTES)), [F.col("start"), F.col("end")], "end", "reach")
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("reach", F.col("start"))))
    gap = F.greatest(F.lit(0), F.col("start") - F.coalesce("reach", F.col("start")))
    return running.groupBy(*keys).agg(
        F.sum(fresh).cast("bigint").alias("bytes_reconstructed"), F.count_if(gap > 0).alias("gap_count"), F.sum(gap).cast("bigint").alias("gap_bytes")
    )


def completeness(gap_count: str, gap_bytes: str, terminated: str | Column) -> tuple[Column, Column]:
    """(complete, reason): no gaps and a FIN or RST."""
    ended = F.coalesce(col(terminated), F.lit(False))
    gaps = F.col(gap_count) > 0
    reason = F.concat_ws(
        "; ", F.when(gaps, F.format_string("%d gap(s) covering %d byte(s)", gap_count, gap_bytes)),
        F.when(~ended, F.lit("no FIN or RST observed (no graceful termination)")),
    )
    complete = ~gaps & ended
    return complete, F.when(~complete, reason)


PLACED = "start bigint, stop bigint, number bigint, ts double, data binary, duplicate bigint, retransmitted bigint, segments bigint"


def place(rows: Iterator[dict]) -> Iterator[tuple]:
    """First arrival wins: every segment keeps only the bytes nobody placed before it.

    A piece leaves as soon as it is placed; only interval bounds stay. The counts
    of the stream follow as a last row without a place.
    """
    starts: list[int] = []
    ends: list[int] = []
    same = again = count = 0
    for row in rows:
        start, stop, payload = row["start"], row["end"], row["payload"]
        count += 1
        cursor, covered, touched = start, 0, 0
        at = bisect_left(ends, start + 1)
        while cursor < stop:
            limit = starts[at] if at < len(starts) else stop
            if cursor < limit:
                end = min(limit, stop)
                starts.insert(at, cursor)
                ends.insert(at, end)
                yield cursor, end, row["number"], row["ts"], None if payload is None else payload[cursor - start : end - start], None, None, None
                cursor = end
            else:
                touched += 1
                covered += min(ends[at], stop) - cursor
                cursor = ends[at]
            at += 1
        if covered == stop - start and touched == 1:
            same += 1
        elif covered:
            again += 1
    yield None, None, None, None, None, same, again, count


def stream_pieces(segments: DataFrame, keys: list[str], key_ddl: str, placed: bool = False) -> DataFrame:
    """Placed pieces per stream with duplicate and retransmission counts, in arrival order: the packets' order in the file, also where clocks step back.

    One TCP direction is sequential by nature; its bytes are never held together.
    ``offset`` is a piece's place in the reconstructed bytes, without gaps: a running
    sum behind the fold, which no other reader of the fold makes Spark run again. The
    row of counts has no place and comes first in it. ``placed``: the segments of a
    stream are in one partition already.
    """
    fresh = segments.where(~F.coalesce("stale", F.lit(False)) & F.col("start").isNotNull()).select(*keys, "number", "ts", "start", "end", "payload")
    laid_down = fold_groups(fresh.dropna(subset=keys), keys, ["number"], place, f"{key_ddl}, {PLACED}", placed)
    so_far = W.partitionBy(*keys).orderBy(F.col("start").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.col("stop") - F.col("start")
    laid = laid_down.withColumns({"offset": (F.sum(size).over(so_far) - size).cast("bigint"), **{c: F.first(c).over(so_far) for c in ("duplicate", "retransmitted", "segments")}})
    return laid.where("start IS NOT NULL").select(*keys, "start", "stop", "number", "ts", "data", "offset", "duplicate", "retransmitted", "segments")
