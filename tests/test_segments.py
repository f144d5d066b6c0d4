"""Packets meet once on their way to pieces, and pieces tell the coverage of their segments."""

import random

from pyspark.sql import functions as F

from postern.operators import flows as FL
from postern.operators.reconstruct import STREAM, Reconstruction

PACKET = "capture_id string, number bigint, ts double, src_ip string, dst_ip string, src_port int, dst_port int, tcp_flags int, tcp_seq bigint, payload binary, captured_len int"


def packet(number, seq, data, flags=24, capture="c", src="10.0.0.1", forth=True):
    ends = (src, "10.0.0.2", 40000, 25)
    ends = ends if forth else (ends[1], ends[0], ends[3], ends[2])
    return (capture, number, float(number), *ends, flags, seq, data, 60)


def test_directions_without_segments_stay_rows(spark):
    rows = [
        packet(1, 4294967290, b"", 2), packet(2, 4294967291, b"abcdef"), packet(3, 1, b"xyz"), packet(4, 4, b"", 17), packet(5, 99, b"", 18, forth=False),
        packet(6, 7, b"lost", src=None), packet(7, 8, None, 4, src=None), packet(8, 7, b"lost", capture=None), packet(9, 500, b"late", capture="d"), packet(10, 400, b"early", capture="d", flags=None),
    ]
    got = {(r["capture_id"], r["flow"], r["direction"], r["number"]): (r["fin"], r["rst"], r["base"], r["start"], r["end"], r["stale"], r["payload"] and bytes(r["payload"])) for r in FL.normalize_sequence(spark.createDataFrame(rows, PACKET)).collect()}
    flow = "tcp|10.0.0.1|40000|10.0.0.2|25"
    assert got == {
        ("c", flow, "a", 2): (True, False, 4294967291, 0, 6, False, b"abcdef"), ("c", flow, "a", 3): (True, False, 4294967291, 6, 9, False, b"xyz"),
        ("c", flow, "b", None): (False, False, 100, None, None, False, None), ("c", None, "a", None): (False, True, 7, None, None, False, None),
        (None, flow, "a", None): (False, False, 7, None, None, False, None),
        ("d", flow, "a", 9): (False, False, 400, 100, 104, False, b"late"), ("d", flow, "a", 10): (False, False, 400, 0, 5, False, b"early"),
    }


def test_packets_are_shuffled_once_for_their_pieces(spark):
    draw = random.Random(4)
    rows = []
    for flow in range(30):
        for number in range(25):
            start = draw.randrange(200)
            rows.append(packet(number, 1000 + start, bytes([65 + flow]) * draw.randrange(1, 30), 24 if number != 20 or flow % 2 else 17, capture=f"c{flow % 7}", src=f"10.0.{flow}.1", forth=draw.random() < 0.5))
    packets = spark.createDataFrame(rows, PACKET)
    r = Reconstruction(packets)
    plan = r.pieces._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the packets, and what the fold has placed
    segments = FL.normalize_sequence(packets).where("start IS NOT NULL AND NOT stale").withColumn("session_id", F.lit(None))
    keys = ["capture_id", "flow", "direction"]
    named = r.pieces.join(r.flows.select("capture_id", "session_id", "flow"), ["capture_id", "session_id"])
    rows_of = lambda df: sorted(tuple(x) for x in df.select(*keys, "bytes_reconstructed", "gap_count", "gap_bytes").collect())
    want = rows_of(FL.stream_coverage(segments, keys))
    assert rows_of(FL.stream_coverage(named.withColumnRenamed("stop", "end"), keys)) == want and any(w[4] for w in want) and len(want) > 50
    ended = {x["flow"]: x["complete"] for x in r.sessions.join(r.flows.select("session_id", "flow"), "session_id").collect()}
    gapless = {w[1] for w in want} - {w[1] for w in want if w[4]}
    fin = {x["flow"] for x in FL.with_flow(packets).where("tcp_flags = 17").select("flow").collect()}
    assert ended == {f: f in gapless and f in fin for f in ended} and len(ended) == 30
    assert r.pieces.groupBy(*STREAM, "start").count().where("count > 1").count() == 0


def test_stored_segments_are_brought_together_again(spark):
    """A reconstruction that stores its segments gives the same pieces."""
    rows = [packet(k, 1000 + 3 * k, b"abcd", capture=f"c{k % 5}") for k in range(60)]
    packets = spark.createDataFrame(rows, PACKET)
    stored = Reconstruction(packets, lambda name, build: build().repartition(7) if name == "segments" else build())
    shown = lambda r: sorted(str(x) for x in r.pieces.select(*STREAM, "start", "stop", "offset", "duplicate", "retransmitted", "segments").collect())
    assert shown(stored) == shown(Reconstruction(packets)) and len(shown(stored)) == 60


def test_heads_are_shuffled_once_for_the_roles(spark):
    r = Reconstruction(spark.createDataFrame([packet(k, 1000 + 3 * k, b"220 x ESMTP\r\n", capture=f"c{k % 5}", forth=k % 2 == 0) for k in range(20)], PACKET))
    r.__dict__["pieces"] = r.pieces.localCheckpoint()
    r.__dict__["flows"] = r.flows.localCheckpoint()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = r.roles._jdf.queryExecution().executedPlan().toString()
        rows = r.roles.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with_heads = [line for line in plan.splitlines() if "Exchange" in line and "REPARTITION" in line]
    assert len(with_heads) == 1 and plan.count("Exchange hashpartitioning") <= 3  # and the flows on both sides of their joins
    assert len(rows) == 5 and {(x["protocol"], x["server_side"]) for x in rows} == {("smtp", "b")}
