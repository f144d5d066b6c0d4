"""Steps whose cost must grow with the tables and spread over tasks."""

import struct
from datetime import date

from pyspark.sql import functions as F

from postern.operators import flows as FL
from postern.operators import graph as G
from postern.plans.workspace import Workspace
from postern.sources import captures as C


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def packets(spark):
    rows = [("c", 1, "10.0.0.9", "9.255.255.255", 25, 40000), ("c", 2, "9.255.255.255", "10.0.0.9", 40000, 25), ("c", 3, "10.0.0.9", "10.0.0.9", 7, 5), ("c", 4, "10.0.0.9", "10.0.0.9", 5, 5), ("c", 5, None, "10.0.0.9", 1, 2)]
    return spark.createDataFrame(rows, "capture_id string, number bigint, src_ip string, dst_ip string, src_port int, dst_port int")


def test_flows_order_endpoints_by_number_and_split_an_address_once(spark):
    p = FL.with_flow(packets(spark))
    got = {r["number"]: (r["flow"], r["direction"], r["a_ip"], r["a_port"], r["b_ip"], r["b_port"]) for r in p.collect()}
    one = ("9.255.255.255", 40000, "10.0.0.9", 25)
    assert got[1] == ("tcp|9.255.255.255|40000|10.0.0.9|25", "b", *one) and got[2] == ("tcp|9.255.255.255|40000|10.0.0.9|25", "a", *one)
    assert got[3][0] == "tcp|10.0.0.9|5|10.0.0.9|7" and got[3][1] == "b"
    assert got[4][1] == "a" and got[5] == (None, "a", None, 1, "10.0.0.9", 2)
    assert optimized(p).count("split(") <= 2


def test_session_numbers_are_spread_over_tasks(spark, tmp_path):
    spark.createDataFrame([(0, "ALGERIA", 0), (1, "PERU", 1)], "n_nationkey int, n_name string, n_regionkey int").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(10)], "c_custkey bigint, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, k % 10, date(1995, 1, 1)) for k in range(400)], "o_orderkey bigint, o_custkey bigint, o_orderdate date").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    numbers = Workspace(spark, str(tmp_path)).session_numbers
    assert numbers.count() == 400 and len(numbers.inputFiles()) > 1


def test_depth_collapses_parallel_edges_after_the_join(spark, monkeypatch):
    nodes = spark.createDataFrame([("c", "r", "capture"), ("c", "h", "host"), ("c", "s", "session"), ("c", "x", "host")], "capture_id string, node_id string, node_type string")
    edges = spark.createDataFrame([("c", "r", "h", k, "") for k in ("one", "two")] + [("c", "h", "s", "t", ""), ("c", "s", "h", "t", "")], "capture_id string, source_node_id string, target_node_id string, edge_type string, basis string")
    steps, cut = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: steps.append(optimized(df)) or cut(df))
    got = {r["node_id"]: r["depth"] for r in G.graph_depth(nodes, edges).collect()}
    assert got == {"r": 0, "h": 1, "s": 2, "x": 3}
    assert all(plan.count("Aggregate [") == 1 for plan in steps[1:])


def capture(bodies) -> bytes:
    record = lambda body: struct.pack("<4I", 5, 6, len(body), len(body)) + body
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, 1) + b"".join(map(record, bodies))


def test_small_parts_do_not_multiply_a_container(spark):
    data = capture([b"\0" * 100] * 400)
    files = spark.createDataFrame([("c", data)], "capture_id string, content binary")
    assert C.container_parts(files, 256).agg(F.sum(F.length("content"))).first()[0] <= len(data)
    assert C.part_starts(C.container_parts(files, 256), 256).count() >= 181  # records of 116 bytes begin in every part


def frame(payload: bytes) -> bytes:
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40 + len(payload), 0, 0, 64, 6, 0, b"\x0a\0\0\1", b"\x0a\0\0\2")
    return b"\0" * 12 + b"\x08\x00" + ip + struct.pack(">HHIIBBHHH", 1, 25, 7, 8, 0x50, 24, 9, 0, 0) + payload


def test_runs_of_several_parts_give_the_same_packets(spark):
    """Runs of two parts each: three of a plain file, two of one whose payloads look like headers, and a file cut short that is one run."""
    fake = struct.pack("<4I", 1, 2, 20, 20) + b"x" * 20
    whole = capture([frame(bytes([k % 251]) * (60_000 + k)) for k in range(230)])
    files = spark.createDataFrame([("a", whole), ("b", capture([frame(fake * 1500)] * 230)), ("c", whole[: 6 << 20])], "capture_id string, content binary")
    assert C.container_parts(files, 3 << 20).count() == 6
    rows = lambda size: sorted(map(tuple, C.parse_packets(files, size).select("capture_id", "number", "ts", "problem", F.md5("payload")).collect()), key=str)
    assert rows(3 << 20) == rows(1 << 28)
    assert len(rows(3 << 20)) == 565
