"""Steps from packets to sessions run once, and read columns as they are."""

import pyarrow as pa
from pyspark.sql import functions as F

from postern.operators import flows as FL
from postern.operators.folds import batch_of, column_values, equal_runs
from postern.operators.reconstruct import Reconstruction
from postern.sources import wire
from tests.test_growth import optimized

PACKETS = "capture_id string, number bigint, ts double, src_ip string, dst_ip string, src_port int, dst_port int, tcp_flags int, tcp_seq bigint, payload binary"


def packets(spark):
    rows = [("c", 1, 1.0, "10.0.0.9", "9.0.0.1", 40000, 25, 2, 99, b""), ("c", 2, 2.0, "9.0.0.1", "10.0.0.9", 25, 40000, 18, 499, b""), ("c", 3, 3.0, "9.0.0.1", "10.0.0.9", 25, 40000, 24, 500, b"220 hi\r\n")]
    return spark.createDataFrame([*rows, ("d", 1, 1.0, "1.2.3.4", "1.2.3.5", 50000, 110, 24, 7, b"x")], PACKETS)


def test_the_fold_of_a_stream_runs_once(spark):
    rows = [(1, 1, 1.0, 5, 9, b"efgh", False), (1, 2, 2.0, 0, 6, b"abcdeX", False), (1, 3, 3.0, 0, 3, b"abc", False), (None, 1, 1.0, 0, 1, b"z", False)]
    pieces = FL.stream_pieces(spark.createDataFrame(rows, "flow bigint, number bigint, ts double, start bigint, end bigint, payload binary, stale boolean"), ["flow"], "flow bigint")
    assert optimized(pieces).count("MapInArrow") == 1
    got = sorted((r.flow, r.start, r.stop, bytes(r.data), r.offset, r.duplicate, r.retransmitted, r.segments) for r in pieces.collect())
    assert got == [(1, 0, 5, b"abcde", 0, 1, 1, 3), (1, 5, 9, b"efgh", 5, 1, 1, 3)]


def test_flows_and_their_orientation_come_from_one_pass(spark):
    p = packets(spark)
    key = lambda rows: sorted(map(tuple, rows))
    both = FL.build_flows(p).join(FL.flow_orientation(p).select(*FL.FLOW, "server_side", "basis"), FL.FLOW)
    one = FL.oriented_flows(p)
    assert key(one.select(*both.columns).collect()) == key(both.collect())
    assert {(r.capture_id, r.server_side, r.basis) for r in one.collect()} == {("c", "a", "syn"), ("d", "b", "well_known_service_port")}
    r = Reconstruction(p)
    assert {(x.capture_id, x.protocol) for x in r.roles.collect()} == {("c", "smtp"), ("d", None)}


def test_only_the_tables_that_are_asked_for_are_made(spark):
    made = []

    def keep(name, build):
        made.append(name)
        return build()

    r = Reconstruction(packets(spark), keep)
    assert r.pieces.count() == 2 and made == ["pieces", "segments"]
    assert r.roles.count() == 2 and sorted(made) == ["flows", "pieces", "roles", "segments"]
    assert r.events.count() == 1 and "tls" not in made
    assert r.tls.count() == 0 and r.sessions.count() == 2 and len(made) == len(set(made)) == 8


def test_packets_with_their_flow_keep_it(spark):
    p = packets(spark)
    located = FL.with_flow(p)
    assert FL.with_flow(located) is located
    stored = spark.createDataFrame(located.collect(), located.schema)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for step in (FL.build_flows, FL.normalize_sequence, FL.oriented_flows, FL.flow_orientation):
        assert key(step(stored)) == key(step(p)) and "split(" not in optimized(step(stored))


def test_runs_of_equal_keys():
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", None, "z"), (None, None, "u"), (None, None, "v"), ("b", 2, None), ("a", 1, "w")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["k", "n", "t"])
    for part in (batch, batch.slice(1, 4), batch.slice(2, 1)):
        got = [(key, [r["t"] for r in members]) for key, members in equal_runs(part, ["k", "n"])]
        want: list = []
        for k, n, t in zip(*(c.to_pylist() for c in part.columns)):
            if not want or want[-1][0] != (k, n):
                want.append(((k, n), []))
            want[-1][1].append(t)
        assert got == want


def test_columns_read_whole_equal_values_read_one_by_one():
    arrays = [
        pa.array(["a", None, "é"]), pa.array([b"", None, b"\x00\xff"]), pa.array([1, 2, 3], pa.int64()), pa.array([1, None, 3], pa.int32()), pa.array([0.5, None, -1.0]), pa.array([True, False, None]),
        pa.array([[1, 2], [], [3]], pa.list_(pa.int32())), pa.array([[1, None], None, []], pa.list_(pa.int32())), pa.array([["x"], [None, "y"], []]), pa.array([[("k", "v")], [], None], pa.map_(pa.string(), pa.string())),
    ]
    for column in arrays:
        for part in (column, column.slice(1), column.slice(1, 1), column.slice(0, 0)):
            assert column_values(part) == part.to_pylist()
    schema = pa.schema([("a", pa.string()), ("m", pa.map_(pa.string(), pa.string())), ("s", pa.list_(pa.struct([("n", pa.int32())])))])
    rows = [("x", [("k", "v")], [{"n": 1}]), (None, None, [])]
    assert batch_of(rows, schema).to_pylist() == [dict(zip(schema.names, r)) for r in rows]


def test_long_texts_of_a_container_are_built_once(spark):
    numbers = spark.createDataFrame(
        [("s", 1, 3, 11, "smtp", True, 40000, 465, "10.0.0.1", "198.51.100.11", 4, True, None), ("t", 2, 8, 12, "imap", False, 40000, 143, "10.0.0.1", "198.51.100.12", None, False, 0)],
        "session_id string, p long, h long, host long, protocol string, implicit_tls boolean, client_port int, server_port int, client_ip string, server_ip string, cert_no long, complete boolean, at long",
    ).withColumn("started_at", F.timestamp_seconds(F.coalesce("at", F.lit(800_000_000))))
    files = wire.capture_files(numbers)
    assert optimized(files).count("unhex(") == 1 and optimized(files).count("repeat(AB, 32)") <= 4
    content = {r.path: bytes(r.content) for r in files.collect()}
    body = spark.sql(f"SELECT unhex({wire._record('01', wire.CLIENT_BODY, wire.CCS)}) AS x FROM VALUES (1L, 11L) AS t(p, host)").first()[0]
    assert bytes(body) in content["s.pcap"] and content["s.pcap"][24:32] == (800_000_000).to_bytes(4, "big") + bytes(4)


def test_staged_tables_are_written_small(spark):
    from postern.plans.workspace import staged

    table = staged(spark, "small-test", "rows", lambda: spark.range(10))
    assert table.count() == 10 and all(".zstd." in name for name in table.inputFiles())
