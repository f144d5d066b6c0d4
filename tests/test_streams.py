"""Properties of reassembly, ordered folds and sliced running values, against brute force."""

import random
import struct

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.operators import flows as FL
from postern.operators.slices import sliced_row_number, sliced_running_max
from postern.sources import captures as C

DDL = "flow bigint, number bigint, ts double, start bigint, end bigint, payload binary, stale boolean"


def segments(seed, flows=6, count=40):
    rng = random.Random(seed)
    truth = {f: bytes(rng.randrange(256) for _ in range(300)) for f in range(flows)}
    rows = []
    for f in range(flows):
        for n in range(count):
            a = rng.randrange(280)
            b = min(300, a + rng.randrange(1, 30))
            rows.append((f, n, float(n), a, b, truth[f][a:b], False))
    return truth, rows


def brute(rows):
    owned, same, again = set(), 0, 0
    placed = []
    for _, _, _, a, b, _, _ in rows:
        touched = sum(1 for s, e in placed if s < b and e > a)
        overlap = sum(1 for i in range(a, b) if i in owned)
        if overlap == b - a and touched == 1:
            same += 1
        elif overlap:
            again += 1
        run = None
        for i in range(a, b + 1):
            fresh = i < b and i not in owned
            if fresh and run is None:
                run = i
            if not fresh and run is not None:
                placed.append((run, i))
                run = None
        owned |= set(range(a, b))
    return owned, same, again


def test_pieces_match_brute_force_and_coverage_ignores_order(spark):
    truth, rows = segments(7)
    df = spark.createDataFrame(rows, DDL)
    pieces = FL.stream_pieces(df, ["flow"], "flow bigint").collect()
    for f in truth:
        owned, same, again = brute([r for r in rows if r[0] == f])
        mine = sorted((p for p in pieces if p.flow == f), key=lambda p: p.start)
        assert {i for p in mine for i in range(p.start, p.stop)} == owned
        assert b"".join(bytes(p.data) for p in mine) == bytes(truth[f][i] for i in sorted(owned))
        assert (mine[0].duplicate, mine[0].retransmitted) == (same, again)
    cover = {r.flow: (r.bytes_reconstructed, r.gap_count, r.gap_bytes) for r in FL.stream_coverage(df, ["flow"]).collect()}
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    again_cover = {r.flow: (r.bytes_reconstructed, r.gap_count, r.gap_bytes) for r in FL.stream_coverage(spark.createDataFrame(shuffled, DDL), ["flow"]).collect()}
    assert cover == again_cover
    for f in truth:
        assert cover[f][0] == len(brute([r for r in rows if r[0] == f])[0])


def test_sliced_values_equal_plain_windows(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.randrange(3), rng.randrange(1000), i, rng.randrange(500)) for i in range(2000)], "k int, t int, i int, v int")
    w = W.partitionBy("k").orderBy("t", "i")
    order = [F.col("t"), F.col("i")]
    ranked = sliced_row_number(df, ["k"], F.floor(F.col("t") / 10), order, "n").withColumn("m", F.row_number().over(w))
    assert ranked.where("n <> m").count() == 0
    running = sliced_running_max(df, ["k"], F.floor(F.col("t") / 10), order, "v", "r").withColumn(
        "x", F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1))
    )
    assert running.where("NOT (r <=> x)").count() == 0


def frame(flags=0x18, payload=b"hi", proto=6, ether=0x0800, fragment=0):
    tcp = struct.pack(">HHIIBBHHH", 4000, 25, 100, 0, 0x50, flags, 0, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 0, fragment, 64, proto, 0, bytes([10, 0, 0, 9]), bytes([10, 0, 0, 10])) + tcp
    return b"\0" * 12 + struct.pack(">H", ether) + ip


def pcap(frames, magic=b"\xd4\xc3\xb2\xa1", order="<", link=1):
    data = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, link)
    for i, f in enumerate(frames):
        data += struct.pack(order + "IIII", 1000 + i, 500, len(f), len(f)) + f
    return data


def test_containers_and_skips(spark):
    good = frame()
    block = struct.pack("<IIIII", 0, 0, 1_000_000, len(good), len(good)) + good + b"\0" * (-len(good) % 4)
    wrap = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    ng = wrap(0x0A0D0D0A, b"\x4d\x3c\x2b\x1a" + struct.pack("<HHq", 1, 0, -1)) + wrap(1, struct.pack("<HHI", 1, 0, 0)) + wrap(6, block) + wrap(5, b"\0" * 4)
    files = {
        "le": pcap([good, frame(proto=17), frame(ether=0x8100), frame(ether=0x86DD), frame(fragment=0x2000), frame(fragment=1), b"\0" * 5]),
        "ns": pcap([good], b"\xa1\xb2\x3c\x4d", ">"), "raw": pcap([good[14:]], link=101), "ng": ng, "cut": pcap([good])[:-1], "junk": b"no capture at all",
    }
    parsed = C.parse_packets(spark.createDataFrame(list(files.items()), "capture_id string, content binary")).collect()
    ok = {p.capture_id: p for p in parsed if p.problem is None}
    assert set(ok) == {"le", "ns", "raw", "ng"}
    assert all((p.src_ip, p.dst_ip, p.dst_port, bytes(p.payload)) == ("10.0.0.9", "10.0.0.10", 25, b"hi") for p in ok.values())
    assert ok["ng"].ts == 1.0 and abs(ok["ns"].ts - 1000.0000005) < 1e-6
    problems = sorted(p.problem for p in parsed if p.capture_id == "le" and p.problem)
    assert problems == sorted(["non-tcp packet", "vlan-tagged frame", "non-ipv4 ethernet frame", "fragmented ip datagram", "ip fragment", "truncated ethernet frame"])
    assert {p.problem for p in parsed if p.capture_id in ("cut", "junk", "ng") and p.problem} == {"truncated packet record", "unreadable container", "unsupported pcapng block type"}
    formats = {r.f for r in spark.createDataFrame(list(files.items()), "n string, content binary").select(C.capture_format("content").alias("f")).collect()}
    assert formats == {"pcap", "pcapng", None}


def test_malformed_tls_never_raises():
    from postern.operators.tls import hello_facts

    rng = random.Random(5)
    for size in (0, 1, 4, 5, 9, 40, 400):
        hello_facts(bytes(rng.randrange(256) for _ in range(size)), b"\x16\x03\x01\x00\x10" + bytes(rng.randrange(256) for _ in range(size)))


def test_split_containers_give_the_same_packets(spark):
    """Parts of every size, records longer than a part, payloads that look like headers, cut and broken ends."""
    rng = random.Random(3)
    frame = lambda payload: b"\0" * 12 + b"\x08\x00" + struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40 + len(payload), 0, 0, 64, 6, 0, b"\x0a\0\0\1", b"\x0a\0\0\2") + struct.pack(">HHIIBBHHH", 1, 25, 7, 8, 0x50, 24, 9, 0, 0) + payload
    rows = []
    for n, order in enumerate("><><><"):
        record = lambda body, order=order: struct.pack(order + "4I", 5, 6, len(body), len(body)) + body
        fake = b"".join(struct.pack(order + "4I", 1, 2, 20, 20) + b"x" * 20 for _ in range(12))
        bodies = [frame(fake if k % 3 == 0 and n > 1 else bytes(rng.randrange(256) for _ in range(rng.choice((0, 5, 90, 700))))) for k in range(40)]
        data = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, 1) + b"".join(map(record, bodies))
        if n == 3:
            data = data[:-5]
        if n == 4:
            data = data[: len(data) // 2] + struct.pack(order + "4I", 1, 2, 1 << 30, 1 << 30) + data[len(data) // 2 :]
        rows.append((f"c{n}", data))
    files = spark.createDataFrame([*rows, ("short", rows[0][1][:30]), ("none", b"")], "capture_id string, content binary")
    order = ["capture_id", "number", "problem"]
    whole = [tuple(r) for r in C.parse_packets(files, 1 << 20).orderBy(*order).collect()]
    for part in (64, 300, 5000):
        assert [tuple(r) for r in C.parse_packets(files, part).orderBy(*order).collect()] == whole
    starts = C.part_starts(C.container_parts(files.where("capture_id IN ('c2', 'c0')"), 300), 300)
    assert starts.count() > 30
