"""Capture files: discovery, format sniffing, identity and packets.

Reading a container is the one place that needs bytes in Python: record headers
chain by length. A large classic container is cut into parts by Spark, which are
spread over tasks: every part finds its first record by resynchronising (a chain
of plausible headers), the parts of a file are then checked against one another
(a part must begin where the one before ends), and where a guess was wrong the
headers of that file alone are walked in order, one run of parts at a time. So the
split never changes the packets. Small parts travel in runs of neighbours, and a
container of one run is cut, checked and read in the task that has it. Containers of
one part, and block containers, whose later blocks depend on earlier ones, are walked whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.functions import fixed_values as V
from postern.functions import ids, labels
from postern.functions.columns import case_map, epoch_to_timestamp
from postern.operators.folds import batch_of, column_values, fold_groups
from postern.session import python_partitions

PACKET_DDL = (
    "capture_id string, number bigint, ts double, src_ip string, dst_ip string, src_port int, dst_port int, tcp_flags int, "
    "tcp_seq bigint, tcp_ack bigint, captured_len int, original_len int, payload binary, link_type int, problem string"
)
ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
PACKET_SCHEMA = pa.schema([(name, ARROW[kind]) for name, kind in (column.split() for column in PACKET_DDL.split(", "))])
BATCH = 20_000


def capture_format(content: str | Column) -> Column:
    """Container format by magic bytes; the file name is never trusted."""
    head = F.lower(F.hex(F.substring(F.col(content) if isinstance(content, str) else content, 1, 4)))
    return case_map(head, V.CAPTURE_MAGICS)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Capture files below ``path``: known containers only, with identity. Larger files are never read."""
    return identify(_files(spark, path).where(F.col("length") <= V.MAX_CAPTURE_BYTES).select("path", "content"))


def rejected_captures(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes and reason of the files that ``read_captures`` leaves out."""
    files = _files(spark, path)
    large = files.where(F.col("length") > V.MAX_CAPTURE_BYTES).select("path", F.col("length").alias("size_bytes"), F.lit("too_large").alias("reason"))
    known = files.where(F.col("length") <= V.MAX_CAPTURE_BYTES)
    unknown = known.where(capture_format("content").isNull()).select("path", F.col("length").alias("size_bytes"), F.lit("unknown_format").alias("reason"))
    return large.unionByName(unknown)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def identify(files: DataFrame) -> DataFrame:
    sha = F.sha2("content", 256)
    return files.select(
        ids.capture_id(sha).alias("capture_id"), "path", capture_format("content").alias("format"),
        F.length("content").cast("bigint").alias("size_bytes"), sha.alias("sha256"), "content",
    ).where(F.col("format").isNotNull() & (F.col("size_bytes") <= V.MAX_CAPTURE_BYTES))


def _records(head: bytes, data: bytes, at: int, limit: int) -> Iterator[tuple]:
    """Records of a classic container that begin in ``data`` from ``at`` on and before ``limit``."""
    order = _byte_order(head)
    unit = 1e9 if head[:4].hex() in ("4d3cb2a1", "a1b23c4d") else 1e6
    link = struct.unpack_from(order + "I", head, 20)[0]
    while at < limit and at + 16 <= len(data):
        seconds, fraction, size, _ = struct.unpack_from(order + "4I", data, at)
        if size > V.MAX_PACKET_BYTES:
            yield link, None, "implausible packet length"
            return
        frame = data[at + 16 : at + 16 + size]
        at += 16 + size
        yield (link, seconds + fraction / unit, frame) if len(frame) == size else (link, None, "truncated packet record")


def _frames(data: bytes) -> Iterator[tuple]:
    """(link type, timestamp, frame) or (link type, None, problem) for every record of a container."""
    magic = data[:4].hex()
    if V.CAPTURE_MAGICS.get(magic) == "pcap" and len(data) >= 24:
        yield from _records(data, data, HEADER, len(data))
    elif magic == "0a0d0d0a" and len(data) >= 28:
        order = {"4d3c2b1a": "<", "1a2b3c4d": ">"}.get(data[8:12].hex())
        if order is None:
            yield 0, None, "unknown byte order"
            return
        links: list[int] = []
        at = 0
        while at + 8 <= len(data):
            kind, size = struct.unpack_from(order + "2I", data, at)
            if size < 12 or at + size > len(data):
                yield 0, None, "corrupt pcapng block length"
                return
            body = data[at + 8 : at + size - 4]
            at += size
            if kind == 1 and len(body) >= 8:
                links.append(struct.unpack_from(order + "H", body)[0])
            elif kind == 6 and len(body) >= 20:
                interface, high, low, length, _ = struct.unpack_from(order + "5I", body)
                frame = body[20 : 20 + length]
                if len(frame) < length:
                    yield 0, None, "truncated packet block"
                elif interface >= len(links):
                    yield 0, ((high << 32) | low) / 1e6, None
                else:
                    yield links[interface], ((high << 32) | low) / 1e6, frame
            elif kind != 0x0A0D0D0A:
                yield 0, None, "unsupported pcapng block type"
    else:
        yield 0, None, "unreadable container"


@lru_cache(maxsize=1 << 16)
def dotted(address: bytes) -> str:
    return ".".join(map(str, address))


def _tcp(link: int, frame: bytes):
    """TCP fields of an Ethernet or raw-IP frame, or the reason it is skipped."""
    if link == 1:
        if len(frame) < 14:
            return "truncated ethernet frame"
        kind = frame[12:14]
        if kind != b"\x08\x00":
            return "vlan-tagged frame" if kind == b"\x81\x00" else "non-ipv4 ethernet frame"
        frame = frame[14:]
    elif link != 101:
        return "unknown interface link type"
    if len(frame) < 20:
        return "truncated ipv4 header"
    if frame[0] >> 4 != 4:
        return "non-ipv4 packet"
    head = (frame[0] & 15) * 4
    if head < 20 or len(frame) < head:
        return "truncated ipv4 header"
    total, fragment = struct.unpack_from(">H2xH", frame, 2)
    if fragment & 0x1FFF:
        return "ip fragment"
    if fragment & 0x2000:
        return "fragmented ip datagram"
    if frame[9] != 6:
        return "non-tcp packet"
    segment = frame[head:]
    offset = (segment[12] >> 4) * 4 if len(segment) >= 20 else 0
    if offset < 20 or len(segment) < offset:
        return "truncated tcp header"
    source, target, seq, ack = struct.unpack_from(">2H2I", segment)
    size = max(0, total - head - offset)
    payload = segment[offset : offset + size]
    return dotted(frame[12:16]), dotted(frame[16:20]), source, target, segment[13], seq, ack, len(payload), size, payload


def _packet_rows(capture: str, frames: Iterator[tuple], number: int = 0) -> Iterator[tuple]:
    for link, ts, frame in frames:
        problem = frame if ts is None else None
        parsed = None
        if ts is not None:
            number += 1
            parsed = "unknown interface link type" if frame is None else _tcp(link, frame)
            problem = parsed if isinstance(parsed, str) else None
        fields = parsed if isinstance(parsed, tuple) else (None,) * 10
        yield capture, number, ts, *fields, link, problem


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, BATCH)):
        yield batch_of(part, PACKET_SCHEMA)


PART_BYTES = 8 << 20
OVERLAP = V.MAX_PACKET_BYTES + 16  # a record that begins in a part may end so far behind it
CHAIN = 8  # plausible headers in a row that make a guess
HEADER = 24
STARTS = "capture_id string, part int, start bigint, first_number bigint"


def parse_packets(captures: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """All records of all captures; skipped ones carry the reason in ``problem``."""
    files = captures.select("capture_id", "content")
    split = (capture_format("content") == "pcap") & (F.length("content") > part_bytes + HEADER)
    several = F.length("content") > _run_parts(part_bytes) * part_bytes + HEADER
    size = F.lit(part_bytes).alias("size")
    parts = F.when(split, F.lit(part_bytes)).alias("size")  # none: the container is walked whole
    in_place = files.where(~F.coalesce(split & several, F.lit(False))).select("capture_id", "content", parts).mapInArrow(_parse_in_place, PACKET_DDL)
    runs = container_parts(files.where(split & several), part_bytes)
    begun = part_starts(runs, part_bytes).where("start IS NOT NULL").withColumn("run", F.floor(F.col("part") / _run_parts(part_bytes)).cast("int"))
    starts = begun.groupBy("capture_id", "run").agg(F.collect_list(F.struct("part", "start", "first_number")).alias("starts"))
    placed = runs.join(starts, ["capture_id", "run"]).select("capture_id", "head", "base", "content", "starts", size)
    return in_place.unionByName(placed.mapInArrow(_parse_run, PACKET_DDL))


def _run_parts(part_bytes: int) -> int:
    """How many parts lie in a run: parts of the usual size one, smaller ones as many as make up that size."""
    return max(1, PART_BYTES // part_bytes)


def container_parts(files: DataFrame, part_bytes: int) -> DataFrame:
    """Runs of neighbouring parts of classic containers, with the bytes a record may reach beyond them; one shuffle spreads them.

    Only a run carries bytes beyond its end, its parts are read in place, so small parts do not multiply the bytes.
    """
    size, run_bytes = F.length("content") - HEADER, _run_parts(part_bytes) * part_bytes
    cut = files.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / run_bytes).cast("int"))))
    base = F.lit(HEADER) + F.col("run").cast("bigint") * run_bytes
    runs = cut.select(
        "capture_id", "run", F.substring("content", 1, HEADER).alias("head"), base.alias("base"), F.substring(F.col("content"), (base + 1).cast("int"), F.lit(run_bytes + OVERLAP)).alias("content")
    )
    return runs.repartition(python_partitions(files.sparkSession), "capture_id", "run")


def part_starts(runs: DataFrame, part_bytes: int) -> DataFrame:
    """(capture_id, part, start, first_number) of every part in which a record begins; exact, however the guesses fall."""
    sized = runs.select("capture_id", "run", "head", "base", "content", F.lit(part_bytes).cast("bigint").alias("size"))
    guesses = sized.mapInPandas(_guess, "capture_id string, part int, start bigint, stop bigint, records bigint")
    checked = fold_groups(guesses.withColumn("size", F.lit(part_bytes).cast("bigint")), ["capture_id"], ["part"], _checked, STARTS)
    wrong = checked.where("part < 0").select("capture_id")
    repaired = fold_groups(sized.join(wrong, "capture_id", "left_semi"), ["capture_id"], ["run"], _walked, STARTS)
    return checked.join(wrong, "capture_id", "left_anti").unionByName(repaired)


def _parts(run: int, length: int, size: int) -> Iterator[tuple[int, int]]:
    """(number, where it begins in the run) of the parts of a run with ``length`` bytes, those beyond its end left out."""
    each = _run_parts(size)
    return ((run * each + k, k * size) for k in range(min(each, -(-length // size))))


def _byte_order(head: bytes) -> str:
    return ">" if head[:2] == b"\xa1\xb2" else "<"


def _hop(data: bytes, at: int, limit: int, order: str) -> tuple[int | None, int]:
    """Walks record headers from ``at``: (where the first record at or behind ``limit`` begins, complete records passed). None: the container ends or breaks off here."""
    records = 0
    while at < limit:
        if at + 16 > len(data):
            return None, records
        size = struct.unpack_from(order + "I", data, at + 8)[0]
        if size > V.MAX_PACKET_BYTES or at + 16 + size > len(data):
            return None, records
        at += 16 + size
        records += 1
    return at, records


def _plausible(data: bytes, order: str, unit: int) -> np.ndarray:
    """Positions whose bytes could be a record header."""
    n = len(data) - 15
    if n <= 0:
        return np.zeros(0, np.int64)
    word = lambda shift: np.ndarray((n,), dtype=order + "u4", buffer=data, offset=shift, strides=(1,))
    return np.flatnonzero((word(4) < unit) & (word(8) <= V.MAX_PACKET_BYTES) & (word(12) >= word(8)) & (word(12) <= V.MAX_PACKET_BYTES))


def _guesses(run: int, base: int, head: bytes, data: bytes, size: int) -> Iterator[tuple]:
    """(part, start, stop, records): where the first record of each part of a run begins, as far as the part itself can tell; -1 as ``stop``: nothing follows."""
    order = _byte_order(head)
    good = np.zeros(len(data) + 1, dtype=bool)
    places = _plausible(data, order, 1_000_000_000)
    good[places] = True
    for part, first in _parts(run, len(data), size):
        end = min(first + size + OVERLAP, len(data))
        start = None
        for at in [0] if part == 0 else places[slice(*np.searchsorted(places, [first, min(first + size, end - 15)]))].tolist():
            here, steps = at, 0
            while part and steps < CHAIN and here + 16 <= end and good[here]:
                here, steps = here + 16 + struct.unpack_from(order + "I", data, here + 8)[0], steps + 1
            if part == 0 or steps == CHAIN or (steps and here >= end - 16):
                start = at
                break
        stop, records = (None, 0) if start is None else _hop(data, start, min(first + size, end), order)
        ended = start is not None and stop is None
        yield part, None if start is None else base + start, -1 if ended else None if stop is None else base + stop, records


def _guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(row.capture_id, *guess) for row in batch.itertuples() for guess in _guesses(row.run, row.base, row.head, bytes(row.content), row.size)]
        yield pd.DataFrame(rows, columns=["capture_id", "part", "start", "stop", "records"]).astype({"start": "Int64", "stop": "Int64"})


def _checked(rows: Iterator[dict]) -> Iterator[tuple]:
    """Starts of a file's parts where every part begins at the end of the one before; else one row with part -1."""
    expected, number, out = HEADER, 0, []
    for row in rows:
        end = HEADER + (row["part"] + 1) * row["size"]
        if expected < 0 or expected >= end:  # the container broke off before, or a long record covers the part
            continue
        if row["start"] != expected:
            yield -1, None, None
            return
        out.append((row["part"], expected, number))
        expected, number = row["stop"], number + row["records"]
    yield from out


def _walked(rows: Iterator[dict]) -> Iterator[tuple]:
    """The same by walking the headers in order; one run is held at a time."""
    expected, number = HEADER, 0
    for row in rows:
        data, base, size = row["content"], row["base"], row["size"]
        for part, first in _parts(row["run"], len(data), size):
            if expected is None:
                return
            if expected >= base + first + size:
                continue
            yield part, expected, number
            stop, records = _hop(data, expected - base, min(first + size, len(data)), _byte_order(row["head"]))
            expected, number = None if stop is None else base + stop, number + records


def _run_rows(capture: str, head: bytes, base: int, data: bytes, starts: list[dict], size: int) -> Iterator[tuple]:
    for begun in starts:
        limit = HEADER + (begun["part"] + 1) * size - base
        yield from _packet_rows(capture, _records(head, data, begun["start"] - base, min(limit, len(data))), begun["first_number"])


def _parse_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batched(packet for batch in batches for row in zip(*map(column_values, batch.columns)) for packet in _run_rows(*row))


def _container_rows(capture: str, content: bytes, size: int | None) -> Iterator[tuple]:
    """Packets of a container of one run: its parts are guessed, checked and read where it lies; without a size of parts it is walked whole."""
    if size is None:
        yield from _packet_rows(capture, _frames(content))
        return
    run = {"run": 0, "base": HEADER, "head": content[:HEADER], "content": content[HEADER:], "size": size}
    guesses = _guesses(0, HEADER, run["head"], run["content"], size)
    starts = list(_checked({"part": part, "start": start, "stop": stop, "records": records, "size": size} for part, start, stop, records in guesses))
    if starts and starts[0][0] < 0:
        starts = _walked(iter([run]))
    yield from _run_rows(capture, run["head"], HEADER, run["content"], [dict(zip(("part", "start", "first_number"), start)) for start in starts], size)


def _parse_in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batched(packet for batch in batches for capture, content, size in zip(*map(column_values, batch.columns)) for packet in _container_rows(capture, bytes(content), size))


def tcp_packets(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("problem").isNull()).drop("problem")


def skip_coverage(parsed: DataFrame) -> DataFrame:
    counted = parsed.where(F.col("problem").isNotNull()).groupBy("capture_id", "problem").agg(F.count("*").alias("n"))
    text = F.format_string("%d packet(s) skipped: %s", "n", "problem")
    return counted.select("capture_id", F.col("problem").alias("reason"), "n", text.alias("text"))


def packet_metadata(packets: DataFrame) -> DataFrame:
    """Count, first and last time, duration and link type per capture."""
    return packets.groupBy("capture_id").agg(
        F.count("*").alias("packet_count"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.min_by("link_type", "number").alias("link"),
    ).select(
        "capture_id", "packet_count", epoch_to_timestamp("first").alias("capture_started_at"), epoch_to_timestamp("last").alias("capture_ended_at"),
        F.greatest(F.lit(0.0), F.col("last") - F.col("first")).alias("duration_seconds"), labels.link_type_name("link").alias("link_type"),
    )
