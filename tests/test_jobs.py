"""Streaming jobs: one file a trigger, restarts, late rows, against brute force."""

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from postern.streaming import jobs as J

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "user string, severity string, ts timestamp"
FILES = 6


def rows_of(seed):
    rng = random.Random(seed)
    at = sorted(rng.randrange(40 * 3600) for _ in range(400))
    return [(f"u{rng.randrange(4)}", rng.choice(("high", "low")), T0 + dt.timedelta(seconds=s)) for s in at]


def put(rows, folder, number):
    """One file of a stream, ordered by its time of change."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/part-{number}.parquet"
    user, severity, ts = zip(*rows, strict=True)
    pq.write_table(pa.table({"user": user, "severity": severity, "ts": pa.array(ts, pa.timestamp("us", "UTC"))}), path)
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def parts(rows):
    return [rows[n * len(rows) // FILES : (n + 1) * len(rows) // FILES] for n in range(FILES)]


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def sessions(rows, gap=dt.timedelta(minutes=30)):
    out = []
    for user in {r[0] for r in rows}:
        run = []
        for at in sorted(r[2] for r in rows if r[0] == user):
            if run and at - run[-1] > gap:
                out.append((user, run[0], run[-1] + gap, len(run)))
                run = []
            run.append(at)
        out.append((user, run[0], run[-1] + gap, len(run)))
    return sorted(out)


def hours(rows):
    out = {}
    for _, severity, at in rows:
        key = (at.replace(minute=0, second=0), severity)
        out[key] = out.get(key, 0) + 1
    return sorted((*k, n) for k, n in out.items())


def plain(df, *columns):
    texts = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t == "timestamp" else F.col(c) for c, t in df.select(*columns).dtypes]
    return sorted(tuple(r) for r in df.select(*texts).collect())


def shown(rows):
    return sorted(tuple(f"{v:%Y-%m-%d %H:%M:%S}" if isinstance(v, dt.datetime) else v for v in r) for r in rows)


JOBS = {
    "flows": (lambda s: J.stream_flow_sessions(s, "user"), ("user", "started_at", "closed_at", "packets"), sessions),
    "counts": (lambda s: J.stream_finding_counts(s, ts="ts"), ("window_start", "severity", "findings"), hours),
}


@pytest.mark.parametrize("name", JOBS)
def test_one_file_a_trigger_and_a_restart_give_all_windows(spark, tmp_path, name):
    job, columns, expected = JOBS[name]
    rows = rows_of(11)
    for number, part in enumerate(parts(rows)):
        put(part, f"{tmp_path}/whole", number)
    whole = J.run_closable(source(spark, f"{tmp_path}/whole"), job, "ts", name, f"{tmp_path}/q1")
    assert plain(whole, *columns) == shown(expected(rows))
    # stopped after half of the files, started again with the folder of the query
    for number, part in enumerate(parts(rows)[:3]):
        put(part, f"{tmp_path}/half", number)
    early = plain(J.run_closable(source(spark, f"{tmp_path}/half"), job, "ts", name, f"{tmp_path}/q2", close=False), *columns)
    assert set(early) < set(shown(expected(rows)))
    for number, part in enumerate(parts(rows)[3:], 3):
        put(part, f"{tmp_path}/half", number)
    rest = J.run_closable(source(spark, f"{tmp_path}/half"), job, "ts", name, f"{tmp_path}/q2")
    assert plain(rest, *columns) == shown(expected(rows))


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    job, columns, expected = JOBS["counts"]
    rows = rows_of(12)
    for number, part in enumerate(parts(rows)):
        put(part, f"{tmp_path}/in", number)
    put([("u0", "high", T0)], f"{tmp_path}/in", FILES)
    out = J.run_closable(source(spark, f"{tmp_path}/in"), job, "ts", "late", f"{tmp_path}/q")
    assert plain(out, *columns) == shown(expected(rows))
