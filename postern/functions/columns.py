"""Small Column builders shared by the operators.

Everything here is a composition of built-in Spark functions, so it stays
inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_text(ts: str | Column) -> Column:
    """UTC ISO-8601 text of a timestamp; microseconds only when present."""
    t = col(ts)
    micros = F.unix_micros(t)
    whole = F.date_format(t, ISO_PATTERN)
    fraction = F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0")
    return F.when(F.pmod(micros, F.lit(1_000_000)) == 0, F.concat(whole, F.lit("+00:00"))).otherwise(
        F.concat(whole, F.lit("."), fraction, F.lit("+00:00"))
    )


def epoch_to_timestamp(seconds: str | Column) -> Column:
    """Epoch seconds (DOUBLE) to a microsecond timestamp."""
    return F.timestamp_micros(F.bround(col(seconds) * 1_000_000).cast("bigint"))


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (F.unix_micros(col(end)) - F.unix_micros(col(start))) / 1_000_000


def session_duration(start: str | Column, end: str | Column) -> Column:
    return F.greatest(F.lit(0.0), seconds_between(start, end))


def validity_days(start: str | Column, not_after: str | Column) -> Column:
    return seconds_between(start, not_after) / 86400


def sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def case_map(key: Column, mapping: Mapping, default=None) -> Column:
    """Constant lookup: one folded map literal, whatever its number of entries."""
    entries = ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in mapping.items())
    found = F.try_element_at(F.expr(f"map({entries})"), key)
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def threshold_label(score: Column, bands: Sequence[tuple], lowest: str) -> Column:
    """Label of the first band whose floor the score reaches."""
    out = None
    for floor, label in bands:
        out = F.when(score >= floor, label) if out is None else out.when(score >= floor, label)
    return out.otherwise(F.when(score.isNotNull(), F.lit(lowest)))


def half_even(numerator: Column, denominator: Column | int) -> Column:
    """numerator / denominator rounded half-to-even, in BIGINT arithmetic (both >= 0)."""
    n = numerator.cast("bigint")
    d = (denominator if isinstance(denominator, Column) else F.lit(denominator)).cast("bigint")
    q = F.call_function("div", n, d)
    r2 = (n % d) * 2
    return q + F.when((r2 > d) | ((r2 == d) & (q % 2 == 1)), F.lit(1)).otherwise(F.lit(0))


def cents_text(cents: Column) -> Column:
    """A hundredth count as the shortest decimal text (1250 -> 12.5, 300 -> 3)."""
    whole = F.call_function("div", cents, F.lit(100)).cast("string")
    rest = (cents % 100).cast("int")
    return (
        F.when(rest == 0, whole)
        .when(rest % 10 == 0, F.concat(whole, F.lit("."), F.call_function("div", rest, F.lit(10)).cast("string")))
        .otherwise(F.concat(whole, F.lit("."), F.lpad(rest.cast("string"), 2, "0")))
    )


def short_sha(value: Column, length: int) -> Column:
    return F.substring(F.sha2(value, 256), 1, length)


def prefixed_sha(prefix: str, value: Column, length: int) -> Column:
    return F.concat(F.lit(prefix), short_sha(value, length))


def joined(*parts: str | Column) -> Column:
    """Parts joined by '|', NULL counting as the empty text."""
    return F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])


def literal_table(spark: SparkSession, rows: Sequence[Sequence], columns: Sequence[str]) -> DataFrame:
    """A small constant relation the optimizer can size, fold and broadcast."""
    values = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


_MEMO: dict = {}


def memo(key, build):
    """Reuse an expression tree between calls of one JVM (building them costs gateway round trips)."""
    from pyspark import SparkContext

    full = (id(SparkContext._gateway), key)
    if full not in _MEMO:
        _MEMO[full] = build()
    return _MEMO[full]
