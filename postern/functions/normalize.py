"""Evidence value normalisers: the canonical value, or NULL when unusable."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postern.functions.columns import col
from postern.functions.fixed_values import SENSITIVE_COMMANDS, SENSITIVE_KEYS

CONTROL_CHARS = r"[\x00-\x1f\x7f]"
IPV4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"


def _clean(value: Column, limit: int) -> Column:
    """Keep a non-empty text of bounded length without control characters."""
    return F.when((F.length(value) > 0) & (F.length(value) <= limit) & ~value.rlike(CONTROL_CHARS), value)


def _strip(value: str | Column) -> Column:
    return F.regexp_replace(col(value), r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalize_ipv4(value: str | Column) -> Column:
    text = _strip(value)
    return F.when((F.length(text) <= 64) & text.rlike(IPV4), text)


@F.pandas_udf(StringType())
def _canonical_ip(values: pd.Series) -> pd.Series:
    def one(text):
        try:
            return ipaddress.ip_address(text).compressed.lower()
        except ValueError:
            return None

    return values.map(one, na_action="ignore")


def normalize_ip(value: str | Column) -> Column:
    """IPv4 stays in the JVM; the Arrow UDF is only evaluated when text holds a colon."""
    text = _strip(value)
    v6 = F.when((F.length(text) <= 64) & text.contains(":") & ~text.rlike(CONTROL_CHARS), text)
    return F.coalesce(normalize_ipv4(value), _canonical_ip(v6))


def stored_ip(value: str | Column) -> Column:
    """An address of a session row. Sessions store canonical addresses, so IPv6 needs no re-parsing here."""
    text = _strip(value)
    v6 = F.when((F.length(text) <= 64) & text.contains(":") & text.rlike("^[0-9a-fA-F:.]+$"), F.lower(text))
    return F.coalesce(normalize_ipv4(value), v6)


def normalize_hostname(value: str | Column) -> Column:
    text = F.lower(_strip(value))
    usable = F.when(~text.rlike(r"\s"), _clean(text, 253))
    return F.nullif(F.regexp_replace(usable, r"\.$", ""), F.lit(""))


def normalize_port(value: str | Column) -> Column:
    v = col(value)
    return F.when((v >= 0) & (v <= 65535), v)


def normalize_protocol(value: str | Column) -> Column:
    text = F.lower(_strip(value))
    return F.when(text.isin("smtp", "imap", "pop3"), text)


def _collapsed(value: str | Column) -> Column:
    return F.lower(F.regexp_replace(_strip(value), r"\s+", " "))


def normalize_token(value: str | Column) -> Column:
    return _clean(_collapsed(value), 128)


def normalize_subject(value: str | Column) -> Column:
    return _clean(_collapsed(value), 512)


def normalize_fingerprint(value: str | Column) -> Column:
    text = F.translate(F.lower(_strip(value)), ": ", "")
    return F.when((F.length(text) <= 128) & text.rlike("^[0-9a-f]+$"), text)


def normalize_evidence_key(value: str | Column) -> Column:
    return _clean(col(value), 512)


def safe_value(value: str | Column, limit: int = 512) -> Column:
    return F.left(F.regexp_replace(col(value), CONTROL_CHARS, ""), F.lit(limit))


def command_word(line: str | Column) -> Column:
    return F.upper(F.split(_strip(line), r"\s+", 2)[0])


def command_arguments(line: str | Column) -> Column:
    return F.coalesce(_strip(F.get(F.split(_strip(line), r"\s+", 2), F.lit(1))), F.lit(""))


def redact_arguments(command: str | Column, arguments: str | Column) -> Column:
    return F.when(col(command).isin(*SENSITIVE_COMMANDS), F.lit("redacted")).otherwise(safe_value(arguments))


def redact_line(line: str | Column) -> Column:
    word, arguments = command_word(line), command_arguments(line)
    secret = word.isin(*SENSITIVE_COMMANDS) & (arguments != "")
    return F.when(secret, F.concat(word, F.lit(" redacted"))).otherwise(safe_value(line))


def strip_sensitive_keys(entries: str | Column) -> Column:
    return F.map_filter(col(entries), lambda k, _: ~F.lower(k).isin(*SENSITIVE_KEYS))
