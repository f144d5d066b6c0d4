"""SQL of the digest tree over hash prefixes."""

from __future__ import annotations

from postern.operators.digests import DIGITS, FAN_OUT, MAX_DEPTH


def tree_sql(items: str, keys: str, leaf: int, separator: str = "|") -> str:
    """``keys`` and ``text`` of every group of ``items`` (a relation with the keys, item and n)."""
    depth = " + ".join(f"CAST(n > {leaf * FAN_OUT**k} AS INT)" for k in range(MAX_DEPTH))
    nodes = f"""SELECT {keys}, depth, left(md5(item), {DIGITS} * depth) AS prefix, string_agg(item, '{separator}' ORDER BY item) AS text
FROM (SELECT {keys}, item, {depth} AS depth FROM {items}) GROUP BY ALL"""
    for level in range(MAX_DEPTH, 0, -1):
        nodes = f"""SELECT {keys}, depth, parent AS prefix, string_agg(text, '{separator}' ORDER BY prefix) AS text FROM (
SELECT {keys}, depth, prefix, left(prefix, {DIGITS * (level - 1)}) AS parent, CASE WHEN depth >= {level} THEN sha256(text) ELSE text END AS text FROM ({nodes})) GROUP BY {keys}, depth, parent"""
    return f"SELECT {keys}, text FROM ({nodes})"
