"""One text that stands for all items of a group, from a tree over hash prefixes.

An item's place is the MD5 of its text. A group of n items has the smallest
depth d with n <= leaf * 256 ** d, and its leaves hold the items whose places
share the first 2 * d hex digits. A leaf's text is its sorted items, joined; an
inner node's text is the SHA-256 of its children's texts in the order of their
prefixes, joined; the root's text is the result. A group that fits one leaf has
only a root, so its text is the plain joined list. Places spread evenly: a leaf
holds about ``leaf`` items at most and an inner node 256 children, at any size.

Items are distinct in their group. A group needs at least one item to have a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_OUT, DIGITS, MAX_DEPTH = 256, 2, 4


def tree_text(items: DataFrame, keys: list[str], leaf: int, separator: str = "|") -> DataFrame:
    """``keys`` and ``text`` of every group; ``items`` has the keys, ``item`` (text) and ``n`` (the group's items, alike in all its rows)."""
    depth = sum((F.when(F.col("n") > leaf * FAN_OUT**k, 1).otherwise(0) for k in range(MAX_DEPTH)), F.lit(0))
    placed = items.select(*keys, "item", depth.alias("depth")).withColumn("prefix", F.left(F.md5("item"), F.lit(DIGITS) * F.col("depth")))
    nodes = placed.groupBy(*keys, "depth", "prefix").agg(F.array_join(F.array_sort(F.collect_list("item")), separator).alias("text"))
    nodes = nodes.repartition(*keys)  # leaf texts only; the levels above need no further exchange
    for level in range(MAX_DEPTH, 0, -1):
        child = F.struct("prefix", F.when(F.col("depth") >= level, F.sha2("text", 256)).otherwise(F.col("text")).alias("text"))
        parent = F.left("prefix", F.lit(DIGITS * (level - 1)))  # shallower groups keep their node
        nodes = nodes.select(*keys, "depth", parent.alias("prefix"), child.alias("child")).groupBy(*keys, "depth", "prefix").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list("child")), lambda c: c["text"]), separator).alias("text")
        )
    return nodes.select(*keys, "text")
