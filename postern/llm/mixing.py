"""Operator 4 [native]: sources interleaved to target weights by Pfair scheduling.

Every source is cut into blocks of ``block`` documents. Shares are whole numbers
a_s with sum A, so the schedule repeats every A slots; block j (from 0) of source
s is released at slot floor(j * A / a_s) and due before slot ceil((j + 1) * A / a_s).
In each slot the released block with the earliest deadline is taken (ties to the
smaller source name); with the shares filling every slot this meets all
deadlines, so up to any slot a source is less than one block away from its share.
The frame of A slots follows from the shares alone and is one fold over a
sequence. A document's slot and its position are then arithmetic on its number
in its source: nothing is sorted globally, and no source is ever in one group.

All rows are kept. Where a source has no more blocks its slots stay empty and the
others follow closer, in the same proportions.

Defined cases: a null source is the source named by the empty text; a null doc_id
comes as the empty text in the order of its source; rows that repeat a doc_id
follow one another in no stated order; weights null, zero, negative or not
finite, or missing for a source, count as the least share of one slot in a frame;
columns of the table with the name of a result column are replaced by it; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.llm.common import written

RESOLUTION, BLOCK = 1024, 8
RESULT = ("block_no", "slot", "release", "deadline", "position")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``mix_source``, and ``mix_number``: the place (from 0) in the source by the digest of doc_id, counted by digest prefix plus a carry."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = docs.select(*carried, F.coalesce("source", F.lit("")).alias("mix_source"), digest.alias("mix_digest"))
    keyed = keyed.withColumn("mix_slice", F.substring("mix_digest", 1, 3))
    order = W.partitionBy("mix_source", "mix_slice").orderBy("mix_digest")
    sizes = keyed.groupBy("mix_source", "mix_slice").agg(F.count("*").alias("mix_n"))
    carry = sizes.select("mix_source", "mix_slice", (F.sum("mix_n").over(W.partitionBy("mix_source").orderBy("mix_slice")) - F.col("mix_n")).alias("mix_carry"))
    return keyed.withColumn("mix_row", F.row_number().over(order)).join(carry, ["mix_source", "mix_slice"]).withColumn(
        "mix_number", F.col("mix_carry") + F.col("mix_row") - 1
    )


def shares(docs: DataFrame, weights: DataFrame | None = None, resolution: int = RESOLUTION) -> DataFrame:
    """(source, n, a): documents and slots in a frame. Without weights a source counts by the square root of its documents."""
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        sized = sizes.withColumn("w", F.floor(F.sqrt("n")).cast("double"))
    else:
        given = weights.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.max("weight").cast("double").alias("w"))
        sized = sizes.join(given, "source", "left").withColumn("w", F.when((F.col("w") > 0) & (F.col("w") < float("inf")), F.col("w")).otherwise(0.0))
    total = F.sum("w").over(W.partitionBy(F.lit(0)))  # one row for each source
    part = F.when(total > 0, F.floor(F.lit(resolution) * F.col("w") / total)).otherwise(0)
    return sized.select("source", "n", F.greatest(F.lit(1), part).cast("bigint").alias("a"))


def frame(share: DataFrame) -> DataFrame:
    """One row for each slot of a frame: source, turn (which of its blocks), slot, and what the fold had given before it.

    ``sizes`` and ``given`` are arrays over the sources in the order of their names.
    """
    listed = share.agg(F.array_sort(F.collect_list(F.struct("source", "n", "a"))).alias("s")).select(
        "s", F.aggregate("s", F.lit(0).cast("bigint"), lambda x, y: x + y["a"]).alias("length")
    ).where("length > 0")
    a = lambda k: F.element_at("s", (k + 1).cast("int"))["a"]

    def choose(given: Column, slot: Column) -> Column:
        open_ = F.filter(
            F.transform(given, lambda n, k: F.struct(
                F.floor((n * F.col("length") + F.col("length") + a(k) - 1) / a(k)).alias("deadline"), k.alias("k"), F.floor(n * F.col("length") / a(k)).alias("release")
            )),
            lambda c: c["release"] <= slot,
        )
        return F.array_min(open_)["k"]

    def step(state: Column, slot: Column) -> Column:
        take = lambda k: F.struct(
            F.transform(state["given"], lambda n, i: n + F.when(i == k, 1).otherwise(0)).alias("given"),
            F.array_append(state["slots"], F.struct(k.alias("k"), state["given"].alias("given"))).alias("slots"),
        )
        return F.transform(F.array(choose(state["given"], slot)), take)[0]  # the choice is made once

    start = F.struct(
        F.transform("s", lambda _: F.lit(0).cast("bigint")).alias("given"), F.array().cast("array<struct<k:int,given:array<bigint>>>").alias("slots")
    )
    folded = listed.select("s", "length", F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1), start, step, lambda x: x["slots"]).alias("slots"))
    return folded.select("s", "length", F.posexplode("slots").alias("slot", "x")).select(
        F.element_at("s", F.col("x.k") + 1)["source"].alias("f_source"), F.element_at("x.given", F.col("x.k") + 1).alias("turn"), F.col("slot").cast("bigint").alias("f_slot"),
        F.element_at("s", F.col("x.k") + 1)["a"].alias("share"), "length", F.transform("s", lambda v: v["n"]).alias("sizes"), F.transform("s", lambda v: v["a"]).alias("all_shares"), F.col("x.given").alias("given"),
    )


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, resolution: int = RESOLUTION) -> DataFrame:
    """The rows of ``docs`` with block_no, slot, release, deadline (in slots) and position (from 0, without gaps)."""
    carried = [c for c in docs.columns if c.lower() not in RESULT]
    rows = numbered(docs.select(F.struct(*map(quoted, carried)).alias("mix_document"), "doc_id", "source"), ["mix_document"])
    # as many rows as a frame has slots: at most ``resolution`` and one for each source
    turns = written(frame(shares(docs, weights, resolution)), "frame")
    slots = F.broadcast(turns.withColumnRenamed("f_source", "mix_source"))
    share = slots.where("turn = 0").select("mix_source", F.col("share").alias("mix_share"))
    block_no = F.floor(F.col("mix_number") / block)
    placed = (
        rows.withColumn("mix_block", block_no).join(F.broadcast(share), "mix_source").withColumn("turn", F.col("mix_block") % F.col("mix_share")).join(slots, ["mix_source", "turn"])
        .withColumn("mix_frame", F.floor(F.col("mix_block") / F.col("mix_share")))
    )
    per_source = F.zip_with(
        F.zip_with("all_shares", "given", lambda a, g: (F.col("mix_frame") * a + g) * block), "sizes", lambda before, n: F.least(before, n)
    )
    return placed.select(
        *[F.col("mix_document").getField(c).alias(c) for c in carried], F.col("mix_block").alias("block_no"), (F.col("mix_frame") * F.col("length") + F.col("f_slot")).alias("slot"),
        F.floor(F.col("mix_block") * F.col("length") / F.col("mix_share")).alias("release"), F.ceil((F.col("mix_block") + 1) * F.col("length") / F.col("mix_share")).alias("deadline"),
        (F.aggregate(per_source, F.lit(0).cast("bigint"), lambda x, y: x + y) + F.col("mix_number") % block).alias("position"),
    )


def mixed_documents(docs: DataFrame, partitions: int, weights: DataFrame | None = None, position: str | None = None, resolution: int = RESOLUTION) -> DataFrame:
    """All documents, range partitioned and sorted by their position in the mix, which a column named ``position`` (in place of one of the table with that name) keeps: files have no order."""
    kept = [c for c in docs.columns if c.lower() != (position or "").lower()]
    whole = docs.select(F.struct(*map(quoted, kept)).alias("document"), "doc_id", "source")
    laid = mix(whole, weights, resolution=resolution)
    return laid.repartitionByRange(partitions, "position").sortWithinPartitions("position").select("document.*", *([F.col("position").alias(position)] if position else []))


MIX_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), sizes AS (
  SELECT source, count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS w FROM keyed GROUP BY source
), share AS (
  SELECT source, n, greatest(1, CAST(floor({RESOLUTION} * w / (SELECT sum(w) FROM sizes)) AS BIGINT)) AS a, row_number() OVER (ORDER BY source) AS k FROM sizes
), total AS (
  SELECT CAST(sum(a) AS BIGINT) AS length, list(a ORDER BY k) AS shares, list(n ORDER BY k) AS counts FROM share
), fold AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS k, list_transform(shares, lambda x: CAST(0 AS BIGINT)) AS given, list_transform(shares, lambda x: CAST(0 AS BIGINT)) AS before FROM total
  UNION ALL
  SELECT slot, chosen, list_transform(given, lambda n, i: n + CASE WHEN i = chosen THEN 1 ELSE 0 END), given FROM (
    SELECT f.slot + 1 AS slot, f.given, list_sort(list_filter(
      list_transform(f.given, lambda n, i: {{'d': (n * t.length + t.length + t.shares[i] - 1) // t.shares[i], 'k': CAST(i AS BIGINT), 'r': n * t.length // t.shares[i]}}), lambda c: c.r <= f.slot + 1))[1].k AS chosen
    FROM fold f, total t WHERE f.slot + 1 < t.length)
), frame AS (
  SELECT s.source, f.slot, f.before, f.before[f.k] AS turn, s.a FROM fold f JOIN share s ON s.k = f.k WHERE f.slot >= 0
), rows AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY digest, doc_id) - 1 AS number FROM keyed
), placed AS (
  SELECT r.doc_id, r.source, r.number, r.number // {BLOCK} AS block_no, s.a FROM rows r JOIN share s ON r.source = s.source
)
SELECT p.doc_id, p.source, p.block_no, p.block_no // p.a * t.length + f.slot AS slot, p.block_no * t.length // p.a AS release,
  ((p.block_no + 1) * t.length + p.a - 1) // p.a AS deadline,
  CAST(list_sum(list_transform(t.shares, lambda a, i: least(t.counts[i], {BLOCK} * (p.block_no // p.a * a + f.before[i])))) AS BIGINT) + p.number % {BLOCK} AS position
FROM placed p JOIN frame f ON f.source = p.source AND f.turn = p.block_no % p.a, total t
"""
