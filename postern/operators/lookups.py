"""Selections, lookups and reference checks over the stored tables.

Point lookups take a table of requested keys, so one job answers any number of
requests with a semi join instead of one scan per request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.functions import fixed_values as V
from postern.functions import labels
from postern.functions.columns import case_map, literal_table
from postern.operators.rules import leaf, san_covers


def requested(table: DataFrame, requests: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``table`` whose keys occur among the requests."""
    return table.join(requests.select(*keys).distinct(), list(keys), "left_semi")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One sorted page with the total before paging (a top-k, not a full sort)."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def capture_list(captures: DataFrame, analysis: DataFrame) -> DataFrame:
    return captures.join(analysis, "capture_id", "left")


def analysis_status(captures: DataFrame, analysis: DataFrame, sessions: DataFrame) -> DataFrame:
    counted = sessions.groupBy("capture_id").agg(F.count("*").alias("sessions"))
    done = F.coalesce(F.col("analysis_status"), F.lit("not_analyzed"))
    return (
        captures.select("capture_id")
        .join(analysis.select("capture_id", F.col("status").alias("analysis_status"), "warning"), "capture_id", "left")
        .join(counted, "capture_id", "left")
        .select(
            "capture_id", done.alias("status"), "warning",
            F.when(done == "completed", F.coalesce("sessions", F.lit(0))).otherwise(F.lit(0)).alias("session_count"),
        )
    )


def finding_list(
    findings: DataFrame, *, severity=None, confidence=None, category=None, protocol=None, rule=None, search=None
) -> DataFrame:
    rows = findings
    for name, value in (("severity", severity), ("confidence", confidence), ("category", category), ("protocol", protocol), ("rule_id", rule)):
        if value:
            rows = rows.where(F.col(name) == value)
    if search and search.strip():
        needle = search.strip().lower()
        rows = rows.where(
            F.lower("title").contains(needle) | F.lower("rule_id").contains(needle) | F.col("session_id").contains(needle)
        )
    return rows.withColumn("severity_position", labels.severity_position("severity"))


def anomaly_list(anomalies: DataFrame, *, band=None, protocol=None) -> DataFrame:
    shown = F.coalesce("band", "status")
    rows = anomalies
    if band:
        rows = rows.where(shown == band)
    if protocol:
        rows = rows.where(F.col("protocol") == protocol)
    position = case_map(shown, {b: i for i, b in enumerate(V.ANOMALY_BAND_ORDER)}, 99)
    return rows.withColumns({"band_position": position, "sort_score": F.coalesce("score", F.lit(-1))})


def facet_values(table: DataFrame, column: str) -> DataFrame:
    return table.where(F.coalesce(F.col(column), F.lit("")) != "").select(F.col(column).alias("value")).distinct()


def remediation_list(
    remediations: DataFrame, *, status=None, priority=None, owner=None, verification=None, rule=None, target=None,
    search=None, sort: str = "updated",
) -> tuple[DataFrame, list[Column]]:
    rows = remediations
    for name, value, fold in (
        ("status", status, str.upper), ("priority", priority, str.upper), ("verification_status", verification, str.upper),
        ("target_id", target, str),
    ):
        if value is not None:
            rows = rows.where(F.col(name) == fold(value.strip()))
    for name, value in (("owner", owner), ("rule_id", rule)):
        if value is not None:
            rows = rows.where(F.lower(F.coalesce(name, F.lit(""))) == value.strip().lower())
    if search and search.strip():
        text = F.concat_ws(" ", "title", "description", "owner", "target_id", F.coalesce("rule_id", F.lit("")))
        rows = rows.where(F.lower(text).contains(search.strip().lower()))
    order = {
        "priority": [case_map(F.col("priority"), V.PRIORITY_RANKS, 4).asc(), F.col("remediation_id")],
        "due_date": [F.col("due_at").asc_nulls_last(), F.col("remediation_id")],
        "status": [F.col("status"), F.col("remediation_id")],
        "updated": [F.coalesce("updated_at", F.lit("")).desc(), F.col("remediation_id").desc()],
    }[sort]
    return rows, order


# -- joins ---------------------------------------------------------------------


def cipher_class_dimension(spark) -> DataFrame:
    classes = {code: name for name, codes in V.CIPHER_CLASS_CODES.items() for code in codes}
    codes = sorted(V.CIPHER_SUITE_NAMES.keys() | classes.keys())
    return literal_table(spark, [(c, V.CIPHER_SUITE_NAMES.get(c), classes.get(c)) for c in codes], ["code", "name", "class"])


def with_cipher_class(sessions: DataFrame) -> DataFrame:
    """Suite name and class of the negotiated code, from a constant relation of some 50 rows."""
    dimension = F.broadcast(cipher_class_dimension(sessions.sparkSession))
    coded = sessions.where(F.col("handshake.cipher_suite_code").isNotNull()).withColumn("code", F.col("handshake.cipher_suite_code"))
    return coded.join(dimension, "code", "left").select(
        "session_id", "code", F.coalesce("name", F.format_string("0x%04X", "code")).alias("cipher_suite"),
        F.coalesce("class", F.lit("unknown")).alias("cipher_class"),
    )


def severity_weights(findings: DataFrame) -> DataFrame:
    """Weight, confidence quarters and factor of every finding, from constant relations."""
    spark = findings.sparkSession
    weights = literal_table(spark, list(V.SEVERITY_WEIGHTS.items()), ["severity", "weight"])
    quarters = literal_table(spark, list(V.CONFIDENCE_QUARTERS.items()), ["confidence", "quarters"])
    factors = literal_table(spark, list(V.FACTOR_BY_RULE.items()), ["rule_id", "factor"])
    return (
        findings.select("finding_id", "rule_id", "severity", "confidence")
        .join(F.broadcast(weights), "severity", "left").join(F.broadcast(quarters), "confidence", "left")
        .join(F.broadcast(factors), "rule_id", "left")
        .select(
            "finding_id", F.coalesce("weight", F.lit(0)).alias("weight"),
            F.coalesce("quarters", F.lit(V.DEFAULT_CONFIDENCE_QUARTERS)).alias("confidence_quarters"),
            F.coalesce("factor", F.lit("other")).alias("factor"),
        )
    )


def leaf_certificates(sessions: DataFrame, certificates: DataFrame) -> DataFrame:
    """Each session with its first certificate at position 0 from a stored certificate table."""
    first = W.partitionBy("session_id").orderBy("certificate_id")
    leaves = (
        certificates.where(F.col("position_in_chain") == 0).withColumn("n", F.row_number().over(first))
        .where(F.col("n") == 1).select("session_id", "certificate_id", "subject", "issuer")
    )
    return sessions.select("capture_id", "session_id").join(leaves, "session_id", "left")


def certificate_validity(sessions: DataFrame, certificates: DataFrame) -> DataFrame:
    """Interval join: the equi key makes the range a post-join filter."""
    s = sessions.select("session_id", "started_at")
    c = certificates.select("session_id", "certificate_id", "not_before", "not_after")
    return s.join(c, "session_id").select(
        "session_id", "certificate_id", F.col("started_at").between(F.col("not_before"), F.col("not_after")).alias("valid")
    )


def uncovered_names(sessions: DataFrame) -> DataFrame:
    """Sessions whose requested name no SAN of the leaf covers."""
    sni, sans = F.col("handshake.sni_server_name"), F.col("leaf.subject_alternative_names")
    return sessions.withColumn("leaf", leaf()).where(
        (sni != "") & (F.size(sans) > 0) & ~F.exists(sans, lambda san: san_covers(sni, san))
    ).select("session_id", sni.alias("sni"), F.array_join(sans, ", ").alias("sans"))


def related_by_host(sessions: DataFrame, limit: int = V.MAX_CONTEXT_RELATED) -> DataFrame:
    """Per session: how many other sessions share its server, and the first of them by id.

    The first ``limit + 1`` ids are cut once per host; each session drops itself
    from that head. All pairs of a host are never formed.
    """
    key = ["capture_id", "server_ip"]
    order = W.partitionBy(*key).orderBy("session_id")
    narrow = sessions.select(*key, "session_id")
    heads = (
        narrow.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit + 1)
        .groupBy(*key).agg(F.array_sort(F.collect_list("session_id")).alias("head"))
    )
    counts = narrow.groupBy(*key).agg(F.count("*").alias("members"))
    others = F.filter("head", lambda s: s != F.col("session_id"))
    return narrow.join(heads, key).join(counts, key).select(
        *key, "session_id", (F.col("members") - 1).alias("related_count"), F.slice(others, 1, limit).alias("first_related")
    )


def host_detail(sessions: DataFrame, findings: DataFrame) -> DataFrame:
    """Sessions of every host with their number of findings."""
    found = findings.groupBy("session_id").agg(F.count("*").alias("findings"))
    return sessions.select("capture_id", "server_ip", "session_id").join(found, "session_id", "left").select(
        "capture_id", labels_host("server_ip").alias("host_id"), "server_ip", "session_id", F.coalesce("findings", F.lit(0)).alias("findings")
    )


def labels_host(column: str) -> Column:
    from postern.functions.ids import host_id

    return host_id(column)


def reference_integrity(records: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Records whose target does not exist; ``targets`` maps a type to its (target_id) table."""
    out = None
    for kind, known in targets.items():
        missing = records.where(F.col("target_type") == kind).join(known.select("target_id").distinct(), "target_id", "left_anti")
        out = missing if out is None else out.unionByName(missing)
    return out


def import_captures(offered: DataFrame, captures: DataFrame) -> DataFrame:
    """Attach only captures present with the same hash; the rest become warnings."""
    local = captures.select("capture_id", "sha256", F.lit(True).alias("present"))
    return offered.join(local, ["capture_id", "sha256"], "left").select(
        "capture_id", "sha256", F.coalesce("present", F.lit(False)).alias("attached"),
        F.when(
            F.col("present").isNull(), F.concat(F.lit("capture not available locally: "), F.coalesce(F.nullif("capture_id", F.lit("")), F.lit("(missing id)")))
        ).alias("warning"),
    )


def capture_dedup(uploads: DataFrame) -> DataFrame:
    """Same bytes, one capture: later ingests of a hash are flagged.

    The first ingest per hash is a partial aggregate; the join back leaves a hash
    with very many copies to the adaptive skew join.
    """
    first = uploads.groupBy("sha256").agg(F.min(F.struct("ingested_at", "upload_id")).alias("first"))
    return uploads.join(first, "sha256").select(
        "upload_id", "sha256", F.concat(F.lit("capture_"), F.substring("sha256", 1, 12)).alias("capture_id"),
        (F.struct("ingested_at", "upload_id") != F.col("first")).alias("duplicate"),
    )


def valid_filename(name: str | Column) -> Column:
    c = F.trim(F.col(name) if isinstance(name, str) else name)
    lower = F.lower(c)
    bad = c.contains("/") | c.contains("\\") | c.contains("..") | c.contains("\x00")
    return (F.length(c) > 0) & (F.length(c) <= V.MAX_FILENAME_LENGTH) & ~bad & (lower.endswith(".pcap") | lower.endswith(".pcapng"))
