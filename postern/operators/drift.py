"""Observations, lifecycle and drift along the attachment order of a case.

A case is a chain of analysed captures. Presence of rules, configurations,
certificates, protocols and shared keys is one narrow row per (case, entity,
position); what appeared or disappeared between neighbours follows from lag/lead
on that row set, and the lifecycle against a fixed baseline from running
aggregates. Both are linear in the chain - no pair of captures is compared
entity by entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.functions import fixed_values as V
from postern.functions import ids, labels

RECORD = [
    "drift_id", "case_id", "drift_type", "evidence_key", "baseline_capture_id", "previous_capture_id",
    "comparison_capture_id", "before_value", "after_value", "statement",
]


def chain(case_captures: DataFrame, analysis: DataFrame) -> DataFrame:
    """Analysed captures per case, positions from 0 in attachment order."""
    done = analysis.where(F.col("status") == "completed").select("capture_id")
    order = W.partitionBy("case_id").orderBy("idx")
    return case_captures.join(done, "capture_id", "left_semi").select(
        "case_id", "capture_id", (F.row_number().over(order) - 1).cast("bigint").alias("pos")
    )


def pairs(chain_: DataFrame, baselines: DataFrame) -> DataFrame:
    """Consecutive pairs with their lifecycle anchor: the stored baseline, else the previous capture."""
    order = W.partitionBy("case_id").orderBy("pos")
    consecutive = chain_.select(
        "case_id", F.lag("capture_id").over(order).alias("previous_capture_id"), F.col("capture_id").alias("later_capture_id"),
        F.col("pos").alias("later_pos"),
    ).where(F.col("previous_capture_id").isNotNull())
    stored = baselines.join(
        chain_.select("case_id", F.col("capture_id").alias("baseline_capture_id"), F.col("pos").alias("baseline_pos")),
        ["case_id", "baseline_capture_id"],
    )
    return consecutive.join(stored, "case_id", "left").select(
        "case_id", "previous_capture_id", "later_capture_id", "later_pos",
        F.coalesce("baseline_capture_id", "previous_capture_id").alias("anchor_capture_id"),
        F.coalesce(F.col("baseline_pos"), F.col("later_pos") - 1).alias("anchor_pos"),
    )


def requested_pairs(requests: DataFrame, case_captures: DataFrame, chain_: DataFrame, baselines: DataFrame) -> DataFrame:
    """Every request with its resolved pair and anchor, or the problem that rules it out.

    ``requests``: case_id, baseline_capture_id, comparison_capture_id,
    anchor_capture_id. No baseline (NULL or blank) means the stored one. No anchor
    means the stored baseline, else the pair's own; an anchor attached after the
    comparison gives way to the pair's own baseline. Rows without a problem serve
    as pairs; the same pair asked for twice is one.
    """
    given = lambda name: F.nullif(F.trim(name), F.lit(""))
    asked = requests.select("case_id", *[given(f"{side}_capture_id").alias(side) for side in ("baseline", "comparison", "anchor")]).distinct()
    stored = baselines.select("case_id", F.col("baseline_capture_id").alias("stored"))
    rows = asked.join(stored, "case_id", "left").withColumn("baseline", F.coalesce("baseline", "stored"))
    rows = rows.withColumn("anchor", F.coalesce("anchor", "stored", "baseline"))
    attached = case_captures.join(chain_.select("case_id", "capture_id", "pos"), ["case_id", "capture_id"], "left")
    for side in ("baseline", "comparison", "anchor"):
        rows = rows.join(attached.select("case_id", F.col("capture_id").alias(side), F.col("idx").alias(f"{side}_idx"), F.col("pos").alias(f"{side}_pos")), ["case_id", side], "left")
    foreign, undone = F.col("anchor_idx").isNull(), F.lit(" capture has not been analysed")
    own = F.col("anchor_idx") > F.col("comparison_idx")
    problem = (
        F.when(F.col("baseline").isNull(), "no baseline selected").when(F.col("baseline") == F.col("comparison"), "captures are the same")
        .when(F.col("baseline_idx").isNull(), "baseline capture is not in the case").when(F.col("baseline_pos").isNull(), F.concat(F.lit("baseline"), undone))
        .when(F.col("comparison_idx").isNull(), "comparison capture is not in the case").when(F.col("comparison_pos").isNull(), F.concat(F.lit("comparison"), undone))
        .when(foreign, "anchor capture is not in the case").when(~own & F.col("anchor_pos").isNull(), F.concat(F.lit("anchor"), undone))
    )
    resolved = lambda name: F.when(own, F.col(f"baseline{name}")).otherwise(F.col(f"anchor{name}"))
    return rows.select(
        "case_id", F.col("baseline").alias("previous_capture_id"), F.col("comparison").alias("later_capture_id"), F.col("comparison_pos").alias("later_pos"),
        resolved("").alias("anchor_capture_id"), resolved("_pos").alias("anchor_pos"), problem.alias("problem"),
    ).distinct()


def intermediates(pairs_: DataFrame, chain_: DataFrame) -> DataFrame:
    """Captures strictly between anchor and later; the case is the equi key of the range join."""
    inner = chain_.select("case_id", F.col("capture_id").alias("between_capture_id"), F.col("pos").alias("between_pos"))
    return pairs_.join(inner, "case_id").where(
        (F.col("between_pos") > F.col("anchor_pos")) & (F.col("between_pos") < F.col("later_pos"))
    ).select("case_id", "anchor_capture_id", "later_capture_id", "between_capture_id")


# -- observation child tables ------------------------------------------------------


def rule_presence(findings: DataFrame) -> DataFrame:
    return findings.groupBy("capture_id", "rule_id").agg(
        F.max(labels.severity_rank("severity")).alias("rank"), F.min("title").alias("title"),
        F.count("*").alias("n"), F.min("finding_id").alias("first_finding_id"),
    ).select("capture_id", "rule_id", labels.severity_of_rank("rank").alias("severity"), "title", "n", "first_finding_id")


def rule_finding_ids(findings: DataFrame, limit: int = V.MAX_IDS_PER_MAPPING) -> DataFrame:
    """The first finding ids of every (capture, rule) mapping."""
    order = W.partitionBy("capture_id", "rule_id").orderBy("finding_id")
    rows = findings.select("capture_id", "rule_id", "finding_id").withColumn("position", F.row_number().over(order).cast("bigint"))
    return rows.where(F.col("position") <= limit)


def tls_presence(sessions: DataFrame) -> DataFrame:
    hs = lambda n: F.col(f"handshake.{n}")
    known = sessions.where((hs("tls_version") != "") & (hs("cipher_suite") != "") & (hs("key_exchange") != ""))
    return known.groupBy(
        "capture_id", hs("tls_version").alias("tls_version"), hs("cipher_suite").alias("cipher_suite"), hs("key_exchange").alias("key_exchange")
    ).agg(F.count("*").alias("sessions")).withColumn(
        "fingerprint", ids.tls_config_fingerprint(F.col("tls_version"), F.col("cipher_suite"), F.col("key_exchange"))
    )


def certificate_presence(sessions: DataFrame) -> DataFrame:
    """Certificates per capture; validity judged at the earliest carrying session."""
    rows = sessions.select("capture_id", "session_id", "started_at", F.explode("certificates").alias("c"))
    fingerprint = F.coalesce("c.fingerprint_sha256", "c.certificate_id").alias("fingerprint")
    grouped = rows.groupBy("capture_id", fingerprint).agg(
        F.min("started_at").alias("earliest"), F.min_by("c", F.struct("started_at", "session_id")).alias("c"), F.count("*").alias("sessions")
    )
    return grouped.select(
        "capture_id", "fingerprint", "c.subject", "c.issuer", "sessions",
        F.col("earliest").between(F.col("c.not_before"), F.col("c.not_after")).alias("valid"),
    )


def protocol_presence(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("capture_id", F.coalesce("protocol", F.lit("unknown")).alias("protocol")).agg(F.count("*").alias("sessions"))


def endpoints(sessions: DataFrame) -> DataFrame:
    return sessions.select("capture_id", labels.endpoint_label("protocol", "server_ip", "server_port").alias("endpoint")).distinct()


def anomaly_distribution(anomalies: DataFrame) -> DataFrame:
    """Sorted status counts of a capture as text, with the totals."""
    per_status = anomalies.groupBy("capture_id", "status").agg(
        F.count("*").alias("n"), F.count("score").alias("scored")
    )
    listed = F.array_sort(F.collect_list(F.concat("status", F.lit("="), F.col("n").cast("string"))))
    return per_status.groupBy("capture_id").agg(
        F.array_join(listed, ";").alias("bands"), F.sum("n").alias("total_sessions"), F.sum("scored").alias("total_evaluated")
    ).select(
        "capture_id",
        F.concat("bands", F.lit(";total_evaluated="), F.col("total_evaluated").cast("string"), F.lit(";total_sessions="), F.col("total_sessions").cast("string")).alias("bands"),
    )


def observations(chain_, sessions, findings, anomalies, posture) -> DataFrame:
    """One row per analysed capture with the digest of its structured evidence.

    Lists here are vocabularies of a capture (rules, protocols, configurations,
    certificates), not its sessions.
    """
    words = lambda df, value, name: df.groupBy("capture_id").agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias(name))
    rules = rule_presence(findings).withColumn("r", F.concat_ws(":", "rule_id", "severity", F.col("n").cast("string")))
    counted = sessions.groupBy("capture_id").agg(F.count("*").alias("session_count"))
    rows = (
        chain_.join(counted, "capture_id", "left").join(words(rules, F.col("r"), "rules"), "capture_id", "left")
        .join(words(protocol_presence(sessions), F.col("protocol"), "protocols"), "capture_id", "left")
        .join(words(tls_presence(sessions), F.col("fingerprint"), "tls_configs"), "capture_id", "left")
        .join(words(certificate_presence(sessions), F.col("fingerprint"), "certificates"), "capture_id", "left")
        .join(anomaly_distribution(anomalies), "capture_id", "left")
        .join(posture.select("capture_id", "posture_state", F.col("overall_score").alias("posture_score")), "capture_id", "left")
    )
    canonical = F.concat_ws(
        "#", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
               ("rules", "posture_state", "posture_score", "session_count", "protocols", "tls_configs", "certificates", "bands")]
    )
    digest = F.sha2(canonical, 256)
    return rows.select(
        ids.observation_id(F.col("case_id"), F.col("capture_id"), digest).alias("observation_id"), "case_id", "capture_id", "pos",
        "posture_state", "posture_score", F.coalesce("session_count", F.lit(0)).alias("session_count"), "rules", "protocols",
        "tls_configs", "certificates", "bands", digest.alias("evidence_digest"),
    )


def posture_trend(chain_: DataFrame, posture: DataFrame) -> DataFrame:
    """Score change against the last earlier capture that has a score."""
    before = W.partitionBy("case_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = chain_.join(posture.select("capture_id", "posture_state", "overall_score"), "capture_id", "left")
    last = F.last("overall_score", ignorenulls=True).over(before)
    return rows.select("case_id", "capture_id", "pos", "posture_state", "overall_score", (F.col("overall_score") - last).alias("score_change_points"))


# -- lifecycle -----------------------------------------------------------------------


def anchor_reach(needed: DataFrame, findings: DataFrame, sessions: DataFrame) -> DataFrame:
    """(anchor, rule, observed) where the observed capture holds an endpoint the rule fired on in the anchor."""
    fired = findings.select(
        F.col("capture_id").alias("anchor_capture_id"), "rule_id", labels.endpoint_label("protocol", "server_ip", "server_port").alias("endpoint")
    ).distinct()
    seen = endpoints(sessions).withColumnRenamed("capture_id", "observed_capture_id")
    return (
        needed.select("anchor_capture_id", "observed_capture_id").distinct().join(fired, "anchor_capture_id")
        .join(seen, ["observed_capture_id", "endpoint"]).select("anchor_capture_id", "rule_id", "observed_capture_id").distinct()
    )


def comparability(needed: DataFrame, keys: DataFrame, findings: DataFrame, sessions: DataFrame) -> DataFrame:
    """keys(anchor, observed, rule) -> comparable: no baseline sessions, or a shared endpoint."""
    reach = anchor_reach(needed, findings, sessions).withColumn("reached", F.lit(True))
    in_anchor = findings.select(F.col("capture_id").alias("anchor_capture_id"), "rule_id").distinct().withColumn("in_anchor", F.lit(True))
    return keys.join(in_anchor, ["anchor_capture_id", "rule_id"], "left").join(
        reach, ["anchor_capture_id", "rule_id", "observed_capture_id"], "left"
    ).withColumn("comparable", F.col("in_anchor").isNull() | F.col("reached").isNotNull()).drop("in_anchor", "reached")


def trace(chain_: DataFrame, pairs_: DataFrame, findings: DataFrame, sessions: DataFrame) -> DataFrame:
    """For pairs with a fixed anchor before them: running state of every rule just before the later capture."""
    anchors = pairs_.where(F.col("anchor_pos") < F.col("later_pos") - 1).select("case_id", "anchor_capture_id", "anchor_pos").distinct()
    steps = chain_.join(anchors, "case_id").where(F.col("pos") >= F.col("anchor_pos")).withColumnRenamed("capture_id", "observed_capture_id")
    present = findings.select(F.col("capture_id").alias("observed_capture_id"), "rule_id").distinct()
    rules = steps.join(present, "observed_capture_id").select("case_id", "anchor_capture_id", "rule_id").distinct()
    dense = steps.join(rules, ["case_id", "anchor_capture_id"]).join(present.withColumn("present", F.lit(True)), ["observed_capture_id", "rule_id"], "left")
    dense = dense.withColumn("present", F.coalesce("present", F.lit(False)))
    judged = comparability(steps, dense, findings, sessions)
    key = W.partitionBy("case_id", "anchor_capture_id", "rule_id").orderBy("pos")
    before = key.rowsBetween(W.unboundedPreceding, -1)
    seen = F.coalesce(F.max("present").over(before), F.lit(False))
    rows = judged.withColumn("seen_before", seen).withColumn(
        "gap", (F.col("pos") > F.col("anchor_pos")) & ~F.col("present") & F.col("comparable") & F.col("seen_before")
    )
    return rows.withColumn("gap_before", F.coalesce(F.max("gap").over(before), F.lit(False)))


def finding_lifecycle(chain_, pairs_, findings, sessions) -> DataFrame:
    """Lifecycle of every rule of anchor or later, for every consecutive pair."""
    presence = rule_presence(findings)
    side = lambda capture, prefix: pairs_.join(
        presence.select(F.col("capture_id").alias(capture), "rule_id", *[F.col(c).alias(f"{prefix}_{c}") for c in ("severity", "title", "n", "first_finding_id")]),
        capture,
    )
    pair_key = ["case_id", "previous_capture_id", "later_capture_id", "later_pos", "anchor_capture_id", "anchor_pos", "rule_id"]
    rows = side("anchor_capture_id", "a").select(*pair_key, "a_severity", "a_title", "a_n", "a_first_finding_id").join(
        side("later_capture_id", "l").select(*pair_key, "l_severity", "l_title", "l_n", "l_first_finding_id"), pair_key, "full_outer"
    )
    keys = rows.withColumn("observed_capture_id", F.col("later_capture_id"))
    judged = comparability(keys, keys, findings, sessions)
    state = trace(chain_, pairs_, findings, sessions).select(
        "case_id", "rule_id", F.col("pos").alias("later_pos"), "anchor_capture_id", "seen_before", "gap_before"
    )
    full = judged.join(state, ["case_id", "rule_id", "later_pos", "anchor_capture_id"], "left")
    base, now = F.col("a_n").isNotNull(), F.col("l_n").isNotNull()
    gap = F.coalesce("gap_before", F.lit(False))
    prior = base | F.coalesce("seen_before", F.lit(False))
    lifecycle = (
        F.when(~F.col("comparable"), "not_comparable").when(now & gap, "recurred").when(now & ~base, "new")
        .when(now, "persistent").when(prior, "resolved").otherwise("not_comparable")
    )
    return full.select(
        "case_id", "anchor_capture_id", "previous_capture_id", "later_capture_id", "anchor_pos", "later_pos", "rule_id",
        F.coalesce("a_title", "l_title").alias("title"), base.alias("baseline_present"), now.alias("current_present"),
        lifecycle.alias("lifecycle"), F.coalesce("a_severity", "l_severity").alias("severity"),
        F.col("a_first_finding_id").alias("baseline_finding_id"), F.col("l_first_finding_id").alias("latest_finding_id"), "comparable",
        "a_severity", "l_severity", F.coalesce("a_n", F.lit(0)).alias("baseline_count"), F.coalesce("l_n", F.lit(0)).alias("current_count"),
    )


def absent_captures(lifecycle: DataFrame, trace_: DataFrame) -> DataFrame:
    """For recurred rules: the comparable captures in between that lacked the rule."""
    key = ["case_id", "anchor_capture_id", "rule_id"]
    recurred = lifecycle.where(F.col("lifecycle") == "recurred").select(*key, "anchor_pos", "later_pos").distinct()
    t = trace_.where(~F.col("present") & F.col("comparable")).select(*key, "pos", "observed_capture_id")
    between = recurred.join(t, key).where((F.col("pos") > F.col("anchor_pos")) & (F.col("pos") < F.col("later_pos")))
    return between.groupBy(*key, "later_pos").agg(
        F.array_join(F.array_sort(F.collect_list("observed_capture_id")), ", ").alias("absent_in")
    )


# -- drift records ---------------------------------------------------------------------


def _records(df: DataFrame, drift_type: Column, key: Column, before: Column, after: Column, statement: Column) -> DataFrame:
    return df.select(
        ids.drift_id(F.col("case_id"), F.col("anchor_capture_id"), F.col("later_capture_id"), drift_type, key).alias("drift_id"),
        "case_id", drift_type.alias("drift_type"), key.alias("evidence_key"), F.col("anchor_capture_id").alias("baseline_capture_id"),
        "previous_capture_id", F.col("later_capture_id").alias("comparison_capture_id"), before.alias("before_value"),
        after.alias("after_value"), statement.alias("statement"),
    )


def drift_posture(pairs_: DataFrame, posture: DataFrame) -> DataFrame:
    p = lambda capture, prefix: posture.select(F.col("capture_id").alias(capture), F.col("posture_state").alias(f"{prefix}_state"), F.col("overall_score").alias(f"{prefix}_score"))
    rows = pairs_.join(p("previous_capture_id", "p"), "previous_capture_id").join(p("later_capture_id", "l"), "later_capture_id")
    text = lambda s, n: F.concat(F.col(s), F.lit(":"), F.coalesce(F.col(n).cast("string"), F.lit("None")))
    delta = F.col("l_score") - F.col("p_score")
    moved = F.coalesce(delta != 0, F.lit(False))
    changed = rows.where((F.col("p_state") != F.col("l_state")) | moved)
    statement = F.concat_ws(
        " ",
        F.when(F.col("p_state") != F.col("l_state"), F.concat(F.lit("Posture state changed from "), "p_state", F.lit(" to "), "l_state", F.lit("."))),
        F.when(moved, F.concat(F.lit("Posture score changed from "), F.col("p_score").cast("string"), F.lit(" to "), F.col("l_score").cast("string"), F.lit("."))),
    )
    before, after = text("p_state", "p_score"), text("l_state", "l_score")
    return _records(changed, F.lit("posture_change"), F.concat(F.lit("posture|"), before, F.lit("->"), after), before, after, statement)


def drift_findings(lifecycle: DataFrame, trace_: DataFrame) -> DataFrame:
    rows = lifecycle.where(F.col("lifecycle").isin("new", "resolved", "recurred")).join(
        absent_captures(lifecycle, trace_), ["case_id", "anchor_capture_id", "rule_id", "later_pos"], "left"
    )
    kind = F.col("lifecycle")
    drift_type = F.when(kind == "new", "finding_introduced").when(kind == "resolved", "finding_resolved").otherwise("finding_recurred")
    rule, later, anchor = F.col("rule_id"), F.col("later_capture_id"), F.col("anchor_capture_id")
    head = F.concat(F.lit("Rule "), rule)
    statement = (
        F.when(kind == "new", F.concat(head, F.lit(" was first observed in capture "), later, F.lit(" (absent from baseline capture "), anchor, F.lit(").")))
        .when(kind == "resolved", F.concat(head, F.lit(" observed in baseline capture "), anchor, F.lit(" was not observed in capture "), later, F.lit(".")))
        .otherwise(F.concat(head, F.lit(" was observed again in capture "), later, F.lit(" after being absent in "), F.coalesce("absent_in", F.lit("an intermediate observation")), F.lit(".")))
    )
    seen = lambda severity, n: F.concat(F.lit("present:"), F.coalesce(severity, F.lit("none")), F.lit(":"), F.col(n).cast("string"))
    before = F.when(kind == "new", F.lit("absent")).otherwise(seen("a_severity", "baseline_count"))
    after = F.when(kind == "resolved", F.lit("absent")).otherwise(seen("l_severity", "current_count"))
    return _records(rows, drift_type, F.concat(F.lit("finding-rule|"), F.lower("rule_id")), before, after, statement)


def presence_changes(presence: DataFrame, chain_: DataFrame, entity: list[str]) -> DataFrame:
    """(case, entity, later_pos, in_later) wherever presence differs between neighbours.

    ``presence`` holds one row per (case, entity, pos). A row whose predecessor
    is not the neighbouring position appeared there; a row whose successor is
    not the next position disappears there - so one window replaces a full
    outer join per pair.
    """
    last = chain_.groupBy("case_id").agg(F.max("pos").alias("last_pos"))
    order = W.partitionBy("case_id", *entity).orderBy("pos")
    rows = presence.join(last, "case_id").select(
        "*", F.lag("pos").over(order).alias("earlier"), F.lead("pos").over(order).alias("next")
    )
    gained = F.when((F.col("pos") > 0) & (F.coalesce("earlier", F.lit(-2)) != F.col("pos") - 1), F.struct(F.col("pos").alias("later_pos"), F.lit(True).alias("in_later")))
    lost = F.when((F.col("pos") < F.col("last_pos")) & (F.coalesce("next", F.lit(-2)) != F.col("pos") + 1), F.struct((F.col("pos") + 1).alias("later_pos"), F.lit(False).alias("in_later")))
    exploded = rows.withColumn("change", F.explode(F.array_compact(F.array(gained, lost))))
    return exploded.select(*[c for c in presence.columns if c != "pos"], "change.later_pos", "change.in_later")


def _located(presence: DataFrame, chain_: DataFrame) -> DataFrame:
    return presence.join(chain_, [c for c in ("case_id", "capture_id") if c in presence.columns]).drop("capture_id")


def neighbour_changes(presence: DataFrame, chain_: DataFrame, pairs_: DataFrame, entity: list[str]) -> DataFrame:
    """Rows of pairs with the entities that only one of the two has, for consecutive pairs."""
    return presence_changes(_located(presence, chain_), chain_, entity).join(pairs_, ["case_id", "later_pos"])


def pair_changes(presence: DataFrame, chain_: DataFrame, pairs_: DataFrame, entity: list[str]) -> DataFrame:
    """The same for any pairs: what both captures hold meets in one aggregate per (pair, entity)."""
    on = [c for c in ("case_id", "capture_id") if c in presence.columns]
    details = [c for c in presence.columns if c not in ("case_id", "capture_id", *entity)]
    side = lambda capture, later: pairs_.withColumn("capture_id", F.col(capture)).join(presence, on).withColumn("in_later", F.lit(later)).drop("capture_id")
    both = side("previous_capture_id", False).unionByName(side("later_capture_id", True))
    # an entity of one capture only is one row, so its details are those of the group
    return both.groupBy(*pairs_.columns, *entity).agg(
        F.count("*").alias("sides"), F.first("in_later").alias("in_later"), *[F.first(c).alias(c) for c in details]
    ).where("sides = 1").drop("sides")


def _appeared(name: Column) -> Column:
    here = F.when(F.col("in_later"), F.col("later_capture_id")).otherwise(F.col("previous_capture_id"))
    there = F.when(F.col("in_later"), F.col("previous_capture_id")).otherwise(F.col("later_capture_id"))
    return F.concat(name, F.lit(" was observed in capture "), here, F.lit(" but not in capture "), there, F.lit("."))


def _presence_drift(changes, entity, drift_type, prefix, detail, name) -> DataFrame:
    before = F.when(F.col("in_later"), F.lit("absent")).otherwise(detail)
    after = F.when(F.col("in_later"), detail).otherwise(F.lit("absent"))
    key = F.concat(F.lit(prefix), F.col(entity))
    return _records(changes, F.lit(drift_type), key, before, after, _appeared(F.concat(F.lit(name), F.col(entity))))


def drift_tls_config(chain_, pairs_, sessions, changes=neighbour_changes) -> DataFrame:
    presence = tls_presence(sessions).drop("sessions")
    detail = F.concat_ws("|", F.lit("present"), "tls_version", "cipher_suite", "key_exchange")
    return _presence_drift(changes(presence, chain_, pairs_, ["fingerprint"]), "fingerprint", "tls_configuration_changed", "tls-config|", detail, "TLS configuration ")


def drift_certificate(chain_, pairs_, sessions, changes=neighbour_changes) -> DataFrame:
    presence = certificate_presence(sessions).select("capture_id", "fingerprint", "subject", "issuer")
    detail = F.concat_ws("|", F.lit("present"), "subject", "issuer")
    return _presence_drift(changes(presence, chain_, pairs_, ["fingerprint"]), "fingerprint", "certificate_changed", "certificate|", detail, "Certificate ")


def drift_protocol(chain_, pairs_, sessions, changes=neighbour_changes) -> DataFrame:
    presence = protocol_presence(sessions).select("capture_id", "protocol")
    return _presence_drift(changes(presence, chain_, pairs_, ["protocol"]), "protocol", "protocol_behavior_changed", "protocol|", F.lit("present"), "Protocol ")


def neighbour_flips(chain_, pairs_, sessions) -> DataFrame:
    """Consecutive pairs with the certificates of both whose validity differs."""
    rows = _located(certificate_presence(sessions), chain_)
    order = W.partitionBy("case_id", "fingerprint").orderBy("pos")
    return rows.select(
        "case_id", "fingerprint", "subject", F.col("pos").alias("later_pos"), F.col("valid").alias("now"),
        F.lag("valid").over(order).alias("was"), F.lag("pos").over(order).alias("earlier"),
    ).where((F.col("earlier") == F.col("later_pos") - 1) & (F.col("was") != F.col("now"))).join(pairs_, ["case_id", "later_pos"])


def pair_flips(chain_, pairs_, sessions) -> DataFrame:
    """The same for any pairs."""
    held = certificate_presence(sessions)
    side = lambda capture, name: held.select(F.col("capture_id").alias(capture), "fingerprint", F.col("valid").alias(name))
    both = pairs_.join(side("previous_capture_id", "was"), "previous_capture_id").join(side("later_capture_id", "now"), ["later_capture_id", "fingerprint"])
    return both.where(F.col("was") != F.col("now"))


def drift_certificate_validity(chain_, pairs_, sessions, flips=neighbour_flips) -> DataFrame:
    flipped = flips(chain_, pairs_, sessions)
    statement = F.concat(
        F.lit("Certificate "), "fingerprint", F.lit(" validity status changed between capture "), "previous_capture_id", F.lit(" and capture "), "later_capture_id", F.lit(".")
    )
    text = lambda c: F.concat(F.lit("valid="), F.col(c).cast("string"))
    return _records(flipped, F.lit("certificate_validity_changed"), F.concat(F.lit("certificate-validity|"), "fingerprint"), text("was"), text("now"), statement)


def drift_anomaly_bands(chain_, pairs_, anomalies) -> DataFrame:
    bands = anomaly_distribution(anomalies)
    side = lambda capture, name: bands.select(F.col("capture_id").alias(capture), F.col("bands").alias(name))
    rows = pairs_.join(side("previous_capture_id", "was"), "previous_capture_id").join(side("later_capture_id", "now"), "later_capture_id")
    statement = F.concat(F.lit("Anomaly band distribution changed between capture "), "previous_capture_id", F.lit(" and capture "), "later_capture_id", F.lit("."))
    return _records(rows.where(F.col("was") != F.col("now")), F.lit("anomaly_state_changed"), F.lit("anomaly-bands"), F.col("was"), F.col("now"), statement)


def drift_correlation(chain_, pairs_, correlation_captures, changes=neighbour_changes) -> DataFrame:
    changed = changes(correlation_captures, chain_, pairs_, ["correlation_type", "evidence_key"])
    text = F.when(F.col("in_later"), F.lit("observed")).otherwise(F.lit("no longer observed"))
    where = F.when(F.col("in_later"), F.col("later_capture_id")).otherwise(F.col("previous_capture_id"))
    statement = F.concat(F.lit("Shared evidence "), "correlation_type", F.lit(" ("), "evidence_key", F.lit(") is "), text, F.lit(" in capture "), where, F.lit("."))
    key = F.concat_ws("|", F.lit("correlation"), "correlation_type", "evidence_key")
    return _records(changed, F.lit("correlation_pattern_changed"), key, (~F.col("in_later")).cast("string"), F.col("in_later").cast("string"), statement)


def drift_chain(chain_, pairs_, sessions, findings, anomalies, posture, correlation_captures, changes=neighbour_changes, flips=neighbour_flips) -> DataFrame:
    """Every drift record of every case."""
    lifecycle = finding_lifecycle(chain_, pairs_, findings, sessions)
    parts = [
        drift_posture(pairs_, posture), drift_findings(lifecycle, trace(chain_, pairs_, findings, sessions)),
        drift_tls_config(chain_, pairs_, sessions, changes), drift_certificate(chain_, pairs_, sessions, changes),
        drift_certificate_validity(chain_, pairs_, sessions, flips), drift_protocol(chain_, pairs_, sessions, changes),
        drift_anomaly_bands(chain_, pairs_, anomalies), drift_correlation(chain_, pairs_, correlation_captures, changes),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compare_pairs(chain_, pairs_, sessions, findings, anomalies, posture, correlation_captures) -> DataFrame:
    """Drift records of any requested pairs of captures, in either order, over all dimensions."""
    return drift_chain(chain_, pairs_, sessions, findings, anomalies, posture, correlation_captures, pair_changes, pair_flips)


def drift_order() -> list[Column]:
    return [F.col(c) for c in ("drift_type", "evidence_key", "baseline_capture_id", "comparison_capture_id", "drift_id")]


def drift_list(records: DataFrame, *, kind: str | None = None, comparison: str | None = None, limit: int = V.MAX_DRIFT) -> DataFrame:
    """Records per case in canonical order, at most ``limit`` per case."""
    rows = records
    if kind:
        rows = rows.where(F.col("drift_type") == kind.strip().lower())
    if comparison:
        rows = rows.where(F.col("comparison_capture_id") == comparison.strip())
    ranked = rows.withColumn("position", F.row_number().over(W.partitionBy("case_id").orderBy(*drift_order())).cast("bigint"))
    return ranked.where(F.col("position") <= limit)


def drift_summary(cases: DataFrame, chain_: DataFrame, baselines: DataFrame, records: DataFrame) -> DataFrame:
    kind = F.col("drift_type")
    counts = records.groupBy("case_id").agg(
        F.count("*").alias("drift_count"), F.count_if(kind == "posture_change").alias("posture_changes"),
        F.count_if(kind == "finding_introduced").alias("new_findings"), F.count_if(kind == "finding_resolved").alias("resolved_findings"),
        F.count_if(kind == "finding_recurred").alias("recurring_findings"),
        F.count_if(kind.isin(*V.CONFIGURATION_DRIFT_TYPES)).alias("configuration_changes"),
        F.count_if(kind == "anomaly_state_changed").alias("anomaly_changes"),
    )
    seen = chain_.groupBy("case_id").agg(F.count("*").alias("observations"))
    rows = cases.select("case_id").join(seen, "case_id", "left").join(baselines, "case_id", "left").join(counts, "case_id", "left")
    return rows.na.fill(0)


def link_regressions(records: DataFrame, remediations: DataFrame, verifications: DataFrame) -> DataFrame:
    """Recurred findings whose rule had a remediation with a VERIFIED verification."""
    verified = verifications.where(F.col("result") == "VERIFIED").select("remediation_id", "verification_id")
    linked = remediations.select("case_id", "remediation_id", F.lower("rule_id").alias("rule")).join(verified, "remediation_id")
    recurred = records.where(F.col("drift_type") == "finding_recurred").withColumn("rule", F.expr("substring(evidence_key, instr(evidence_key, '|') + 1)"))
    joined = recurred.join(linked, ["case_id", "rule"])
    rem = joined.select(*RECORD, "remediation_id", "verification_id")
    # One remediation per rule and one verification per later capture: short lists.
    return rem.groupBy("drift_id", "case_id", "evidence_key", "comparison_capture_id", "statement").agg(
        F.array_join(F.array_sort(F.collect_set("remediation_id")), ", ").alias("remediation_ids"),
        F.array_join(F.array_sort(F.collect_set("verification_id")), ", ").alias("verification_ids"),
    ).withColumn("statement", F.concat("statement", F.lit(" Existing remediation "), "remediation_ids", F.lit(" may require review.")))


def case_comparisons(pairs_, sessions, posture, drift_records) -> DataFrame:
    """Before/after set summaries of every pair."""
    summary = sessions.where(F.col("handshake").isNotNull()).groupBy("capture_id").agg(
        *[F.array_join(F.array_sort(F.collect_set(f"handshake.{c}")), ",").alias(c) for c in ("tls_version", "cipher_suite", "key_exchange")]
    )
    configs = tls_presence(sessions).groupBy("capture_id").agg(F.count("*").alias("configurations"))
    certs = certificate_presence(sessions).groupBy("capture_id").agg(F.count("*").alias("certificates"))
    protocols = protocol_presence(sessions).groupBy("capture_id").agg(F.array_join(F.array_sort(F.collect_set("protocol")), ",").alias("protocols"))
    score = posture.select("capture_id", F.col("overall_score").alias("score"))
    state = score.join(summary, "capture_id", "left").join(configs, "capture_id", "left").join(certs, "capture_id", "left").join(protocols, "capture_id", "left")
    side = lambda capture, suffix: state.select(F.col("capture_id").alias(capture), *[F.col(c).alias(f"{c}_{suffix}") for c in state.columns if c != "capture_id"])
    records = drift_records.groupBy("case_id", F.col("comparison_capture_id").alias("later_capture_id")).agg(F.count("*").alias("drift_records"))
    return (
        pairs_.join(side("previous_capture_id", "before"), "previous_capture_id", "left").join(side("later_capture_id", "after"), "later_capture_id", "left")
        .join(records, ["case_id", "later_capture_id"], "left")
        .withColumns({"score_delta": F.col("score_after") - F.col("score_before"), "drift_records": F.coalesce("drift_records", F.lit(0))})
    )
