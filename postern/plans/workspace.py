"""Evidence plus the tables derived from it.

Sessions, events and per-session findings are what an analysis run stores; every
other operator reads those tables. ``staged`` writes such a table once per
application into the cluster's shared checkpoint folder and reads it back, so
later plans start from a columnar scan and survive the loss of executors. Where
no shared folder is known on a cluster, the lazy plan itself is used.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


from postern.functions.columns import prefixed_sha
from postern.operators import correlation, drift, flows, graph, posture, reconstruct, rules, verification
from postern.session import python_partitions, shared_folder
from postern.sources import captures, wire
from postern.sources.policy import Policy
from postern.sources.testdata import Evidence

_STAGED: dict[tuple, tuple] = {}


def staged(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    folder = shared_folder(spark)
    if folder is None:
        return build()
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _STAGED:
        df = build()
        path = f"{folder}/staged-{spark.sparkContext.applicationId}-{abs(hash(source))}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        _STAGED[key] = (path, df.schema)
    path, schema = _STAGED[key]
    return spark.read.schema(schema).parquet(path)


class Workspace(Evidence):
    policy = Policy()

    def _staged(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return staged(self.spark, self.sf_dir, name, build)

    @cached_property
    def session_numbers(self) -> DataFrame:
        """Spread over as many files as there are tasks: a row is small, and what later steps build from it is not."""
        return self._staged("session_numbers", lambda: Evidence.session_numbers.func(self).repartition(python_partitions(self.spark), "session_id"))

    @cached_property
    def sessions(self) -> DataFrame:
        return self._staged("sessions", lambda: Evidence.sessions.func(self))

    @cached_property
    def session_events(self) -> DataFrame:
        return self._staged("session_events", lambda: Evidence.session_events.func(self))

    @cached_property
    def anomalies(self) -> DataFrame:
        return self._staged("anomalies", lambda: Evidence.anomalies.func(self))

    @cached_property
    def sessions_with_auth(self) -> DataFrame:
        return self._staged("sessions_with_auth", lambda: self.sessions.join(rules.auth_summary(self.session_events), "session_id", "left"))

    @cached_property
    def findings(self) -> DataFrame:
        return self._staged("findings", lambda: self.finding_rows)

    @cached_property
    def finding_rows(self) -> DataFrame:
        """The findings from the stored hits, not stored themselves: a reader of few columns makes only those."""
        return rules.findings_of(self.hits, self.policy)

    @cached_property
    def hits(self) -> DataFrame:
        return self._staged("hits", lambda: rules.session_hits(self.sessions, self.session_events, self.policy))

    @cached_property
    def factors(self) -> DataFrame:
        return self._staged("factors", lambda: posture.posture_factors(self.hits))

    @cached_property
    def priorities(self) -> DataFrame:
        return posture.posture_priorities(self.hits)

    @cached_property
    def posture(self) -> DataFrame:
        return self._staged("posture", lambda: posture.posture_snapshot(self.captures, self.hits, self.policy))

    @cached_property
    def index_entries(self) -> DataFrame:
        return self._staged(
            "index_entries",
            lambda: correlation.index_union(self.sessions, self.finding_rows, self.anomalies, self.case_captures),
        )

    @cached_property
    def correlations(self) -> DataFrame:
        return self._staged("correlations", lambda: correlation.correlated(self.condensed, self.members))

    @cached_property
    def condensed(self) -> DataFrame:
        """Index entries per (key, capture, evidence); stored, so the optimizer knows how few keys there are."""
        return self._staged("condensed", lambda: correlation._grouped(self.index_entries))

    @cached_property
    def members(self) -> DataFrame:
        """Members of the shared keys: every query that lists them reads them more than once."""
        return self._staged("members", lambda: correlation.members(self.index_entries, correlation._shared(self.condensed)))

    @cached_property
    def remediations(self) -> DataFrame:
        """One remediation per (case, rule) seen in the case's first capture."""
        first = self.case_captures.where(F.col("idx") == 0).select("case_id", "capture_id")
        picked = (
            self.findings.join(first, "capture_id").groupBy("case_id", "rule_id")
            .agg(F.min(F.struct("finding_id", "title", "remediation")).alias("f"))
        )
        n = F.length("f.title") + F.length("rule_id")
        choose = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), 1 + n % len(values))
        day = lambda span: F.lpad((1 + n % span).cast("string"), 2, "0")
        return picked.select(
            prefixed_sha("rem_", F.concat_ws("|", "case_id", "rule_id"), 16).alias("remediation_id"), "case_id", "rule_id",
            F.lit("finding").alias("target_type"), F.col("f.finding_id").alias("target_id"), F.col("f.title").alias("title"),
            F.lit("").alias("description"), F.col("f.remediation.action").alias("recommended_action"),
            choose(("OPEN", "PLANNED", "IN_PROGRESS", "BLOCKED", "COMPLETED", "CANCELLED")).alias("status"),
            choose(("CRITICAL", "HIGH", "MEDIUM", "LOW")).alias("priority"), choose(("ops", "Sec Team", "")).alias("owner"),
            F.when(n % 3 != 0, F.concat(F.lit("2024-03-"), day(28))).alias("due_at"),
            F.concat(F.lit("2024-02-"), day(27)).alias("updated_at"),
            choose(("NOT_VERIFIED", "PENDING", "VERIFIED", "FAILED", "INCONCLUSIVE")).alias("verification_status"), n.alias("n"),
        )

    @cached_property
    def chain(self) -> DataFrame:
        return drift.chain(self.case_captures, self.analysis)

    @cached_property
    def pairs(self) -> DataFrame:
        return drift.pairs(self.chain, self.baselines)

    @cached_property
    def comparison_requests(self) -> DataFrame:
        """Attached captures against the first of their case, the first against the last, every capture against the
        stored baseline and against the one two before it under the second as anchor, and each against itself."""
        c = self.case_captures.select("case_id", "capture_id", "idx")
        first = c.where("idx = 0").select("case_id", F.col("capture_id").alias("other"))
        second = c.where("idx = 1").select("case_id", F.col("capture_id").alias("anchor"))
        last = c.groupBy("case_id").agg(F.max_by("capture_id", "idx").alias("other"))
        before = c.select("case_id", F.col("capture_id").alias("other"), (F.col("idx") + 2).alias("idx"))
        none = F.lit(None).cast("string")
        row = lambda df, base, comparison, anchor=none: df.select("case_id", base.alias("baseline_capture_id"), comparison.alias("comparison_capture_id"), anchor.alias("anchor_capture_id"))
        one, other = F.col("capture_id"), F.col("other")
        return (
            row(c.join(first, "case_id"), other, one).union(row(c.where("idx = 0").join(last, "case_id"), other, one)).union(row(c, none, one))
            .union(row(c.join(before, ["case_id", "idx"]).join(second, "case_id"), other, one, F.col("anchor")))
        )

    @cached_property
    def requested_pairs(self) -> DataFrame:
        return drift.requested_pairs(self.comparison_requests, self.case_captures, self.chain, self.baselines)

    @cached_property
    def lifecycle(self) -> DataFrame:
        return self._staged("lifecycle", lambda: drift.finding_lifecycle(self.chain, self.pairs, self.findings, self.sessions))

    @cached_property
    def correlation_captures(self) -> DataFrame:
        return self._staged("correlation_captures", lambda: correlation.correlation_captures(self.index_entries))

    @cached_property
    def drift_records(self) -> DataFrame:
        return self._staged(
            "drift_records",
            lambda: drift.drift_chain(
                self.chain, self.pairs, self.sessions, self.findings, self.anomalies, self.posture, self.correlation_captures
            ),
        )

    @cached_property
    def verification_requests(self) -> DataFrame:
        """Every remediation against every later analysed capture of its case."""
        later = self.chain.where(F.col("pos") > 0).select("case_id", F.col("capture_id").alias("target_capture_id"))
        return self.remediations.select("case_id", "remediation_id", F.col("target_id").alias("finding_id")).join(later, "case_id")

    @cached_property
    def verifications(self) -> DataFrame:
        return verification.verification_records(
            verification.verify(self.verification_requests, self.findings, self.sessions, self.posture)
        )

    @cached_property
    def status_timeline(self) -> DataFrame:
        """One status history per order, some of them with steps the workflow forbids."""
        k = F.col("o_orderkey") % 4
        path = lambda *names: F.array(*[F.lit(n) for n in names])
        statuses = (
            F.when(k == 0, path("OPEN", "PLANNED", "IN_PROGRESS", "COMPLETED")).when(k == 1, path("OPEN", "COMPLETED", "OPEN"))
            .when(k == 2, path("OPEN", "PLANNED", "IN_PROGRESS", "BLOCKED", "COMPLETED")).otherwise(path("OPEN", "CANCELLED"))
        )
        return self.table("orders").select(
            prefixed_sha("rem_", F.col("o_orderkey").cast("string"), 16).alias("remediation_id"), F.posexplode(statuses).alias("entry_seq", "status")
        ).withColumn("entry_seq", F.col("entry_seq").cast("bigint"))

    @property
    def graph_tables(self) -> tuple[DataFrame, ...]:
        return self.sessions, self.finding_rows, self.session_events, self.anomalies, self.factors

    @cached_property
    def nodes(self) -> DataFrame:
        return self._staged("nodes", lambda: graph.graph_nodes(*self.graph_tables))

    @cached_property
    def node_ids(self) -> DataFrame:
        """capture_id, node_id and node_type of all nodes, stored as keys."""
        return graph.node_names(self._staged("node_keys", lambda: graph.node_keys(*self.graph_tables)))

    @cached_property
    def edges(self) -> DataFrame:
        """All edges, stored as keys."""
        return graph.edge_names(self._staged("edge_keys", lambda: graph.edge_keys(*self.graph_tables)))

    def asked_nodes(self, *node_types: str) -> DataFrame:
        """The nodes of some types, stored: so the optimizer knows how few they are before it reads the edges."""
        return self._staged("asked_" + "_".join(node_types), lambda: self.node_ids.where(F.col("node_type").isin(*node_types)).select("capture_id", "node_id"))

    @cached_property
    def capture_files(self) -> DataFrame:
        return self._staged("capture_files", lambda: wire.capture_files(self.session_numbers))

    @cached_property
    def parsed_packets(self) -> DataFrame:
        """TCP packets of the capture files with their flow, which several steps group by; a capture is named by its file here."""
        named = self.capture_files.select(F.substring_index("path", ".", 1).alias("capture_id"), "content")
        return flows.with_flow(captures.tcp_packets(captures.parse_packets(named)))

    @cached_property
    def located_packets(self) -> DataFrame:
        return self._staged("packets", lambda: self.parsed_packets)

    @cached_property
    def packets(self) -> DataFrame:
        return self.located_packets.drop(*flows.LOCATED)

    @cached_property
    def reconstruction(self):
        return reconstruct.Reconstruction(self.located_packets, self._kept)

    def _kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Segments have one reader, the fold behind them, and pieces with their side are a join that readers go on from: both stay where their rows met."""
        return build() if name in ("segments", "sided") else self._staged(f"wire_{name}", build)

    @cached_property
    def streams(self):
        """For queries that read nothing but the streams: packets are read once for them and not stored."""
        return reconstruct.Reconstruction(self.parsed_packets, self._kept)

    @cached_property
    def wire_timeline(self) -> DataFrame:
        return self._staged("wire_timeline", lambda: self.reconstruction.timeline)

    @cached_property
    def wire_sessions(self) -> DataFrame:
        """Rebuilt sessions in the stored form; certificates come from the table of decoded ones."""
        return self._staged("wire_sessions", lambda: self.reconstruction.nested_sessions(self.certificates))

    @cached_property
    def wire_hits(self) -> DataFrame:
        return self._staged("wire_hits", lambda: rules.session_hits(self.wire_sessions, self.wire_timeline, self.policy))

    @cached_property
    def line_segments(self) -> DataFrame:
        """Order lines as stream segments with gaps and overlaps; arrival order by line number and tie-breaks."""
        line = self.table("lineitem")
        order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        start = (F.col("l_linenumber").cast("bigint") - 1) * 25
        number = F.row_number().over(order).cast("bigint")
        return line.select(
            F.col("l_orderkey").alias("flow"), number.alias("number"), number.cast("double").alias("ts"), start.alias("start"),
            (start + F.col("l_quantity").cast("bigint")).alias("end"), (F.col("l_linestatus") == "F").alias("fin"), F.lit(None).cast("binary").alias("payload"),
        )
