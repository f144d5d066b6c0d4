"""Deterministic projection of the driver's star-schema tables onto evidence tables.

The test tables hold no packets, so sessions, certificates, anomalies and case
records are derived from them by integer arithmetic only (FIXTURES.md, part C).
Every evidence table grows with its source table; nothing is sampled.

``SESSION_NUMBERS`` and the other *_NUMBERS lists are plain SQL expressions that
mean the same in Spark and in the SQL oracle, so both derive the same input.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.functions import ids, labels
from postern.functions.columns import case_map, memo, prefixed_sha

# Fixed values of the projection: profile -> (version, suite code, adv, req, resp, handshake).
PROFILES = (
    (0, "TLS 1.2", 49199, True, True, True),
    (1, "TLS 1.3", 4865, None, None, None),
    (2, "TLS 1.0", 49171, True, True, True),
    (3, "TLS 1.2", 10, True, True, True),
    (4, None, None, True, False, False),
    (5, None, None, True, True, False),
    (6, "TLS 1.2", 47, True, True, True),
    (7, "SSL 3.0", 4, None, None, None),
    (8, "TLS 1.2", 49199, True, True, True),
    (9, None, None, None, None, None),
    (10, "TLS 1.1", 65000, True, True, True),
    (11, "TLS 1.2", 156, True, True, True),
)
CERTIFICATE_PROFILES = (0, 2, 3, 6, 8, 10, 11)

SESSION_NUMBERS = (
    ("cap", "CAST(c_nationkey AS BIGINT)"),
    ("h", "(o_orderkey * 7919 + CAST(c_nationkey AS BIGINT) * 104729) % 1000003"),
    ("p", "CASE WHEN h % 4 < 2 THEN h % 2 ELSE (cap * 5 + h % 3) % 12 END"),
    ("host", "10 + cap % 3 + CAST((h - h % 3) / 3 AS BIGINT) % 4"),
    ("implicit_tls", "p IN (1, 7)"),
    ("protocol", "CASE host % 3 WHEN 0 THEN 'imap' WHEN 1 THEN 'pop3' ELSE 'smtp' END"),
    (
        "server_port",
        "CAST(CASE WHEN p IN (1, 7) THEN CASE host % 3 WHEN 0 THEN 993 WHEN 1 THEN 995 ELSE 465 END "
        "ELSE CASE host % 3 WHEN 0 THEN 143 WHEN 1 THEN 110 ELSE 25 END END AS INT)",
    ),
    ("server_ip", "concat('198.51.100.', CAST(host AS STRING))"),
    (
        "client_ip",
        "concat('10.', CAST(CAST((o_custkey - o_custkey % 62500) / 62500 AS BIGINT) AS STRING), '.', "
        "CAST(CAST((o_custkey - o_custkey % 250) / 250 AS BIGINT) % 250 AS STRING), '.', "
        "CAST(o_custkey % 250 AS STRING))",
    ),
    ("client_port", "CAST(40000 + o_orderkey % 20000 AS INT)"),
    ("packet_count", "8 + h % 40"),
    ("bytes_client_to_server", "200 + h % 5000"),
    ("bytes_server_to_client", "400 + h % 90000"),
    ("complete", "h % 11 <> 0"),
    ("cert_no", f"CASE WHEN p IN {CERTIFICATE_PROFILES} THEN (cap % 5) * 3 + h % 3 END"),
    ("offered_count", "1 + h % 4"),
    ("start_offset", "h % 86400"),
    ("length_seconds", "h % 600"),
)
OFFERED_SUITES = (
    "TLS_AES_128_GCM_SHA256",
    "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256",
    "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA",
    "TLS_RSA_WITH_3DES_EDE_CBC_SHA",
)
ANOMALY_NUMBERS = (
    ("draw", "(h * 31) % 1000"),
    ("score", "CASE WHEN h % 97 = 0 THEN NULL WHEN draw < 50 THEN 50 + draw % 51 ELSE draw % 50 END"),
)
UNANALYSED_CAPTURE, FAILED_CAPTURE, UNATTACHED_CAPTURE = 24, 19, 23
LAST_CASE_WITH_BASELINE = 2


def _profile_value(position: int, sql_type: str):
    rows = {row[0]: row[position] for row in PROFILES if row[position] is not None}
    return case_map(F.col("p"), rows).cast(sql_type)


class Evidence:
    """Lazily planned evidence tables over one directory of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- captures and cases --------------------------------------------------

    @cached_property
    def captures(self) -> DataFrame:
        nation = self.table("nation")
        sha = F.sha2("n_name", 256)
        return nation.select(
            ids.capture_id(sha).alias("capture_id"),
            F.col("n_nationkey").cast("bigint").alias("cap"),
            F.format_string("nation_%d.pcap", F.col("n_nationkey")).alias("filename"),
            F.when(F.col("n_nationkey") % 2 == 0, "pcap").otherwise("pcapng").alias("format"),
            (F.col("n_nationkey").cast("bigint") * 4096 + 24).alias("size_bytes"),
            sha.alias("sha256"),
            F.lit("ready").alias("status"),
            (F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval(hours=F.col("n_nationkey") % 12)).alias(
                "ingested_at"
            ),
        )

    @cached_property
    def cases(self) -> DataFrame:
        return self.table("region").select(
            F.concat(F.lit("case_"), F.col("r_regionkey").cast("string")).alias("case_id"),
            F.col("r_name").alias("title"),
            F.when(F.col("r_regionkey") % 2 == 0, "OPEN").otherwise("CLOSED").alias("status"),
        )

    @cached_property
    def case_captures(self) -> DataFrame:
        """Attachments; idx is the attachment order within the case, from 0."""
        attached = self.table("nation").where(F.col("n_nationkey") != UNATTACHED_CAPTURE)
        order = W.partitionBy("n_regionkey").orderBy("n_nationkey")
        return attached.select(
            F.concat(F.lit("case_"), F.col("n_regionkey").cast("string")).alias("case_id"),
            ids.capture_id(F.sha2("n_name", 256)).alias("capture_id"),
            (F.row_number().over(order) - 1).cast("bigint").alias("idx"),
        )

    @cached_property
    def baselines(self) -> DataFrame:
        """Stored baseline per case (the first attachment), for some cases only."""
        stored = [f"case_{n}" for n in range(LAST_CASE_WITH_BASELINE + 1)]
        return self.case_captures.where((F.col("idx") == 0) & F.col("case_id").isin(*stored)).select(
            "case_id", F.col("capture_id").alias("baseline_capture_id")
        )

    @cached_property
    def analysis(self) -> DataFrame:
        """Analysis records: one failed, one capture without any record."""
        c = self.captures.where(F.col("cap") != UNANALYSED_CAPTURE)
        failed = F.col("cap") == FAILED_CAPTURE
        return c.select(
            "capture_id",
            F.when(failed, "failed").otherwise("completed").alias("status"),
            F.when(failed, F.lit("capture could not be read")).alias("warning"),
            (F.expr("timestamp'2024-02-01 00:00:00'") + F.make_dt_interval(hours=F.col("cap").cast("int"))).alias(
                "analyzed_at"
            ),
        )

    # -- sessions --------------------------------------------------------------

    @cached_property
    def session_numbers(self) -> DataFrame:
        """orders joined to their customer's nation, with the derived integers."""
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        base = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        capture_ids = self.captures.select("cap", "capture_id")
        df = base.selectExpr("*", *[f"{expression} AS {name}" for name, expression in SESSION_NUMBERS])
        df = df.join(capture_ids, "cap")
        flow = F.concat_ws(
            "|", F.lit("tcp"), "client_ip", F.col("client_port").cast("string"), "server_ip",
            F.col("server_port").cast("string"), F.col("o_orderkey").cast("string"),
        )
        started = F.timestamp_seconds(
            F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("start_offset")
        )
        return df.withColumn("session_id", ids.session_id("capture_id", flow)).withColumn("started_at", started)

    @cached_property
    def sessions(self) -> DataFrame:
        return self.session_numbers.select(*memo("sessions", self._session_columns))

    def _session_columns(self) -> list:
        code = _profile_value(2, "int")
        suite = labels.cipher_suite_name(code)
        offered = F.slice(F.array(*[F.lit(s) for s in OFFERED_SUITES]), F.lit(1), F.col("offered_count").cast("int"))
        extension = lambda type_code, name, length, value: F.struct(
            F.lit(type_code).alias("type_code"), F.lit(name).alias("name"),
            F.lit(length).alias("length"), value.alias("value"),
        )
        sni = F.format_string("mail%d.example.org", F.col("host"))
        extensions = F.array_compact(
            F.array(
                extension(0, "server_name", 24, sni),
                F.when(F.col("h") % 2 == 1, extension(13, "signature_algorithms", 8, F.lit("rsa_pkcs1_sha256"))),
                F.when(
                    F.col("p") == 1,
                    extension(16, "application_layer_protocol_negotiation", 12, F.lit("imap, smtp")),
                ),
            )
        )
        packet = lambda k: F.array((F.lit(k) + F.col("h") % 3).cast("int"))
        handshake = F.when(
            ~F.col("p").isin(4, 5, 9),
            F.struct(
                ids.tls_handshake_id("session_id").alias("handshake_id"),
                _profile_value(1, "string").alias("tls_version"),
                code.alias("cipher_suite_code"),
                suite.alias("cipher_suite"),
                labels.key_exchange_for_suite(suite).alias("key_exchange"),
                offered.alias("cipher_suites_offered"),
                extensions.alias("extensions"),
                sni.alias("sni_server_name"),
                (F.col("p") != 8).alias("handshake_complete"),
                F.when(F.col("p") == 8, "handshake did not progress beyond the hello exchange").alias(
                    "completeness_reason"
                ),
                packet(4).alias("client_hello_packets"),
                packet(6).alias("server_hello_packets"),
            ),
        )
        starttls = F.when(
            ~F.col("p").isin(1, 7, 9),
            F.struct(
                _profile_value(3, "boolean").alias("advertised"),
                _profile_value(4, "boolean").alias("requested"),
                _profile_value(5, "boolean").alias("response_seen"),
                F.when(_profile_value(4, "boolean"), F.lit(3)).alias("packet_number"),
            ),
        )
        ended = F.timestamp_seconds(F.unix_seconds("started_at") + F.col("length_seconds"))
        return [
            "session_id", "capture_id", "client_ip", "client_port", "server_ip", "server_port", "protocol",
            F.lit("high").alias("confidence"),
            F.lit("client_server").alias("orientation"),
            "implicit_tls", "started_at",
            ended.alias("ended_at"),
            F.col("length_seconds").cast("double").alias("duration_seconds"),
            "packet_count", "bytes_client_to_server", "bytes_server_to_client", "complete",
            F.when(~F.col("complete"), "no FIN or RST observed (no graceful termination)").alias(
                "completeness_reason"
            ),
            (F.col("h") % 3).alias("retransmissions"),
            F.lit(0).cast("bigint").alias("gap_count"),
            F.lit(0).cast("bigint").alias("gap_bytes"),
            starttls.alias("starttls"),
            handshake.alias("handshake"),
            self._chain().alias("certificates"),
        ]

    @staticmethod
    def _chain():
        """The presented chain as a nested array, leaf first (NULL-free, possibly empty)."""
        k = F.col("cert_no")
        day = lambda start, days: F.timestamp_seconds(
            F.unix_seconds(F.expr(f"timestamp'{start} 00:00:00'")) + days * 86400
        )
        self_signed = k % 4 == 3
        ca = F.format_string("CN=Example Issuing CA %d", k % 3)
        subject = F.format_string("CN=mail%d.example.org", k)

        def certificate(position, subj, issuer, before, after, signature, algorithm, bits, sans, fingerprint):
            return F.struct(
                F.lit(position).alias("position_in_chain"),
                F.concat(F.lit("cert_"), F.substring(fingerprint, 1, 12)).alias("certificate_id"),
                subj.alias("subject"), issuer.alias("issuer"),
                before.alias("not_before"), after.alias("not_after"),
                signature.alias("signature_algorithm"), algorithm.alias("public_key_algorithm"),
                bits.cast("int").alias("public_key_size_bits"),
                sans.alias("subject_alternative_names"), fingerprint.alias("fingerprint_sha256"),
            )

        signature = (
            F.when(k == 13, "md5WithRSAEncryption").when(k % 6 == 1, "sha1WithRSAEncryption")
            .otherwise("sha256WithRSAEncryption")
        )
        algorithm = F.when(k == 9, "Ed25519").when(k % 7 == 0, "EC").otherwise("RSA")
        bits = F.when(k == 9, None).when(k % 7 == 0, 256).when(k % 5 == 1, 1024).otherwise(2048)
        sans = F.when(k % 5 == 2, F.array(F.lit("other.example.org"))).otherwise(
            F.array(F.lit("*.example.org"), F.lit("example.org"))
        )
        leaf = certificate(
            0, subject, F.when(self_signed, subject).otherwise(ca), day("1994-01-01", k * 30),
            day("1996-01-01", k * 120), signature, algorithm, bits, sans,
            F.sha2(F.concat(F.lit("cert"), k.cast("string")), 256),
        )
        issuer = certificate(
            1, ca, F.lit("CN=Example Root CA"), day("1990-01-01", k * 0), day("2030-01-01", k * 0),
            F.lit("sha256WithRSAEncryption"), F.lit("RSA"), F.lit(4096), F.array().cast("array<string>"),
            F.sha2(F.concat(F.lit("issuer"), (k % 3).cast("string")), 256),
        )
        chained = (k % 2 == 0) | (k == 11)
        empty = F.slice(F.array(leaf), F.lit(1), F.lit(0))
        return F.when(k.isNull(), empty).when(chained, F.array(leaf, issuer)).otherwise(F.array(leaf))

    @cached_property
    def certificates(self) -> DataFrame:
        s = self.sessions.select("capture_id", "session_id", "started_at", F.explode("certificates").alias("c"))
        return s.select("capture_id", "session_id", "started_at", "c.*")

    @cached_property
    def session_events(self) -> DataFrame:
        """Timeline rows per session, numbered by position."""
        rows = self.session_numbers.withColumn(
            "ended_at", F.timestamp_seconds(F.unix_seconds("started_at") + F.col("length_seconds"))
        ).select("capture_id", "session_id", F.posexplode(memo("session_events", self._event_array)).alias("seq", "e"))
        return rows.select(
            "capture_id", "session_id", F.col("seq").cast("bigint").alias("seq"), "e.type", "e.direction", "e.ts",
            "e.packet_numbers",
            F.create_map(F.col("e.detail_key"), F.col("e.detail_value")).alias("detail"),
        )

    @staticmethod
    def _event_array():
        adv, req, resp = (_profile_value(i, "boolean") for i in (3, 4, 5))
        c2s, s2c, none = "client_to_server", "server_to_client", "unknown"

        def event(kind, direction, packet, key, value, at="started_at"):
            return F.struct(
                F.lit(kind).alias("type"), F.lit(direction).alias("direction"), F.col(at).alias("ts"),
                F.array(packet.cast("int")).alias("packet_numbers"),
                F.lit(key).alias("detail_key"), value.alias("detail_value"),
            )

        login = (F.col("p") == 9) & (F.col("h") % 2 == 1)
        is_proto = lambda name: F.col("protocol") == name
        return F.array_compact(
            F.array(
                event("connection_established", none, F.lit(1), "basis", F.lit("syn")),
                event("server_greeting", s2c, F.lit(2), "greeting", F.col("protocol")),
                F.when(adv, event("starttls_advertised", s2c, F.lit(2), "capability", F.lit("STARTTLS"))),
                F.when(req, event("starttls_requested", c2s, F.lit(3), "tag", F.lit(""))),
                F.when(resp, event("starttls_response", s2c, F.lit(3), "tag", F.lit(""))),
                F.when(login & is_proto("imap"), event("authentication", c2s, F.lit(5), "command", F.lit("LOGIN"))),
                F.when(login & is_proto("smtp"), event("authentication", c2s, F.lit(5), "mechanism", F.lit("PLAIN"))),
                F.when(login & is_proto("pop3"), event("authentication", c2s, F.lit(5), "command", F.lit("USER"))),
                F.when(login & is_proto("pop3"), event("authentication", c2s, F.lit(6), "command", F.lit("PASS"))),
                F.when(F.col("complete"), event("connection_closed", none, F.col("packet_count"), "basis", F.lit("fin"), "ended_at")),
            )
        )

    @cached_property
    def anomalies(self) -> DataFrame:
        """Stored anomaly results (scores drawn by integer arithmetic)."""
        df = self.session_numbers.selectExpr("*", *[f"{expression} AS {name}" for name, expression in ANOMALY_NUMBERS])
        band = labels.anomaly_band("score")
        return df.select(
            ids.anomaly_id("session_id").alias("anomaly_id"), "capture_id", "session_id", "protocol",
            F.coalesce(band, F.lit("insufficient_evidence")).alias("status"),
            F.col("score").cast("int").alias("score"), band.alias("band"),
        )

    # -- analyst records ---------------------------------------------------------

    @cached_property
    def notes(self) -> DataFrame:
        """One note per customer; targets cycle over sessions, captures, cases and unknown ids."""
        c = self.table("customer").select("c_custkey", "c_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_regionkey", "n_name")
        sessions = self.session_numbers.select("o_orderkey", "session_id")
        df = c.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
            sessions, F.col("o_orderkey") == F.col("c_custkey"), "left"
        )
        case = F.concat(F.lit("case_"), F.col("n_regionkey").cast("string"))
        kind = F.col("c_custkey") % 4
        return df.select(
            prefixed_sha("note_", F.col("c_custkey").cast("string"), 16).alias("note_id"),
            case.alias("case_id"),
            F.when(kind == 0, "session").when(kind == 1, "capture").when(kind == 2, "case").otherwise("finding").alias(
                "target_type"
            ),
            F.when(kind == 0, F.coalesce("session_id", F.lit("session_missing")))
            .when(kind == 1, ids.capture_id(F.sha2("n_name", 256)))
            .when(kind == 2, case)
            .otherwise(F.concat(F.lit("finding_"), F.col("c_custkey").cast("string")))
            .alias("target_id"),
            F.concat(F.lit("note on "), F.col("c_custkey").cast("string")).alias("body"),
            F.col("c_custkey").alias("created_order"),
        )

    @cached_property
    def bookmarks(self) -> DataFrame:
        s = self.table("supplier")
        nation = self.table("nation").select("n_nationkey", "n_regionkey", "n_name")
        df = s.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        known = F.col("s_suppkey") % 3 != 0
        return df.select(
            prefixed_sha("bookmark_", F.col("s_suppkey").cast("string"), 16).alias("bookmark_id"),
            F.concat(F.lit("case_"), F.col("n_regionkey").cast("string")).alias("case_id"),
            F.lit("capture").alias("target_type"),
            F.when(known, ids.capture_id(F.sha2("n_name", 256))).otherwise(
                ids.capture_id(F.sha2(F.col("s_name"), 256))
            ).alias("target_id"),
            F.col("s_name").alias("label"),
        )

    @cached_property
    def case_timeline(self) -> DataFrame:
        """One case timeline entry per event row, naming a capture."""
        nation = self.captures.select("cap", "capture_id")
        e = self.table("events").withColumn("cap", F.col("event_id") % 25)
        return e.join(nation, "cap").select(
            prefixed_sha("timeline_", F.col("event_id").cast("string"), 16).alias("entry_id"),
            F.concat(F.lit("case_"), (F.col("user_id") % 5).cast("string")).alias("case_id"),
            F.col("event_id").alias("insert_order"),
            "event_type",
            F.col("ts").cast("timestamp").alias("created_at"),
            F.col("capture_id").alias("detail_capture_id"),
        )
