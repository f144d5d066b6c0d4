"""Queries over anomaly analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from postern.functions import labels
from postern.operators import anomaly as A
from postern.plans.base import query


@query("session_features")
def session_features(w):
    f = A.session_features(w.sessions)
    seconds = F.round(F.col("certificate_min_validity_days") * 86400).cast("bigint")
    return f.withColumn("certificate_min_validity_days", seconds).withColumnRenamed("certificate_min_validity_days", "certificate_min_validity_seconds")


@query("decode_feature")
def decode_feature(w):
    f = A.session_features(w.sessions)
    return f.select("session_id", *[labels.vocabulary_label(n, A._column(n)).alias(n) for n in A.CATEGORICAL], labels.vocabulary_label("protocol", F.col("packet_count")).alias("outside"))


@query("baseline_stats")
def baseline_stats(w):
    s = A.baseline_stats(A.session_features(w.sessions))
    return s.select("capture_id", "protocol_group", "feature", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")])


@query("baseline_categorical")
def baseline_categorical(w):
    return A.baseline_categorical(A.session_features(w.sessions))


@query("baseline_gate")
def baseline_gate(w):
    return A.group_sizes(A.session_features(w.sessions))


@query("min_baseline_param")
def min_baseline_param(w):
    return A.group_sizes(A.session_features(w.sessions), 150)


@query("feature_deviation")
def feature_deviation(w):
    return A.feature_deviation(A.session_features(w.sessions)).select("session_id", "feature", F.round("score", 1).alias("score"))


@query("top_deviations")
def top_deviations(w):
    d = A.top_deviations(A.feature_deviation(A.session_features(w.sessions)))
    return d.groupBy("session_id").agg(F.count("*").alias("deviations"), F.round(F.max("score"), 1).alias("highest"))


@query("isolation_forest_score")
def isolation_forest_score(w):
    f = A.session_features(w.sessions)
    return A.isolation_forest(f, A.train_forests(f))


@query("anomaly_score_map")
def anomaly_score_map(w):
    d = w.table("lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_extendedprice") - 50000) / 200000).alias("decision"))
    score = labels.anomaly_score("decision")
    return d.groupBy(score.cast("bigint").alias("score"), labels.anomaly_band(score).alias("band")).agg(F.count("*").alias("n"))


@query("anomaly_summary")
def anomaly_summary(w):
    return A.anomaly_summary(w.anomalies)
