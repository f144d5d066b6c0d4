"""Session features, baselines, deviations and an isolation forest per (capture, protocol)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.functions import fixed_values as V
from postern.functions import labels
from postern.functions.columns import memo, seconds_between, validity_days
from postern.session import python_partitions

GROUP = ["capture_id", "protocol_group"]
CATEGORICAL = tuple(V.CATEGORICAL_VOCABULARIES)
NUMERIC = tuple(n for n in V.FEATURE_NAMES if n not in CATEGORICAL)


def _feature_columns() -> list[Column]:
    hs = lambda n: F.col(f"handshake.{n}")
    tls = F.col("handshake").isNotNull()
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    size = lambda c: F.when(tls, F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))).otherwise(0)
    alpn = F.filter(hs("extensions"), lambda e: (e["name"] == V.ALPN_EXTENSION) & (e["value"] != ""))
    names = F.size(F.split(F.get(alpn, F.lit(0))["value"], ", "))
    chain = F.coalesce(F.size("certificates"), F.lit(0)) > 0
    judged = chain & F.col("started_at").isNotNull()
    bits = F.array_max(F.transform("certificates", lambda c: F.coalesce(c["public_key_size_bits"], F.lit(0))))
    days = F.array_min(F.transform("certificates", lambda c: validity_days(F.col("started_at"), c["not_after"])))
    index = labels.vocabulary_index
    values = {
        "protocol": index("protocol", "protocol"),
        "server_port": F.col("server_port"),
        "duration_seconds": F.coalesce(seconds_between("started_at", "ended_at"), F.lit(0.0)),
        "packet_count": F.col("packet_count"),
        "bytes_client_to_server": F.col("bytes_client_to_server"),
        "bytes_server_to_client": F.col("bytes_server_to_client"),
        "tcp_complete": flag(F.col("complete")),
        "has_tls": tls.cast("int"),
        "tls_version": index("tls_version", F.coalesce(hs("tls_version"), F.lit("unknown"))),
        "cipher_class": index("cipher_class", labels.cipher_class(hs("cipher_suite_code"))),
        "offered_cipher_count": size(hs("cipher_suites_offered")),
        "key_exchange": index("key_exchange", F.coalesce(hs("key_exchange"), F.lit("unknown"))),
        "extension_count": size(hs("extensions")),
        "has_sni": flag(hs("sni_server_name") != ""),
        "alpn_count": F.when(F.size(alpn) > 0, names).otherwise(0),
        "certificate_count": F.greatest(F.coalesce(F.size("certificates"), F.lit(0)), F.lit(0)),
        "certificate_max_key_bits": F.when(judged, bits).otherwise(0),
        "certificate_min_validity_days": F.when(judged, days).otherwise(0.0),
        "has_implicit_tls": flag(F.col("implicit_tls")),
    }
    return [labels.safe_number(values[n]).alias(n if n != "protocol" else "protocol_index") for n in V.FEATURE_NAMES]


def session_features(sessions: DataFrame) -> DataFrame:
    """The 19-column feature vector; NULL, NaN and infinity become 0, absurd values are clamped."""
    return sessions.select(
        "capture_id", "session_id", F.coalesce("protocol", F.lit("unknown")).alias("protocol_group"), *memo("features", _feature_columns)
    )


def _column(feature: str) -> str:
    return "protocol_index" if feature == "protocol" else feature


def group_sizes(features: DataFrame, min_baseline: int = V.MIN_BASELINE_SESSIONS) -> DataFrame:
    """Sessions per group and whether they suffice as a baseline (never fewer than 2)."""
    floor = max(2, min_baseline)
    return features.groupBy(*GROUP).agg(F.count("*").alias("sessions")).withColumn("sufficient", F.col("sessions") >= floor)


def unpivoted(features: DataFrame, names: tuple[str, ...]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(_column(n)).alias("value"), F.lit(i).alias("position")) for i, n in enumerate(V.FEATURE_NAMES) if n in names])
    return features.select(*GROUP, "session_id", F.explode(pairs).alias("f")).select(*GROUP, "session_id", "f.*")


def _numeric_stats(features: DataFrame) -> DataFrame:
    """Mean, population deviation, minimum and maximum of all numeric features: one aggregate, then unpivoted."""
    aggregates = []
    for n in NUMERIC:
        aggregates += [F.avg(n).alias(f"{n}__mean"), F.stddev_pop(n).alias(f"{n}__std"), F.min(n).alias(f"{n}__min"), F.max(n).alias(f"{n}__max")]
    wide = features.groupBy(*GROUP).agg(*aggregates)
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), *[F.col(f"{n}__{s}").alias(s) for s in ("mean", "std", "min", "max")]) for n in NUMERIC])
    return wide.select(*GROUP, F.explode(rows).alias("s")).select(*GROUP, "s.*")


def baseline_stats(features: DataFrame) -> DataFrame:
    return _numeric_stats(features)


def baseline_categorical(features: DataFrame) -> DataFrame:
    """Label histogram per categorical feature: four small group-bys over one narrow scan."""
    rows = unpivoted(features, CATEGORICAL).groupBy(*GROUP, "feature", "value").agg(F.count("*").alias("n"))
    label = None
    for n in CATEGORICAL:
        hit = F.col("feature") == n
        label = F.when(hit, labels.vocabulary_label(n, "value")) if label is None else label.when(hit, labels.vocabulary_label(n, "value"))
    return rows.select(*GROUP, "feature", label.alias("label"), "n").groupBy(*GROUP, "feature", "label").agg(F.sum("n").alias("n"))


def feature_deviation(features: DataFrame, min_baseline: int = V.MIN_BASELINE_SESSIONS) -> DataFrame:
    """Deviation of every session's feature from its group; groups too small for a baseline give none.

    Numeric: |x - mean| / std, left out when the feature is constant; categorical:
    1 - relative frequency of the observed label. The statistics are a few rows
    per group and are joined to the sessions, whatever the size of a group.
    """
    enough = group_sizes(features, min_baseline).where("sufficient").select(*GROUP)
    features = features.join(enough, GROUP, "left_semi")
    numeric = unpivoted(features, NUMERIC).join(_numeric_stats(features), [*GROUP, "feature"])
    constant = F.col("std") <= 1e-9
    distance = F.abs(F.col("value") - F.col("mean"))
    score = F.when(constant, F.lit(0.0)).otherwise(F.round(distance / F.col("std"), 2))
    kept = numeric.where(~(constant & (distance <= 1e-9))).select(
        "capture_id", "protocol_group", "session_id", "feature", "position", F.round("value", 2).cast("string").alias("observed"), score.alias("score"),
        labels.deviation_label(F.least(F.lit(3.0), score)).alias("deviation"),
    )
    totals = features.groupBy(*GROUP).agg(F.count("*").alias("total"))
    histogram = baseline_categorical(features).join(totals, GROUP)
    label = None
    for n in CATEGORICAL:
        hit = F.col("feature") == n
        label = F.when(hit, labels.vocabulary_label(n, "value")) if label is None else label.when(hit, labels.vocabulary_label(n, "value"))
    named = unpivoted(features, CATEGORICAL).withColumn("label", label).join(histogram, [*GROUP, "feature", "label"])
    rarity = F.round(1 - F.col("n") / F.col("total"), 2)
    categorical = named.select(
        "capture_id", "protocol_group", "session_id", "feature", "position", F.col("label").alias("observed"), rarity.alias("score"), labels.deviation_label(rarity).alias("deviation")
    )
    return kept.unionByName(categorical)


def top_deviations(deviations: DataFrame, limit: int = 4) -> DataFrame:
    order = W.partitionBy("session_id").orderBy(F.col("score").desc(), "position")
    return deviations.withColumn("rank", F.row_number().over(order).cast("bigint")).where((F.col("rank") <= limit) & (F.col("score") > 0))


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    kinds = ("normal", "unusual", "anomalous", "highly_anomalous", "insufficient_evidence", "model_error")
    return anomalies.groupBy("capture_id").agg(
        *[F.count_if(F.col("status") == k).alias(k) for k in kinds], F.count("score").alias("total_evaluated"), F.count("*").alias("total_sessions")
    )


# -- isolation forest -----------------------------------------------------------------


def _average_path(n):
    """Expected path length of an unsuccessful search in a tree of n points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, size) of one random tree; leaves have feature -1."""
    nodes: list[tuple] = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, len(rows)))
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(usable):
            feature = int(rng.choice(usable))
            cut = float(rng.uniform(low[feature], high[feature]))
            left = rows[:, feature] <= cut
            if left.any() and not left.all():
                nodes[at] = (feature, cut, build(rows[left], depth + 1), build(rows[~left], depth + 1), len(rows))
        return at

    build(points, 0)
    return nodes


TREE_BLOCK = 20
# A block of trees of a group in one row: node columns over its trees, and where each tree starts.
FOREST = (
    "capture_id string, protocol_group string, block int, psi int, starts array<int>, feature array<int>, cut array<double>, "
    "lower array<int>, upper array<int>, size array<int>"
)


def forest_sample(features: DataFrame, size: int = V.FOREST_SAMPLE * TREE_BLOCK) -> DataFrame:
    """As many sessions per (group, tree block) as its trees draw, of all sessions of the group, by a hash of each block's own.

    Partitioning does not matter. Pre-shuffle the top-k limit keeps ``size`` rows
    per group, block and partition, so a group holding a third of all sessions is
    never gathered.
    """
    blocks = F.explode(F.array(*[F.lit(b) for b in range(0, V.FOREST_TREES, TREE_BLOCK)]))
    order = W.partitionBy(*GROUP, "block").orderBy(F.xxhash64("session_id", F.lit(V.FOREST_SEED), "block"), "session_id")
    return features.withColumn("block", blocks).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size).drop("_n")


def train_forests(features: DataFrame, min_baseline: int = V.MIN_BASELINE_SESSIONS) -> DataFrame:
    """One forest per group with enough sessions, grown in blocks of trees; every tree's sample is drawn from all sessions of the group."""
    sample = (
        forest_sample(features).join(group_sizes(features, min_baseline).where("sufficient").select(*GROUP), GROUP)
        .repartition(python_partitions(features.sparkSession), *GROUP, "block")
    )
    names = [_column(n) for n in V.FEATURE_NAMES]

    def fit(key, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("session_id")
        points = table[names].to_numpy(dtype=float)
        psi = min(V.FOREST_SAMPLE, len(points))
        limit = max(1, math.ceil(math.log2(psi)))
        starts, nodes = [], []
        dealt = np.random.default_rng([V.FOREST_SEED, key[2]]).permutation(len(points)) if len(points) == psi * TREE_BLOCK else None
        for tree in range(key[2], key[2] + TREE_BLOCK):
            rng = np.random.default_rng([V.FOREST_SEED, tree])
            starts.append(len(nodes))
            at = (tree - key[2]) * psi
            # a full sample is dealt to the trees, a smaller group is whole before each of them
            own = rng.permutation(len(points))[:psi] if dealt is None else dealt[at : at + psi]
            nodes += _grow(points[own], rng, limit)
        feature, cut, lower, upper, size = (list(column) for column in zip(*nodes))
        row = dict(capture_id=key[0], protocol_group=key[1], block=key[2], psi=psi, starts=starts, feature=feature, cut=cut, lower=lower, upper=upper, size=size)
        return pd.DataFrame([row], dtype=object)

    return sample.groupBy(*GROUP, "block").applyInPandas(fit, FOREST)


def _depths(points: np.ndarray, model, start: int) -> np.ndarray:
    """Path length of every point in the tree at ``start``, all points stepping down together."""
    feature, cut, lower, upper, size = model
    at = np.full(len(points), start)
    depth = np.zeros(len(points))
    rows = np.flatnonzero(feature[at] >= 0)
    while len(rows):
        node = at[rows]
        at[rows] = start + np.where(points[rows, feature[node]] <= cut[node], lower[node], upper[node])
        depth[rows] += 1
        rows = rows[feature[at[rows]] >= 0]
    return depth + _average_path(size[at])


def score_sessions(features: DataFrame, forests: DataFrame, salts: int = 8) -> DataFrame:
    """score_samples = -2^(-E[path] / c(psi)) for every session.

    Sessions of a group are spread over ``salts`` parts, each meeting its own
    copy of the forest (a bounded number of rows).
    """
    names = [_column(n) for n in V.FEATURE_NAMES]
    left = features.withColumn("salt", F.pmod(F.xxhash64("session_id"), F.lit(salts)))
    right = forests.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(salts)])))

    def score(sessions: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        if sessions.empty or forest.empty:
            return pd.DataFrame({"capture_id": [], "session_id": [], "protocol_group": [], "sample": []}, dtype=object)
        points = sessions[names].to_numpy(dtype=float)
        total, trees = np.zeros(len(points)), 0
        for row in forest.to_dict("records"):
            model = [np.asarray(row[c]) for c in ("feature", "cut", "lower", "upper", "size")]
            total += sum(_depths(points, model, start) for start in row["starts"])
            trees += len(row["starts"])
        mean = total / trees
        out = sessions[["capture_id", "session_id", "protocol_group"]].astype(object)
        out["sample"] = -np.power(2.0, -mean / float(_average_path(forest["psi"].iloc[0])))
        return out

    keys = [*GROUP, "salt"]
    parts = python_partitions(features.sparkSession)
    left, right = left.repartition(parts, *keys), right.repartition(parts, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, "capture_id string, session_id string, protocol_group string, sample double")


def isolation_forest(features: DataFrame, forests: DataFrame, min_baseline: int = V.MIN_BASELINE_SESSIONS) -> DataFrame:
    """Scores and bands: decision = sample - 5th percentile of the group; small groups lack evidence."""
    samples = score_sessions(features, forests)
    offsets = samples.groupBy(*GROUP).agg(F.percentile_approx("sample", F.lit(V.FOREST_CONTAMINATION), F.lit(10_000)).alias("offset"))
    scored = samples.join(offsets, GROUP).withColumn("decision", F.col("sample") - F.col("offset"))
    value = labels.anomaly_score("decision")
    rows = features.select("capture_id", "session_id", "protocol_group").join(scored.select("session_id", "decision"), "session_id", "left")
    sized = rows.join(group_sizes(features, min_baseline), GROUP)
    score = F.when(F.col("sufficient"), value)
    return sized.select(
        "capture_id", "session_id", "protocol_group", score.alias("score"), labels.anomaly_band(score).alias("band"),
        F.when(~F.col("sufficient"), "insufficient_evidence").otherwise(F.coalesce(labels.anomaly_band(score), F.lit("model_error"))).alias("status"),
    )
