"""Deterministic rule scores in 1/10000, bands and explanations.

The rule score stands where a trained model's probability would; ``operators.models`` supplies the trained ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muletrace.functions.exprs import risk_band, signal_label

# Points in 1/10000 per condition; the first condition of a group that holds counts.
V1_RULES = {
    "pass_through": [(">=", 0.8, 2500), (">=", 0.5, 1200)],
    "median_hold_min": [("<", 30.0, 2000), ("<", 1440.0, 1000)],
    "burst_10min": [(">=", 3, 2000), (">=", 2, 1000)],
    "atm_share": [(">=", 0.5, 1500), (">=", 0.2, 800)],
    "account_age_days": [("<=", 7.0, 1000), ("<=", 30.0, 500)],
    "velocity_per_hr": [(">=", 1.0, 500)],
}
V2_RULES = {
    "shared_device_n": [(">=", 2, 500)],
    "shared_phone_n": [(">=", 3, 500)],
    "shared_any_new_n": [(">=", 5, 500)],
    "neighbour_risk_v1": [(">=", 0.5, 500)],
    "home_cashout_km": [(">=", 100.0, 500)],
}


def _points(feature: str, steps: list[tuple[str, float, int]]) -> Column:
    test = {">=": lambda c, x: c >= x, "<": lambda c, x: c < x, "<=": lambda c, x: c <= x}
    out = None
    for op, bound, pts in steps:
        cond = test[op](F.col(feature), F.lit(bound))
        out = F.when(cond, pts) if out is None else out.when(cond, pts)
    return out.otherwise(0)


def _degree_points() -> Column:
    return F.when((F.col("in_degree") >= 3) & (F.col("out_degree") >= 3), 1000).otherwise(0)


def rule_score_v1(features: DataFrame) -> DataFrame:
    total = _degree_points()
    for f, steps in V1_RULES.items():
        total = total + _points(f, steps)
    return features.withColumn("v1_bp", F.least(F.lit(10000), total).cast("bigint"))


def rule_score_v2(matrix: DataFrame) -> DataFrame:
    total = F.floor(F.col("v1_bp") * 7 / F.lit(10))
    for f, steps in V2_RULES.items():
        total = total + _points(f, steps)
    return matrix.withColumn("v2_bp", F.least(F.lit(10000), total).cast("bigint"))


def with_risk(scored: DataFrame) -> DataFrame:
    """Probabilities 0-1 and the band of the second score."""
    r1, r2 = F.col("v1_bp") / F.lit(10000.0), F.col("v2_bp") / F.lit(10000.0)
    return scored.withColumns({"risk_v1": r1, "risk_v2": r2, "band": risk_band(r2)})


def blend(p1: Column, p2: Column, anomaly: Column) -> Column:
    """Combined risk: 60 % second model, 30 % first, 10 % anomaly, clipped to [0, 1], four decimals."""
    mix = F.lit(0.60) * p2 + F.lit(0.30) * p1 + F.lit(0.10) * anomaly
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mix)), 4)


def normalised_anomaly(df: DataFrame, raw: str, bounds: tuple[float, float] | None = None) -> DataFrame:
    """1 - (x - min) / (max - min), from the table itself or from bounds fixed at training."""
    if bounds is None:
        lo, hi = df.agg(F.min(raw)).scalar(), df.agg(F.max(raw)).scalar()
    else:
        lo, hi = F.lit(float(bounds[0])), F.lit(float(bounds[1]))
    x = F.lit(1.0) - (F.col(raw) - lo) / F.greatest(hi - lo, F.lit(1e-9))
    return df.withColumn("anomaly", F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def contributions() -> Column:
    """Per feature the points it gave, as an array of (feature, label, weight)."""
    items = []
    for f, steps in {**V1_RULES, **V2_RULES}.items():
        items.append((f, _points(f, steps)))
    items.append(("in_degree", _degree_points()))
    return F.array(
        *[
            F.struct(
                (p / F.lit(10000.0)).alias("weight"), F.lit(f).alias("feature"), signal_label(f, F.col(f)).alias("label")
            )
            for f, p in items
        ]
    )


def top_signals(contribs: Column, n: int = 3) -> Column:
    """The n largest positive contributions; equal weights in feature-name order."""
    positive = F.filter(contribs, lambda s: s["weight"] > 0)
    ordered = F.array_sort(
        positive,
        lambda a, b: F.when(a["weight"] > b["weight"], -1)
        .when(a["weight"] < b["weight"], 1)
        .when(a["feature"] < b["feature"], -1)
        .when(a["feature"] > b["feature"], 1)
        .otherwise(0),
    )
    return F.slice(ordered, 1, n)


def why_flagged(scored: DataFrame, floor: float = 0.5) -> DataFrame:
    """Up to three reasons for every account at or above ``floor``, one row each, best first."""
    flagged = scored.where(F.col("v2_bp") >= int(floor * 10000))
    return flagged.select("account", F.posexplode(top_signals(contributions())).alias("pos", "s")).select(
        "account",
        (F.col("pos") + 1).cast("bigint").alias("rank"),
        F.col("s.feature").alias("feature"),
        F.col("s.label").alias("label"),
        F.col("s.weight").alias("weight"),
    )
