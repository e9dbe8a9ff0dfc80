"""Spatial roll-ups: heat-map grid, kernel density, ring spread, cash by city."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muletrace.functions.exprs import grid_snap, haversine_km, paise_to_rupees
from muletrace.schemas import CASH
from muletrace.session import cut_lineage

HEAT_MODES = ("ALL_HITS", "FRAUD_ONLY", "ATM_CASHOUTS", "RISK_WEIGHTED")
KM_PER_DEGREE = 111.0
# The map's outer bounds.
LAT_BOUNDS, LNG_BOUNDS = (8.0, 36.0), (68.0, 96.0)


def layer(hits: DataFrame, mode: str) -> DataFrame:
    if mode not in HEAT_MODES:
        raise ValueError(f"mode must be one of {HEAT_MODES}")
    if mode == "FRAUD_ONLY":
        return hits.where("is_fraud")
    if mode == "ATM_CASHOUTS":
        return hits.where(F.col("hit_type") == "atm_cashout")
    return hits


def heatmap(hits: DataFrame, mode: str = "ALL_HITS", resolution: float = 0.02, min_hits: int = 1) -> DataFrame:
    """One row per occupied grid cell. Dominant type and city: most frequent, ties by name.

    A cell's rows are first counted by (type, city), so a cell holding a third of all hits reduces map-side.
    """
    r = layer(hits, mode)
    fraud = F.col("is_fraud")
    # risk in millionths: integer sums do not depend on the order rows arrive in
    micro = F.round(F.col("risk_score") * 1_000_000).cast("bigint")
    small = r.groupBy(
        grid_snap(F.col("lat"), resolution).alias("cell_lat"),
        grid_snap(F.col("lng"), resolution).alias("cell_lng"),
        "hit_type",
        "city",
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(fraud).alias("fn"),
        F.sum("amount_paise").alias("paise"),
        F.sum(micro).alias("risk"),
        F.sum(F.when(fraud, micro * 3).otherwise(micro * 2)).alias("wrisk"),
    )
    cell = ["cell_lat", "cell_lng"]

    def top(name: str) -> DataFrame:
        c = small.groupBy(*cell, name).agg(F.sum("n").alias("cn"))
        best = F.min(F.struct((-F.col("cn")).alias("o"), F.col(name).alias("v")))
        return c.groupBy(*cell).agg(best.alias("b")).select(*cell, F.col("b.v").alias(f"dominant_{name}"))

    cells = small.groupBy(*cell).agg(
        F.sum("n").alias("hit_count"),
        F.sum("fn").alias("fraud_hit_count"),
        F.sum("paise").alias("amount_paise"),
        F.sum("risk").alias("risk"),
        F.sum("wrisk").alias("wrisk"),
    )
    if mode == "RISK_WEIGHTED":
        density = F.col("wrisk") / F.lit(2_000_000.0)
    elif mode == "FRAUD_ONLY":
        density = F.col("fraud_hit_count") * 2.0 + F.col("amount_paise") / F.lit(100.0) / F.lit(50000.0)
    else:
        density = F.col("hit_count") + F.col("fraud_hit_count") * 1.5
    cells = cells.where(F.col("hit_count") >= min_hits).withColumn("density", density)
    peak = cells.agg(F.max("density")).scalar()
    avg_milli = F.expr("(2 * risk + 1000 * hit_count) div (2000 * hit_count)")
    norm = F.log1p("density") / F.log1p(peak)
    return (
        cells.join(top("hit_type"), cell)
        .join(top("city"), cell)
        .select(
            *cell,
            F.when(peak > 0, F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), norm)), 4)).otherwise(F.lit(0.5)).alias("intensity"),
            "hit_count",
            "fraud_hit_count",
            "amount_paise",
            (avg_milli / F.lit(1000.0)).alias("avg_risk_score"),
            F.col("dominant_hit_type"),
            F.col("dominant_city").alias("city"),
            ((F.col("fraud_hit_count") >= 3) | (F.col("risk") >= F.col("hit_count") * 700_000) | (F.col("hit_count") >= 15)).alias("is_hotspot"),
        )
    )


def kde_surface(
    hits: DataFrame,
    bandwidth_km: float = 8.0,
    n_lat: int = 50,
    n_lng: int = 50,
    bounds: tuple[float, float, float, float] | None = None,
    reach: float = 9.0,
) -> DataFrame:
    """Gaussian density on an ``n_lat`` x ``n_lng`` grid, normalised by its maximum, four decimals.

    Hits at the same place are added up first; each place then reaches only the grid points within ``reach``
    bandwidths, where a unit weight is still above exp(-reach**2 / 2), about 3e-18 of its peak: what lies beyond
    cannot change any sum in double precision.
    """
    if bounds is None:
        b = hits.agg(
            F.struct(
                F.greatest(F.lit(LAT_BOUNDS[0]), F.min("lat") - 0.5).alias("lat0"),
                F.least(F.lit(LAT_BOUNDS[1]), F.max("lat") + 0.5).alias("lat1"),
                F.greatest(F.lit(LNG_BOUNDS[0]), F.min("lng") - 0.5).alias("lng0"),
                F.least(F.lit(LNG_BOUNDS[1]), F.max("lng") + 0.5).alias("lng1"),
            )
        ).scalar()
    else:
        b = F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(bounds, ("lat0", "lat1", "lng0", "lng1"), strict=True)])
    places = hits.groupBy("lat", "lng").agg(
        F.sum(F.when(F.col("is_fraud"), F.col("risk_score") * 2.0).otherwise(F.col("risk_score"))).alias("w")
    )
    lat0, lat1, lng0, lng1 = (b[n] for n in ("lat0", "lat1", "lng0", "lng1"))
    step_lat, step_lng = (lat1 - lat0) / F.lit(float(n_lat - 1)), (lng1 - lng0) / F.lit(float(n_lng - 1))
    lng_km = F.lit(KM_PER_DEGREE) * F.cos(F.radians((lat0 + lat1) / F.lit(2.0)))
    r_lat = F.lit(reach * bandwidth_km / KM_PER_DEGREE)
    r_lng = F.lit(reach * bandwidth_km) / lng_km

    def window(x: Column, lo: Column, step: Column, r: Column, n: int) -> Column:
        first = F.greatest(F.lit(0), F.ceil((x - r - lo) / step).cast("int"))
        last = F.least(F.lit(n - 1), F.floor((x + r - lo) / step).cast("int"))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    near = (
        places.withColumn("i", F.explode(window(F.col("lat"), lat0, step_lat, r_lat, n_lat)))
        .withColumn("j", F.explode(window(F.col("lng"), lng0, step_lng, r_lng, n_lng)))
        .withColumn("dn", (lat0 + F.col("i") * step_lat - F.col("lat")) * F.lit(KM_PER_DEGREE))
        .withColumn("de", (lng0 + F.col("j") * step_lng - F.col("lng")) * lng_km)
    )
    kernel = F.exp(F.lit(-0.5) * (F.col("dn") * F.col("dn") + F.col("de") * F.col("de")) / F.lit(bandwidth_km**2))
    mass = near.groupBy("i", "j").agg(F.sum(kernel * F.col("w")).alias("mass"))
    peak = mass.agg(F.max("mass")).scalar()
    spark = hits.sparkSession
    grid = spark.range(n_lat * n_lng).select(
        F.floor(F.col("id") / F.lit(n_lng)).cast("int").alias("i"), (F.col("id") % n_lng).cast("int").alias("j")
    )
    value = F.coalesce(F.col("mass"), F.lit(0.0))
    return grid.join(mass, ["i", "j"], "left").select(
        "i",
        "j",
        F.round(lat0 + F.col("i") * step_lat, 6).alias("grid_lat"),
        F.round(lng0 + F.col("j") * step_lng, 6).alias("grid_lng"),
        F.round(F.when(peak > 0, value / peak).otherwise(value), 4).alias("density"),
    )


def heat_points(hits: DataFrame, weight_by_risk: bool = True) -> DataFrame:
    """Point layer of a heat map: position to five decimals and an intensity."""
    fraud = F.col("is_fraud")
    if weight_by_risk:
        factor = F.when(fraud, F.lit(1.4)).otherwise(F.lit(0.6))
        intensity = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.2), F.col("risk_score") * factor)), 3)
    else:
        intensity = F.when(fraud, F.lit(1.0)).otherwise(F.lit(0.6))
    return hits.select("hit_id", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"), intensity.alias("intensity"))


def geojson_features(hits: DataFrame, max_points: int | None = None) -> DataFrame:
    """One GeoJSON feature text per hit; with ``max_points``, of the first ones in hit order only."""
    props = F.struct(
        "hit_id", "city", "hit_type", "amount_paise", "is_fraud", "risk_score", F.col("account").alias("account_id")
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"),
        props.alias("properties"),
    )
    shown = hits if max_points is None else hits.orderBy("hit_id").limit(max_points)
    return shown.select("hit_id", F.to_json(feature).alias("feature"))


def feature_collections(features: DataFrame, per_document: int = 5000) -> DataFrame:
    """(part, document): all features in FeatureCollection texts of about ``per_document`` features each."""
    parts = F.greatest(F.lit(1), F.ceil(features.agg(F.count(F.lit(1))).scalar() / F.lit(per_document)))
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("hit_id", "feature"))), lambda x: x["feature"])
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(sorted_, ","), F.lit("]}"))
    return features.withColumn("part", F.pmod(F.xxhash64("hit_id"), parts)).groupBy("part").agg(text.alias("document"))


# ---- spread of a ring -------------------------------------------------------------------------------------------


def _unit(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lng)
    return np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=1)


# Sizes that choose a way but not an answer: points that stay unthinned in a batch, points compared pair by pair, points of a hull.
FEW_IN_BATCH, FEW_POINTS, POINTS_PER_HULL = 64, 64, 4096


def _outer_points(pdf: pd.DataFrame) -> pd.DataFrame:
    """Points that can be an end of the largest distance: corners of the convex hull on the sphere.

    Valid while all points lie within 45 degrees of their centre; otherwise every distinct point is kept.
    """
    pts = pdf[["lat", "lng"]].drop_duplicates().sort_values(["lng", "lat"])
    if len(pts) <= 8:
        return pts
    xyz = _unit(pts["lat"].to_numpy(), pts["lng"].to_numpy())
    centre = xyz.mean(axis=0)
    norm = np.linalg.norm(centre)
    if norm < 1e-6:
        return pts
    centre /= norm
    depth = xyz @ centre
    if depth.min() < math.cos(math.pi / 4):
        return pts
    # central projection keeps great circles straight, so the plane hull is the sphere hull
    east = np.cross([0.0, 0.0, 1.0], centre)
    if np.linalg.norm(east) < 1e-9:
        east = np.array([1.0, 0.0, 0.0])
    east /= np.linalg.norm(east)
    north = np.cross(centre, east)
    x, y = (xyz @ east) / depth, (xyz @ north) / depth
    order = np.lexsort((y, x))

    def chain(idx) -> list[int]:
        out: list[int] = []
        for k in idx:
            while len(out) >= 2:
                a, b = out[-2], out[-1]
                if (x[b] - x[a]) * (y[k] - y[a]) - (y[b] - y[a]) * (x[k] - x[a]) >= -1e-15:
                    break
                out.pop()
            out.append(k)
        return out

    keep = sorted(set(chain(order)) | set(chain(order[::-1])))
    return pts.iloc[keep]


def _hull_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        many = pdf.groupby("ring_id", sort=False, dropna=False)["lat"].transform("size") > FEW_IN_BATCH
        yield pdf[~many]
        for ring, g in pdf[many].groupby("ring_id", sort=False):
            out = _outer_points(g)
            yield pd.DataFrame({"ring_id": ring, "lat": out["lat"].to_numpy(), "lng": out["lng"].to_numpy()})


def _hull_group(pdf: pd.DataFrame) -> pd.DataFrame:
    out = _outer_points(pdf)
    return pd.DataFrame({"ring_id": pdf["ring_id"].iloc[0], "lat": out["lat"].to_numpy(), "lng": out["lng"].to_numpy()})


def point_spread(points: DataFrame, salts: int = 64) -> DataFrame:
    """Largest distance between two points of a ring, in km to two decimals.

    ``points(ring_id, lat, lng)``. Points of large rings are thinned to hull corners per batch inside each task, then per
    (ring, salt) if they are very many, into ``salts`` parts at least, then per ring; only the few corners left are compared
    with each other, and all points of a ring that has few.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "ring_id string, lat double, lng double"
    thin = points.where(F.col("lat").isNotNull()).select("ring_id", "lat", "lng").mapInPandas(_hull_batches, schema)
    thin = cut_lineage(thin.distinct())
    sizes = thin.groupBy("ring_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW_POINTS)
    parts = F.when(F.col("n") <= POINTS_PER_HULL, 1).otherwise(F.greatest(F.lit(salts), F.ceil(F.col("n") / F.lit(POINTS_PER_HULL))))
    salt = F.pmod(F.xxhash64("lat", "lng"), parts)
    large = thin.join(sizes, "ring_id").withColumn("salt", salt).drop("n")
    # as many tasks as the session names: rows are few and small, but each group costs
    large = large.repartition(tasks, "ring_id", "salt").groupBy("ring_id", "salt").applyInPandas(_hull_group, schema)
    large = large.repartition(tasks, "ring_id").groupBy("ring_id").applyInPandas(_hull_group, schema)
    few = thin.join(sizes.select("ring_id"), "ring_id", "left_anti")
    corners = cut_lineage(few.unionByName(large))
    a = corners.select("ring_id", F.col("lat").alias("lat1"), F.col("lng").alias("lng1"))
    b = corners.select("ring_id", F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    km = haversine_km(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    return a.join(b, "ring_id").groupBy("ring_id").agg(F.round(F.max(km), 2).alias("spread_km"))


def home_points(accounts: DataFrame, members: DataFrame) -> DataFrame:
    return members.join(accounts, "account").select("ring_id", F.col("home_lat").alias("lat"), F.col("home_lng").alias("lng"))


def cashout_points(ledger: DataFrame, members: DataFrame) -> DataFrame:
    """Located withdrawals of ring members."""
    w = ledger.where((F.col("dst") == CASH) & F.col("city").isNotNull())
    return w.select("txn_id", F.col("src").alias("account"), "city", "lat", "lng", "amount_paise", "ts", "us").join(members, "account")


def ring_geo(accounts: DataFrame, ledger: DataFrame, members: DataFrame) -> DataFrame:
    """Homes and withdrawals of each ring as one point table."""
    homes = members.join(accounts, "account").select(
        "ring_id",
        F.lit("home").alias("kind"),
        "account",
        F.lit("").alias("txn_id"),
        F.col("home_city").alias("city"),
        F.col("home_lat").alias("lat"),
        F.col("home_lng").alias("lng"),
        F.lit(0).cast("bigint").alias("amount_rupees"),
    )
    cash = cashout_points(ledger, members).select(
        "ring_id",
        F.lit("cashout").alias("kind"),
        "account",
        "txn_id",
        "city",
        "lat",
        "lng",
        paise_to_rupees(F.col("amount_paise"), "half_up").alias("amount_rupees"),
    )
    return homes.unionByName(cash)


def cashout_cities(ledger: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct withdrawal cities per ring, by two-level counting."""
    per_city = cashout_points(ledger, members).groupBy("ring_id", "city").agg(F.count(F.lit(1)).alias("n"))
    return per_city.groupBy("ring_id").agg(F.count(F.lit(1)).alias("cities"))


def city_rollup(ledger: DataFrame, members: DataFrame) -> DataFrame:
    """Withdrawals per city, split into ordinary and ring money."""
    w = ledger.where((F.col("channel") == "ATM") & F.col("city").isNotNull()).select(F.col("src").alias("account"), "city", "amount_paise")
    flagged = members.select("account").distinct().withColumn("in_ring", F.lit(True))
    ring = F.coalesce("in_ring", F.lit(False))
    amount = F.col("amount_paise")
    return (
        w.join(flagged, "account", "left")
        .groupBy("city")
        .agg(
            F.count_if(~ring).alias("withdrawals"),
            F.coalesce(F.sum(F.when(~ring, amount)), F.lit(0)).cast("bigint").alias("amount_paise"),
            F.count_if(ring).alias("ring_withdrawals"),
            F.coalesce(F.sum(F.when(ring, amount)), F.lit(0)).cast("bigint").alias("ring_amount_paise"),
        )
    )


def ring_city_cash(ledger: DataFrame, members: DataFrame) -> DataFrame:
    """Cash per (ring, city): amount, times, accounts."""
    per_account = (
        cashout_points(ledger, members)
        .groupBy("ring_id", "city", "account")
        .agg(F.sum("amount_paise").alias("amount_paise"), F.count(F.lit(1)).alias("times"))
    )
    return per_account.groupBy("ring_id", "city").agg(
        F.sum("amount_paise").alias("amount_paise"), F.sum("times").alias("times"), F.count(F.lit(1)).alias("accounts")
    )


def cash_routes(accounts: DataFrame, ledger: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct account -> withdrawal city routes that leave the home point."""
    homes = accounts.select("account", "home_city", "home_lat", "home_lng")
    return (
        cashout_points(ledger, members)
        .join(homes, "account")
        .where((F.col("home_lat") != F.col("lat")) | (F.col("home_lng") != F.col("lng")))
        .select("ring_id", "account", "home_city", "city")
        .distinct()
    )
