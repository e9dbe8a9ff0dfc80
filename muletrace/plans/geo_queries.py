"""Queries on places."""

from __future__ import annotations

from pyspark.sql import functions as F

from muletrace.functions import exprs as X
from muletrace.operators import geo
from muletrace.plans import sqlviews
from muletrace.plans.registry import query
from muletrace.plans.tables import Tables

_HAV = "2*6371.0e0*asin(sqrt(greatest(0e0,least(1e0, pow(sin(radians({b}lat-{a}lat)/2),2)+cos(radians({a}lat))*cos(radians({b}lat))*pow(sin(radians({b}lng-{a}lng)/2),2)))))"

sqlviews.define(
    "cashouts",
    "SELECT ring_id, account, txn_id, city, lat, lng, amount_paise, ts, us FROM ledger JOIN planted ON account=src WHERE dst='CASH' AND city IS NOT NULL",
)


def _heat_sql(where: str, density: str) -> str:
    return f"""WITH h AS (SELECT *, round(floor(lat/2e-2)*2e-2+2e-2/2,4) cell_lat, round(floor(lng/2e-2)*2e-2+2e-2/2,4) cell_lng FROM hits WHERE {where}),
    ty AS (SELECT cell_lat, cell_lng, hit_type, row_number() OVER (PARTITION BY cell_lat, cell_lng ORDER BY count(*) DESC, hit_type) rn FROM h GROUP BY 1,2,3),
    ci AS (SELECT cell_lat, cell_lng, city, row_number() OVER (PARTITION BY cell_lat, cell_lng ORDER BY count(*) DESC, city) rn FROM h GROUP BY 1,2,3),
    c AS (SELECT cell_lat, cell_lng, count(*) hit_count, count(*) FILTER (is_fraud) fraud_hit_count, CAST(sum(amount_paise) AS BIGINT) amount_paise, CAST(sum(CAST(round(risk_score*1e6) AS BIGINT)) AS BIGINT) rs, {density} density FROM h GROUP BY 1,2)
    SELECT c.cell_lat, c.cell_lng, round(greatest(0.05e0,least(1e0,ln(1+density)/ln(1+max(density) OVER ()))),4) intensity, hit_count, fraud_hit_count, amount_paise,
      ((2*rs+1000*hit_count)//(2000*hit_count))/1000e0 avg_risk_score, ty.hit_type dominant_hit_type, ci.city, (fraud_hit_count>=3 OR rs>=700000*hit_count OR hit_count>=15) is_hotspot
    FROM c JOIN ty ON ty.cell_lat=c.cell_lat AND ty.cell_lng=c.cell_lng AND ty.rn=1 JOIN ci ON ci.cell_lat=c.cell_lat AND ci.cell_lng=c.cell_lng AND ci.rn=1"""


_COUNT_DENSITY = "count(*)+1.5e0*count(*) FILTER (is_fraud)"


@query("heatmap_grid", _heat_sql("true", _COUNT_DENSITY))
def heatmap_grid(spark, d):
    return geo.heatmap(Tables(spark, d).hits)


@query("heatmap_fraud", _heat_sql("is_fraud", "2e0*count(*) FILTER (is_fraud)+CAST(sum(amount_paise) AS BIGINT)/100e0/50000e0"))
def heatmap_fraud(spark, d):
    return geo.heatmap(Tables(spark, d).hits, "FRAUD_ONLY")


@query("heatmap_cashouts", _heat_sql("hit_type='atm_cashout'", _COUNT_DENSITY))
def heatmap_cashouts(spark, d):
    return geo.heatmap(Tables(spark, d).hits, "ATM_CASHOUTS")


@query("heatmap_risk_weighted", _heat_sql("true", "CAST(sum(CAST(round(risk_score*1e6) AS BIGINT)*CASE WHEN is_fraud THEN 3 ELSE 2 END) AS BIGINT)/2e6"))
def heatmap_risk_weighted(spark, d):
    return geo.heatmap(Tables(spark, d).hits, "RISK_WEIGHTED")


@query(
    "kde_surface",
    """WITH b AS (SELECT greatest(8e0,min(lat)-0.5e0) lat0, least(36e0,max(lat)+0.5e0) lat1, greatest(68e0,min(lng)-0.5e0) lng0, least(96e0,max(lng)+0.5e0) lng1 FROM hits),
     p AS (SELECT lat, lng, sum(risk_score*CASE WHEN is_fraud THEN 2e0 ELSE 1e0 END) w FROM hits GROUP BY 1,2),
     g AS (SELECT CAST(i.range AS INT) i, CAST(j.range AS INT) j, lat0+i.range*((lat1-lat0)/49e0) glat, lng0+j.range*((lng1-lng0)/49e0) glng, 111e0*cos(radians((lat0+lat1)/2e0)) lk FROM range(50) i, range(50) j, b),
     s AS (SELECT i, j, any_value(glat) glat, any_value(glng) glng, sum(w*exp(-0.5e0*(pow((glat-lat)*111e0,2)+pow((glng-lng)*lk,2))/64e0)) m FROM g, p GROUP BY 1,2)
     SELECT i, j, round(glat,6) grid_lat, round(glng,6) grid_lng, round(m/max(m) OVER (),4) density FROM s""",
)
def kde_surface(spark, d):
    return geo.kde_surface(Tables(spark, d).hits)


@query(
    "heat_points",
    "SELECT hit_id, round(lat,5) lat, round(lng,5) lng, round(least(1e0,greatest(0.2e0,risk_score*CASE WHEN is_fraud THEN 1.4e0 ELSE 0.6e0 END)),3) intensity FROM hits",
)
def heat_points(spark, d):
    return geo.heat_points(Tables(spark, d).hits)


@query(
    "geojson_layer",
    """SELECT hit_id, hit_type, is_fraud, lng FROM hits""",
)
def geojson_layer(spark, d):
    """The map layer, read back from its FeatureCollection texts."""
    docs = geo.feature_collections(geo.geojson_features(Tables(spark, d).hits))
    kind = "struct<features:array<struct<geometry:struct<coordinates:array<double>>,properties:struct<hit_id:string,hit_type:string,is_fraud:boolean>>>>"
    f = docs.select(F.explode(F.from_json("document", kind)["features"]).alias("f"))
    return f.select("f.properties.hit_id", "f.properties.hit_type", "f.properties.is_fraud", F.col("f.geometry.coordinates")[0].alias("lng"))


@query(
    "geo_spread",
    "SELECT a.ring_id, round(max(" + _HAV.format(a="x.home_", b="y.home_") + "),2) spread_km FROM planted a JOIN accounts x ON x.account=a.account JOIN planted b ON b.ring_id=a.ring_id JOIN accounts y ON y.account=b.account GROUP BY 1",
)
def geo_spread(spark, d):
    t = Tables(spark, d)
    return geo.point_spread(geo.home_points(t.accounts, t.members))


@query(
    "geo_spread_cashouts",
    "SELECT a.ring_id, round(max(" + _HAV.format(a="a.", b="b.") + "),2) spread_km FROM cashouts a JOIN cashouts b ON b.ring_id=a.ring_id GROUP BY 1",
)
def geo_spread_cashouts(spark, d):
    t = Tables(spark, d)
    return geo.point_spread(geo.cashout_points(t.ledger, t.members))


@query(
    "ring_geo",
    """SELECT ring_id, 'home' kind, account, '' txn_id, home_city city, home_lat lat, home_lng lng, CAST(0 AS BIGINT) amount_rupees FROM planted JOIN accounts USING(account)
     UNION ALL SELECT ring_id, 'cashout', account, txn_id, city, lat, lng, CAST(floor(amount_paise/100e0+0.5e0) AS BIGINT) FROM cashouts""",
)
def ring_geo(spark, d):
    t = Tables(spark, d)
    return geo.ring_geo(t.accounts, t.ledger, t.members)


@query("ring_cashout_cities", "SELECT ring_id, count(DISTINCT city) cities FROM cashouts GROUP BY 1")
def ring_cashout_cities(spark, d):
    t = Tables(spark, d)
    return geo.cashout_cities(t.ledger, t.members)


@query(
    "city_rollup",
    """SELECT city, count(*) FILTER (t.account IS NULL) withdrawals, CAST(coalesce(sum(amount_paise) FILTER (t.account IS NULL),0) AS BIGINT) amount_paise,
     count(*) FILTER (t.account IS NOT NULL) ring_withdrawals, CAST(coalesce(sum(amount_paise) FILTER (t.account IS NOT NULL),0) AS BIGINT) ring_amount_paise
     FROM ledger LEFT JOIN (SELECT DISTINCT account FROM truth) t ON t.account=src WHERE channel='ATM' AND city IS NOT NULL GROUP BY 1""",
)
def city_rollup(spark, d):
    t = Tables(spark, d)
    return geo.city_rollup(t.ledger, t.truth)


@query(
    "ring_city_cash",
    "SELECT ring_id, city, CAST(sum(amount_paise) AS BIGINT) amount_paise, count(*) times, count(DISTINCT account) accounts FROM cashouts GROUP BY 1,2",
)
def ring_city_cash(spark, d):
    t = Tables(spark, d)
    return geo.ring_city_cash(t.ledger, t.members)


@query(
    "cash_routes",
    "SELECT DISTINCT c.ring_id, c.account, a.home_city, c.city FROM cashouts c JOIN accounts a ON a.account=c.account WHERE a.home_lat<>c.lat OR a.home_lng<>c.lng",
)
def cash_routes(spark, d):
    t = Tables(spark, d)
    return geo.cash_routes(t.accounts, t.ledger, t.members)


@query(
    "geo_predictions",
    "SELECT account, home_city city, home_lat lat, home_lng lng, v1_bp/10000e0 risk_v1, v2_bp/10000e0 risk_v2, ring_id FROM scored JOIN planted USING(account) WHERE home_lat IS NOT NULL",
)
def geo_predictions(spark, d):
    t = Tables(spark, d)
    s = t.scored.where(F.col("home_lat").isNotNull()).join(t.members, "account", "left")
    return s.select(
        "account", F.col("home_city").alias("city"), F.col("home_lat").alias("lat"), F.col("home_lng").alias("lng"), "risk_v1", "risk_v2", "ring_id"
    )


@query(
    "haversine_legs",
    "SELECT txn_id, round(" + _HAV.format(a="a.home_", b="l.") + ",6) km, round(floor(l.lat/0.5e0)*0.5e0+0.5e0/2,4) snap_lat FROM ledger l JOIN accounts a ON a.account=l.src WHERE l.city IS NOT NULL",
)
def haversine_legs(spark, d):
    t = Tables(spark, d)
    j = t.ledger.where(F.col("city").isNotNull()).join(t.accounts.withColumnRenamed("account", "src"), "src")
    return j.select(
        "txn_id",
        F.round(X.haversine_km(F.col("home_lat"), F.col("home_lng"), F.col("lat"), F.col("lng")), 6).alias("km"),
        X.grid_snap(F.col("lat"), 0.5).alias("snap_lat"),
    )
