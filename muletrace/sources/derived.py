"""Investigation tables derived from the benchmark parquet tables.

The given tables hold no bank ledger, so accounts, transfers, identifiers and map hits are computed from
``events`` by one projection each (no joins, no shuffles); they grow with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def acc(x: Column) -> Column:
    return F.concat(F.lit("ACC"), F.lpad(x.cast("string"), 6, "0"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = raw.agg((F.max("user_id") + 1).alias("n")).scalar()
    u = F.col("u")
    return (
        raw.select(
            "event_id",
            "ts",
            F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
            F.col("user_id").alias("u"),
            F.col("event_type").alias("et"),
            "value",
            F.round(F.col("value") * 100).cast("bigint").alias("amt"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )
        .withColumns(
            {
                "v": ((u - u % 10) + (F.col("k") + 1 + u) % 10) % n,
                "victim": (F.col("et") == "error") & (F.col("event_id") % 50 == 0),
                "ci": F.when(F.col("event_id") % 10 == 0, (u + 1) % 15).otherwise(u % 15),
            }
        )
        .withColumns(
            {
                "lat": F.lit(8.503) + F.lit(1.7) * F.col("ci") + (F.col("event_id") % 21 - 10) * F.lit(0.0053),
                "lng": F.lit(69.503) + F.lit(1.6) * (F.col("ci") * 4 % 15) + (F.col("event_id") % 17 - 8) * F.lit(0.0053),
                "city": F.concat(F.lit("CITY_"), F.lpad(F.col("ci").cast("string"), 2, "0")),
            }
        )
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    et, victim = F.col("et"), F.col("victim")
    u, v = acc(F.col("u")), acc(F.col("v"))
    eid = F.lpad(F.col("event_id").cast("string"), 9, "0")
    atm = et == "purchase"
    return e.where(victim | et.isin("signup", "purchase") | (F.col("u") != F.col("v"))).select(
        F.concat(F.lit("TXN"), eid).alias("txn_id"),
        F.when(victim, F.concat(F.lit("VICTIM_"), eid))
        .when(et == "signup", F.lit("SALARY"))
        .when(et == "view", v)
        .otherwise(u)
        .alias("src"),
        F.when(victim, u)
        .when(et.isin("signup", "view"), u)
        .when(atm, F.lit("CASH"))
        .otherwise(v)
        .alias("dst"),
        F.col("amt").alias("amount_paise"),
        "ts",
        "us",
        F.when(atm, "ATM").when(et == "signup", "NEFT").when(et == "view", "IMPS").otherwise("UPI").alias("channel"),
        F.when(atm, F.col("city")).alias("city"),
        F.when(atm, F.col("lat")).alias("lat"),
        F.when(atm, F.col("lng")).alias("lng"),
        victim.alias("is_fraud"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    g = raw.groupBy(F.col("user_id").alias("u")).agg(F.min("ts").alias("first_ts"))
    u = F.col("u")
    return g.select(
        acc(u).alias("account"),
        F.concat(F.lit("BANK_"), (u % 8).cast("string")).alias("bank"),
        F.date_sub(F.col("first_ts").cast("date"), (u * 13 % 60).cast("int")).alias("opened_on"),
        ((u * 7919 % 5000) * 100 + 10000).alias("opening_balance_paise"),
        F.concat(F.lit("CITY_"), F.lpad((u % 15).cast("string"), 2, "0")).alias("home_city"),
        (F.lit(8.503) + F.lit(1.7) * (u % 15)).alias("home_lat"),
        (F.lit(69.503) + F.lit(1.6) * ((u % 15) * 4 % 15)).alias("home_lng"),
    )


def identifier_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("u")).distinct()

    def link(prefix: str, x: Column, kind: str) -> Column:
        return F.struct(
            F.concat(F.lit(prefix), F.lpad(x.cast("string"), 6, "0")).alias("identifier_id"), F.lit(kind).alias("type")
        )

    return users.select(
        acc(u).alias("account"),
        F.inline(F.array(link("DEV", u - u % 3, "device"), link("PHN", u - u % 7, "phone"), link("IP", u % 11, "ip"))),
    ).select("identifier_id", "type", "account")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    et = F.col("et")
    return _events(spark, sf_dir).select(
        F.concat(F.lit("HIT"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("hit_id"),
        "ts",
        "lat",
        "lng",
        "city",
        F.when(et == "purchase", "atm_cashout").when(et == "error", "mule_activity").otherwise("p2p_transfer").alias("hit_type"),
        F.col("amt").alias("amount_paise"),
        F.col("victim").alias("is_fraud"),
        F.least(F.lit(0.99), F.expr("(amt * 2 + 40) div 80") / F.lit(1000.0)).alias("risk_score"),
        acc(F.col("u")).alias("account"),
    )


def planted_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of ten accounts: rings given as input, for operators that do not run discovery."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("u")).distinct()
    u = F.col("u")
    ring = F.concat(F.lit("RING"), F.lpad(((u - u % 10) / 10).cast("bigint").cast("string"), 6, "0"))
    return users.select(ring.alias("ring_id"), acc(u).alias("account"))


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third block counts as a planted ring; pattern by block number."""
    no = F.substring("ring_id", 5, 6).cast("int")
    return (
        planted_members(spark, sf_dir)
        .where(no % 3 == 0)
        .withColumn("pattern", F.when(no % 4 == 0, "A").when(no % 4 == 1, "B").when(no % 4 == 2, "C").otherwise("D"))
    )
