"""The account feature matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muletrace.functions.exprs import MICROS_PER_DAY, MICROS_PER_HOUR, MICROS_PER_MINUTE, haversine_km
from muletrace.operators import events as ev
from muletrace.operators import identity, timeline
from muletrace.operators.quantiles import grouped_median
from muletrace.schemas import drop_labels
from muletrace.session import cut_lineage, shuffled

# The three column sets of the matrix.
V1_FEATURES = [
    "amount_in",
    "amount_out",
    "txn_in",
    "txn_out",
    "pass_through",
    "median_hold_min",
    "velocity_per_hr",
    "burst_10min",
    "counterparty_div",
    "in_degree",
    "out_degree",
    "account_age_days",
    "atm_share",
]
IDENTITY_FEATURES = ["shared_device_n", "shared_phone_n", "shared_ip_n", "shared_any_new_n", "neighbour_risk_v1"]
GEO_FEATURES = ["home_cashout_km", "cashout_city_n"]
V2_FEATURES = V1_FEATURES + IDENTITY_FEATURES

NO_HOLD_MIN = 9999.0
MIN_SPAN_HOURS = 0.0167


def opened_us(accounts: DataFrame) -> DataFrame:
    if "opened_us" in accounts.columns:
        return accounts
    src = "opened_on" if "opened_on" in accounts.columns else "opened_at"
    return accounts.withColumn("opened_us", F.unix_micros(F.col(src).cast("timestamp")))


def median_hold(events: DataFrame, hot: timeline.HotAccounts | None = None) -> DataFrame:
    pairs = timeline.hold_pairs(events, hot)
    return grouped_median(pairs, ["account"], "hold_us", F.floor(F.col("hold_us") / F.lit(10 * MICROS_PER_MINUTE)), "hold_us")


def transaction_features(accounts: DataFrame, ledger: DataFrame, rows_per_block: int = timeline.ROWS_PER_BLOCK) -> DataFrame:
    """The 13 money features, one row per account, also for accounts without transfers."""
    e = ev.account_events(ev.with_us(drop_labels(ledger)))
    # one row per account; it also tells which accounts are hot, without another pass over the ledger
    act = cut_lineage(ev.activity(e))
    sizes = act.select("account", (F.col("txn_in") + F.col("txn_out")).alias("n"), F.col("first_us").alias("lo"), F.col("last_us").alias("hi"))
    hot = timeline.hot_from_sizes(sizes, rows_per_block)
    hold = median_hold(e, hot)
    bst = timeline.burst(e, hot)
    zero_long = ["amount_in", "amount_out", "txn_in", "txn_out", "atm_out", "in_degree", "out_degree", "counterparties"]
    j = (
        opened_us(accounts)
        .join(shuffled(act), "account", "left")
        .join(shuffled(hold), "account", "left")
        .join(shuffled(bst), "account", "left")
        .na.fill(0, subset=[*zero_long, "burst_10min"])
    )
    n = F.col("txn_in") + F.col("txn_out")
    span_h = (F.col("last_us") - F.col("first_us")) / F.lit(float(MICROS_PER_HOUR))
    at_least_1 = lambda c: F.greatest(c, F.lit(1))
    age = F.greatest((F.col("first_us") - F.col("opened_us")) / F.lit(float(MICROS_PER_DAY)), F.lit(0.0))
    derived = {
        "pass_through": F.round(F.least("amount_out", "amount_in") / at_least_1(F.col("amount_in")), 6),
        "median_hold_min": F.round(F.coalesce(F.col("hold_us") / F.lit(float(MICROS_PER_MINUTE)), F.lit(NO_HOLD_MIN)), 2),
        "velocity_per_hr": F.when(n >= 2, F.round(n / F.greatest(span_h, F.lit(MIN_SPAN_HOURS)), 4)).otherwise(F.lit(0.0)),
        "counterparty_div": F.round(F.col("counterparties") / at_least_1(n), 6),
        "account_age_days": F.when(
            F.col("first_us").isNotNull() & F.col("opened_us").isNotNull(), F.round(age, 2)
        ).otherwise(F.lit(0.0)),
        "atm_share": F.round(F.col("atm_out") / at_least_1(F.col("amount_out")), 6),
    }
    keep = [F.col(c) for c in accounts.columns]
    return j.select(*keep, *[derived[c].alias(c) if c in derived else F.col(c) for c in V1_FEATURES])


def identity_features(accounts: DataFrame, links: DataFrame, v1_scores: DataFrame, busy_over: int = 64) -> DataFrame:
    """Co-user counts and mean score of distinct co-users. ``v1_scores(account, v1_bp)``: score in 1/10000."""
    attrs = opened_us(accounts).select("account", "opened_us").join(
        shuffled(v1_scores.select("account", F.col("v1_bp").alias("score"))), "account", "left"
    )
    shared = identity.shared_profile(links, attrs, busy_over=busy_over)
    return shared.select(
        "account",
        F.col("device_n").alias("shared_device_n"),
        F.col("phone_n").alias("shared_phone_n"),
        F.col("ip_n").alias("shared_ip_n"),
        F.col("new_n").alias("shared_any_new_n"),
        F.round(
            F.coalesce(F.try_divide(F.col("score_sum").cast("double"), F.col("score_n")) / F.lit(10000.0), F.lit(0.0)), 4
        ).alias("neighbour_risk_v1"),
    )


def geo_features(accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Median distance from home to cash withdrawals (1 decimal) and number of withdrawal cities."""
    homes = accounts.select(F.col("account"), "home_lat", "home_lng")
    w = ledger.where((F.col("channel") == "ATM") & F.col("city").isNotNull()).select(F.col("src").alias("account"), "city", "lat", "lng")
    km = haversine_km(F.col("home_lat"), F.col("home_lng"), F.col("lat"), F.col("lng"))
    d = w.join(shuffled(homes), "account").select("account", "city", km.alias("km"))
    cities = d.groupBy("account", "city").agg(F.count(F.lit(1)).alias("n")).groupBy("account").agg(
        F.count(F.lit(1)).alias("cashout_city_n")
    )
    med = grouped_median(d, ["account"], "km", F.floor(F.col("km")), "home_cashout_km")
    return cities.join(shuffled(med), "account").select("account", F.round("home_cashout_km", 1).alias("home_cashout_km"), "cashout_city_n")


def feature_matrix(
    accounts: DataFrame, ledger: DataFrame, links: DataFrame, score_v1, geo: bool = True, busy_over: int = 64, money: DataFrame | None = None
) -> DataFrame:
    """Full matrix. ``score_v1`` maps the money features to ``(account, ..., v1_bp)`` for the neighbour risk; ``money`` are the
    :func:`transaction_features` of the same accounts and ledger, where they are at hand."""
    # read twice (neighbour scores and the result): one row per account, written once
    base = cut_lineage(score_v1(transaction_features(accounts, ledger) if money is None else money))
    ident = identity_features(accounts, links, base.select("account", "v1_bp"), busy_over)
    out = base.join(shuffled(ident), "account", "left")
    if geo:
        out = out.join(shuffled(geo_features(accounts, ledger)), "account", "left")
    fill = {c: 0 for c in IDENTITY_FEATURES}
    fill["neighbour_risk_v1"] = 0.0
    if geo:
        fill.update(home_cashout_km=0.0, cashout_city_n=0)
    return out.na.fill(fill)
