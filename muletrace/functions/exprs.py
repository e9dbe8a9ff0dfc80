"""Column expressions. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
MICROS_PER_MINUTE = 60_000_000
MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 86_400_000_000

# Lower bounds of the risk bands.
RISK_BANDS = ((0.80, "CRITICAL"), (0.60, "HIGH"), (0.35, "MEDIUM"))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a 6371 km sphere, argument clamped to [0, 1]."""
    half_dphi = F.radians(lat2 - lat1) / F.lit(2.0)
    half_dlam = F.radians(lng2 - lng1) / F.lit(2.0)
    a = F.sin(half_dphi) * F.sin(half_dphi) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(
        half_dlam
    ) * F.sin(half_dlam)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))))


def risk_band(risk: Column) -> Column:
    (c, cn), (h, hn), (m, mn) = RISK_BANDS
    return F.when(risk >= c, cn).when(risk >= h, hn).when(risk >= m, mn).otherwise("LOW")


def paise_to_rupees(paise: Column, mode: str = "half_even") -> Column:
    """Whole rupees, never negative. ``half_even`` for exports, ``half_up`` for the live view.

    Integer arithmetic, so no rounding happens on doubles.
    """
    p = F.greatest(paise.cast("bigint"), F.lit(0).cast("bigint"))
    whole = F.floor(p / F.lit(100)).cast("bigint")
    rest = p % F.lit(100)
    if mode == "half_up":
        return whole + F.when(rest >= 50, 1).otherwise(0)
    if mode == "half_even":
        return whole + F.when((rest > 50) | ((rest == 50) & (whole % 2 == 1)), 1).otherwise(0)
    raise ValueError("mode must be half_even or half_up")


def iso_format(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_parse(text: Column) -> Column:
    """ISO seconds with Z -> timestamp without zone, in UTC; null when the text is not in that form."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")


def parse_id_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != F.lit(""))


def jaccard(a: Column, b: Column) -> Column:
    """For small sets held in arrays; the membership joins in ``operators.matching`` serve large ones."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def overlap_coefficient(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


def grid_snap(x: Column, resolution: float) -> Column:
    r = F.lit(float(resolution))
    return F.round(F.floor(x / r) * r + r / F.lit(2.0), 4)


def percent_int(v: Column) -> Column:
    return F.floor(v * F.lit(100.0)).cast("bigint").cast("string")


def grouped_int(v: Column) -> Column:
    return F.format_number(v.cast("bigint"), 0)


# The explanation text of every feature, {} standing for the rendered value.
SIGNAL_TEXT = {
    "pass_through": ("Forwards {}% of what it receives", "percent"),
    "burst_10min": ("{} transactions in 10 minutes", "int"),
    "velocity_per_hr": ("{} transactions per hour", "one"),
    "median_hold_min": ("Holds money only {} minutes before forwarding", "zero"),
    "atm_share": ("{}% of outflow goes to cash (ATM)", "percent"),
    "account_age_days": ("Account opened only {} days before first use", "zero"),
    "shared_device_n": ("Shares a device with {} other accounts", "int"),
    "shared_phone_n": ("Shares a phone number with {} other accounts", "int"),
    "shared_ip_n": ("Shares an IP address with {} accounts", "int"),
    "shared_any_new_n": ("Linked to {} recently opened accounts", "int"),
    "neighbour_risk_v1": ("Connected to high-risk accounts (avg risk {})", "two"),
    "in_degree": ("Receives from {} unique senders", "int"),
    "out_degree": ("Sends to {} unique receivers", "int"),
    "counterparty_div": ("Low counterparty diversity ({})", "two"),
    "home_cashout_km": ("Withdraws cash {} km from home branch", "zero"),
    "amount_out": ("Total outflow ₹{}", "rupees"),
    "amount_in": ("Total inflow ₹{}", "rupees"),
    "txn_in": ("{} incoming transactions", "int"),
    "txn_out": ("{} outgoing transactions", "int"),
}


def fixed_text(v: Column, digits: int) -> Column:
    """Fixed-point text of a double, rounded by its exact binary value with ties to even.

    ``format_string`` rounds the shortest decimal text half up, which differs on 0.125 or 0.15. Here the product with
    10**digits is taken with its rounding error (split multiplication), so ties are recognised exactly.
    """
    s = F.lit(float(10**digits))
    x = v.cast("double")
    p = x * s
    whole = F.floor(p)
    frac = p - whole
    c = x * F.lit(134217729.0)
    hi = c - (c - x)
    err = (hi * s - p) + (x - hi) * s
    up = (frac > 0.5) | ((frac == 0.5) & ((err > 0.0) | ((err == 0.0) & (whole % 2 != 0))))
    return F.format_string(f"%.{digits}f", (whole + F.when(up, 1).otherwise(0)) / s)


def _render(kind: str, v: Column) -> Column:
    if kind == "percent":
        return percent_int(v)
    if kind == "int":
        return v.cast("bigint").cast("string")
    if kind == "rupees":
        return grouped_int(F.floor(v / F.lit(100)))
    digits = {"zero": 0, "one": 1, "two": 2}[kind]
    return fixed_text(v, digits)


def signal_label(feature: str, value: Column) -> Column:
    template, kind = SIGNAL_TEXT[feature]
    before, after = template.split("{}")
    return F.concat(F.lit(before), _render(kind, value), F.lit(after))
