"""Accounts that share devices, phones or IP addresses.

An identifier may be on a third of all accounts, so its users are never paired with each other. The number of
*distinct* co-users of an account is the size of a union of user sets, and is found in two exact parts:

* busy identifiers (more than ``busy_over`` users): inclusion-exclusion over the account's own busy identifiers.
  Each account contributes one row per subset of them; counting accounts per subset is an ordinary aggregation.
* the others: pairs through identifiers with at most ``busy_over`` users (so at most ``busy_over`` pairs per link),
  leaving out partners already counted through a busy identifier.

Accounts on more than ``max_subset`` busy identifiers, where subsets would be too many, are joined to the users of
those identifiers directly; the answer stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muletrace.functions.exprs import MICROS_PER_DAY
from muletrace.session import cut_lineage, shuffled

SCOPES = ("device", "phone", "ip", "any")
NEW_ACCOUNT_DAYS = 14


# All non-empty subsets of the (small, sorted) array column ``busy``, by bit mask.
_SUBSETS = (
    "transform(sequence(1, shiftleft(1, size(busy)) - 1), m -> filter(busy, (k, i) -> shiftright(m, i) % 2 = 1))"
)


def _kind(key: Column) -> Column:
    return F.substring_index(key, "|", 1)


def _any_of(keys: str, kind: str) -> Column:
    return F.exists(keys, lambda k: _kind(k) == kind)


def shared_profile(
    links: DataFrame,
    attributes: DataFrame,
    busy_over: int = 64,
    max_subset: int = 8,
    new_days: int = NEW_ACCOUNT_DAYS,
) -> DataFrame:
    """Per account: distinct co-users per identifier type, how many opened within ``new_days`` of it, and the sum and
    count of co-users' scores.

    ``attributes(account, opened_us, score)``: ``score`` is an integer (null: not scored).
    """
    key = F.concat_ws("|", "type", "identifier_id")
    links = links.select("account", key.alias("key")).distinct()
    attrs = attributes.select("account", "opened_us", F.col("score").cast("bigint").alias("score"))
    users = links.groupBy("key").agg(F.count(F.lit(1)).alias("users"))
    # read by every part below: written once
    sized = cut_lineage(links.join(shuffled(users), "key").where(F.col("users") > 1))
    per_account = sized.groupBy("account").agg(F.sort_array(F.collect_list(F.when(F.col("users") > busy_over, F.col("key")))).alias("busy"))
    # an account has few identifiers; the list is per account, never per identifier
    people = cut_lineage(per_account.join(shuffled(attrs), "account", "left"))
    most_busy = people.agg(F.max(F.size("busy"))).first()[0] or 0

    parts = [_through_rare(sized, people, busy_over, most_busy > 0, new_days)]
    if most_busy > 0:
        parts.append(_through_busy(people, max_subset, new_days, most_busy > max_subset))
    if most_busy > max_subset:
        parts.append(_through_many_busy(sized, people, busy_over, max_subset, new_days))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return (
        total.groupBy("account")
        .agg(*[F.sum(c).alias(c) for c in _MEASURES])
    )


_MEASURES = ["device_n", "phone_n", "ip_n", "any_n", "new_n", "score_n", "score_sum"]


def _through_busy(people: DataFrame, max_subset: int, new_days: int, any_wide: bool) -> DataFrame:
    holders = people.where(F.size("busy") > 0)
    # every holder is counted in the subsets, also those with many; they only get their own answer elsewhere
    narrow = holders.where(F.size("busy") <= max_subset)
    sets = narrow.select("account", "opened_us", F.explode(F.expr(_SUBSETS)).alias("subset"))
    rows = narrow.select(F.explode(F.expr(_SUBSETS)).alias("subset"), "opened_us", "score")
    if any_wide:
        # a subset asked for by a narrow account counts wide holders too: they meet through the subset's first member
        wide = holders.where(F.size("busy") > max_subset).select("opened_us", "score", F.explode("busy").alias("key"), "busy")
        asked = sets.select("subset").distinct().withColumn("key", F.element_at("subset", 1))
        met = wide.join(shuffled(asked), "key").where(F.size(F.array_except("subset", "busy")) == 0)
        rows = rows.unionByName(met.select("subset", "opened_us", "score"))
    # users of a subset by opening time: bounded by distinct times, not by users
    by_time = rows.groupBy("subset", "opened_us").agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("score_n"), F.sum("score").alias("score_sum")
    )
    totals = by_time.groupBy("subset").agg(
        F.sum("n").alias("n"), F.sum("score_n").alias("score_n"), F.coalesce(F.sum("score_sum"), F.lit(0)).alias("score_sum")
    )
    span = new_days * MICROS_PER_DAY
    block = F.floor(F.col("opened_us") / F.lit(span))
    near = (
        by_time.where(F.col("opened_us").isNotNull())
        .select("subset", "opened_us", "n", F.explode(F.array(block - 1, block, block + 1)).alias("block"))
        .withColumn("near_n", F.sum("n").over(W.partitionBy("subset", "block").orderBy("opened_us").rangeBetween(-span, span)))
        .where(F.col("block") == block)
        .select("subset", "opened_us", "near_n")
    )
    sign = F.when(F.size("subset") % 2 == 1, 1).otherwise(-1)
    per = (
        sets.join(shuffled(totals), "subset")
        .join(shuffled(near), ["subset", "opened_us"], "left")
        .withColumn("near_n", F.coalesce("near_n", F.lit(0)))
    )

    def only(kind: str) -> Column:
        return F.coalesce(F.forall("subset", lambda k: _kind(k) == kind), F.lit(False))

    agg = per.groupBy("account").agg(
        *[F.sum(F.when(only(t), sign * F.col("n")).otherwise(0)).alias(f"{t}_n") for t in ("device", "phone", "ip")],
        F.sum(sign * F.col("n")).alias("any_n"),
        F.sum(sign * F.col("near_n")).alias("new_n"),
        F.sum(sign * F.col("score_n")).alias("score_n"),
        F.sum(sign * F.col("score_sum")).alias("score_sum"),
    )
    # the account itself is in every one of its sets
    me = narrow.select("account", "busy", "opened_us", F.col("score").alias("own"))
    return agg.join(shuffled(me), "account").select(
        "account",
        *[(F.col(f"{t}_n") - _any_of("busy", t).cast("bigint")).cast("bigint").alias(f"{t}_n") for t in ("device", "phone", "ip")],
        (F.col("any_n") - 1).cast("bigint").alias("any_n"),
        (F.col("new_n") - F.col("opened_us").isNotNull().cast("bigint")).cast("bigint").alias("new_n"),
        (F.col("score_n") - F.col("own").isNotNull().cast("bigint")).cast("bigint").alias("score_n"),
        (F.col("score_sum") - F.coalesce("own", F.lit(0))).cast("bigint").alias("score_sum"),
    )


def _pair_measures(pairs: DataFrame, people: DataFrame, subtract_busy: bool, new_days: int) -> DataFrame:
    """``pairs(account, other, device, phone, ip)`` distinct -> summed measures of the partners."""
    mine = people.select("account", F.col("opened_us").alias("my_opened"), F.col("busy").alias("my_busy"))
    theirs = people.select(F.col("account").alias("other"), "opened_us", "score", F.col("busy").alias("their_busy"))
    p = pairs.join(shuffled(mine), "account").join(shuffled(theirs), "other")
    if subtract_busy:
        common = F.array_intersect("my_busy", "their_busy")
        p = p.withColumn("common", common)
        fresh = {t: ~_any_of("common", t) for t in ("device", "phone", "ip")}
        unseen = F.size("common") == 0
    else:
        fresh, unseen = {t: F.lit(True) for t in ("device", "phone", "ip")}, F.lit(True)
    span = new_days * MICROS_PER_DAY
    near = F.coalesce(F.abs(F.col("opened_us") - F.col("my_opened")) <= span, F.lit(False))
    return p.groupBy("account").agg(
        *[F.count_if(F.col(t) & fresh[t]).alias(f"{t}_n") for t in ("device", "phone", "ip")],
        F.count_if(unseen).alias("any_n"),
        F.count_if(unseen & near).alias("new_n"),
        F.count_if(unseen & F.col("score").isNotNull()).alias("score_n"),
        F.coalesce(F.sum(F.when(unseen, F.col("score"))), F.lit(0)).cast("bigint").alias("score_sum"),
    )


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (account, other) with the identifier types they meet on."""
    met = left.select("account", "key").join(shuffled(right.select(F.col("account").alias("other"), "key")), "key")
    met = met.where(F.col("account") != F.col("other"))
    return met.groupBy("account", "other").agg(
        *[F.bool_or(_kind(F.col("key")) == t).alias(t) for t in ("device", "phone", "ip")]
    )


def _through_rare(sized: DataFrame, people: DataFrame, busy_over: int, any_busy: bool, new_days: int) -> DataFrame:
    rare = sized.where(F.col("users") <= busy_over)
    return _pair_measures(_pairs(rare, rare), people, any_busy, new_days)


def _through_many_busy(sized: DataFrame, people: DataFrame, busy_over: int, max_subset: int, new_days: int) -> DataFrame:
    busy = sized.where(F.col("users") > busy_over)
    wide = people.where(F.size("busy") > max_subset).select("account", F.explode("busy").alias("key"))
    return _pair_measures(_pairs(wide, busy), people, False, new_days)


def identifier_sizes(links: DataFrame) -> DataFrame:
    """Users per identifier, and whether pairs through it are counted by subsets instead of joined."""
    return links.groupBy("type", "identifier_id").agg(F.count_distinct("account").alias("users"))


def nested_identifiers(links: DataFrame) -> DataFrame:
    """Document form of an identifier: its sorted user list."""
    return links.groupBy("identifier_id", "type").agg(F.sort_array(F.collect_set("account")).alias("account_ids"))
