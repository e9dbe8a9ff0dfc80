"""Communities by modularity, in few rounds.

Gains are whole numbers, 2 * total * weight between - degree * degree, and ties are settled by a digest of the names, so the
result is one and the same at every size and on every engine. A round is one of two kinds:

* **Merge.** Every community picks the neighbour it gains most by joining. Of two that pick each other the one of smaller
  degree joins the other; of the rest, those nobody picks join, and those somebody picks do or receive by a coin of the
  round. All that join one community are put in order, and the longest start of that order is taken in which each still
  gains after the ones before it, so a hub takes in all its leaves at once. The largest gain of all is always taken.
* **Move.** When no merge gains, single accounts change over. A pair of communities exchanges accounts if both have no better
  exchange; again the longest start of the order is taken in which each still gains. Then merges are tried again.

Every round raises modularity, so the rounds end. Pairs, stars and degrees are carried contracted from round to round.
Stars stay stars: the neighbour of a community inside a star is the one with most members there, and a pair's gain counts
all edges and all stars between the two.

A graph of at most ``ONE_TASK_ROWS`` edges and members of stars goes through its rounds inside one task (``communities_task``), since there
may be a thousand rounds of few accounts each; in a larger one every round is some joins. Both give the same.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muletrace.operators.communities_task import in_one_task
from muletrace.session import cut_counting, cut_lineage, cut_table
from muletrace.session import shuffled as _side

UNIT = 1_000_000  # of edge weight


def _big(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _digest(*names) -> Column:
    return F.md5(F.concat_ws("|", *names))


def gain_class(gain: Column) -> Column:
    """Number of digits and the first two of them: orders gains roughly, on whole numbers alone."""
    said = gain.cast("string")
    return F.length(said) * 100 + F.substring(said, 1, 2).cast("int")


ONE_TASK = 100_000  # rows that one task may order
ONE_TASK_ROWS = 6_000_000  # edges and members of stars that one task may hold
ONE_TASK_TOTAL = 1 << 60  # of all weight there


def _before(rows: DataFrame, key: list[str], value: Column, name: str, most: int) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the same key that come earlier by (class down, digest).

    Of more than ``ONE_TASK`` rows (``most`` bounds them), a key's are ordered in buckets that tasks share, and only bucket
    totals are ordered per key: there are at most 256 buckets a class, and a class is one of a few thousand. The sums are
    the same."""
    if most <= ONE_TASK:
        all_before = W.partitionBy(*key).orderBy(F.desc("class"), "digest").rowsBetween(W.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum(value).over(all_before), F.lit(0)))
    bucket = F.struct((-F.col("class")).alias("c"), F.substring("digest", 1, 2).alias("d"))
    rows = rows.withColumn("value_", value).withColumn("bucket_", bucket)
    totals = rows.groupBy(*key, "bucket_").agg(F.sum("value_").alias("total_"))
    earlier = W.partitionBy(*key).orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("earlier_", F.coalesce(F.sum("total_").over(earlier), F.lit(0))).drop("total_")
    inside = W.partitionBy(*key, "bucket_").orderBy("digest").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside_", F.coalesce(F.sum("value_").over(inside), F.lit(0)))
    return rows.join(_side(totals), [*key, "bucket_"]).withColumn(name, F.col("earlier_") + F.col("inside_")).drop("value_", "bucket_", "earlier_", "inside_")


def _while_gaining(rows: DataFrame, key: list[str], left: Column) -> DataFrame:
    """The rows of each key up to the first one with nothing ``left`` to gain."""
    at = F.struct((-F.col("class")).alias("c"), F.col("digest").alias("d"))
    stop = rows.where(left <= 0).groupBy(*key).agg(F.min(at).alias("stop_"))
    return rows.join(_side(stop), key, "left").where(F.col("stop_").isNull() | (at < F.col("stop_")))


class Graph:
    """Communities as they are: ``pairs(c, d, w)``, ``on(star, c, n)``, ``degree(c, k)``; ``total``: twice all weight."""

    def __init__(self, money: DataFrame, stars: DataFrame, label: DataFrame, n: int, total):
        """``label(account, c, k)``; n communities."""
        of = _side(label.select("account", "c"))
        end = lambda a, c: of.select(F.col("account").alias(a), F.col("c").alias(c))
        paid = money.join(end("a", "x"), "a").join(end("b", "y"), "b").where(F.col("x") != F.col("y"))
        self.n, self.total = n, F.lit(total)
        on = stars.join(of, "account").groupBy("star", "c").agg(F.count(F.lit(1)).alias("n"))
        self._keep(_summed(paid), on, label.groupBy("c").agg(_big(F.sum("k")).alias("k")))

    def _keep(self, *tables: DataFrame) -> None:
        """Writes the three tables side by side."""
        with ThreadPoolExecutor(len(tables)) as pool:
            self.pairs, self.on, self.degree = pool.map(cut_table, tables)

    def _weights(self) -> DataFrame:
        """(c, d, w): all weight between communities that pay each other, or of which one has most members of a star."""
        top = self.on.groupBy("star").agg(F.max(F.struct("n", "c"))["c"].alias("top"))
        beside = self.on.join(_side(top), "star").where(F.col("c") != F.col("top"))
        near = self.pairs.select("c", "d").unionByName(beside.select(F.least("c", "top").alias("c"), F.greatest("c", "top").alias("d"))).distinct()
        on = lambda c, name: _side(self.on.select("star", F.col("c").alias(c), F.col("n").alias(name)))
        shared = near.join(on("c", "nc"), "c").join(on("d", "nd"), ["star", "d"])
        shared = shared.select("c", "d", (F.col("nc") * F.col("nd") * UNIT).alias("w"))
        return self.pairs.unionByName(shared).groupBy("c", "d").agg(_big(F.sum("w")).alias("w"))

    def merges(self, round_: int) -> tuple[DataFrame, int]:
        """(c, into) and how many."""
        k = lambda c, name: _side(self.degree.select(F.col("c").alias(c), F.col("k").alias(name)))
        gain = self.total * F.col("w") - F.col("kc") * F.col("kd")
        gains = self._weights().join(k("c", "kc"), "c").join(k("d", "kd"), "d").withColumn("gain", gain).where(F.col("gain") > 0)
        gains = gains.withColumn("tie", _digest("c", "d"))
        one = lambda c, d, kc, kd: F.struct(F.col(c).alias("c"), F.struct("gain", "tie", F.col(d).alias("to"), F.col(kc).alias("kc"), F.col(kd).alias("kd")).alias("p"))
        both = gains.select(F.inline(F.array(one("c", "d", "kc", "kd"), one("d", "c", "kd", "kc"))))
        pick = cut_lineage(both.groupBy("c").agg(F.max("p").alias("p")).select("c", "p.*"))
        theirs = pick.select(F.col("c").alias("to"), F.col("to").alias("back"))
        asked = pick.join(_side(theirs), "to").withColumn("mutual", F.col("back") == F.col("c"))
        wanted = asked.where(~F.col("mutual")).groupBy("to").agg(F.lit(True).alias("wanted")).withColumnRenamed("to", "c")
        lower = F.struct("kc", "c") < F.struct(F.col("kd").alias("kc"), F.col("to").alias("c"))
        coin = F.substring(_digest("c", F.lit(round_)), 1, 1) < "8"
        joins = F.when(F.col("mutual"), lower).otherwise(F.col("wanted").isNull() | coin)
        asked = cut_lineage(asked.join(_side(wanted), "c", "left").withColumn("joins", joins))
        open_ = _side(asked.where(~F.col("joins")).select(F.col("c").alias("to")))
        ready = asked.where("joins").join(open_, "to", "left_semi")
        ready = ready.select("c", "to", "gain", "kc", "kd", gain_class(F.col("gain")).alias("class"), _digest("c", "to").alias("digest"))
        # those before weigh on the degree; what they share with this one through stars counts for it
        members = ready.select("c", "to", "class", "digest").join(_side(self.on), "c")
        beside = _before(members, ["to", "star"], F.col("n"), "ahead", self.n)
        beside = beside.groupBy("c").agg(_big(F.sum(F.col("n") * F.col("ahead")) * UNIT).alias("shared"))
        ready = _before(ready, ["to"], F.col("kc"), "ahead", self.n).join(_side(beside), "c", "left")
        left = F.col("gain") + self.total * _big(F.coalesce("shared", F.lit(0))) - F.col("kc") * _big(F.col("ahead"))
        taken = _while_gaining(ready, ["to"], left).select("c", F.col("to").alias("into"))
        return cut_counting(taken, F.lit(True))

    def merge(self, taken: DataFrame, n: int) -> None:
        into = _side(taken)
        now = lambda df, c: df.join(into.select(F.col("c").alias(c), "into"), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")
        x, y = now(self.pairs, "c").withColumnRenamed("c", "x"), "y"
        paid = now(x, "d").withColumnRenamed("d", y).where(F.col("x") != F.col("y"))
        on = now(self.on, "c").groupBy("star", "c").agg(F.sum("n").alias("n"))
        self._keep(_summed(paid), on, now(self.degree, "c").groupBy("c").agg(_big(F.sum("k")).alias("k")))
        self.n -= n


def _summed(paid: DataFrame) -> DataFrame:
    return paid.groupBy(F.least("x", "y").alias("c"), F.greatest("x", "y").alias("d")).agg(F.sum("w").alias("w"))


def _moves(money: DataFrame, stars: DataFrame, label: DataFrame, g: Graph, n: int) -> tuple[DataFrame, int]:
    """(account, into) and how many: accounts that change over in one round. ``label(account, c, k)``
    of n accounts."""
    own = label.select("account", F.col("c").alias("mine"), F.col("k").alias("ka"))
    other = label.select(F.col("account").alias("b"), F.col("c").alias("to"))
    both = money.unionByName(money.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    paid = both.join(_side(other), "b").groupBy(F.col("a").alias("account"), "to").agg(F.sum("w").alias("w"))
    top = g.on.groupBy("star").agg(F.max(F.struct("n", "c"))["c"].alias("to"))
    near = paid.select("account", "to").unionByName(stars.select("star", "account").join(_side(top), "star").select("account", "to"))
    near = near.unionByName(own.select("account", F.col("mine").alias("to"))).distinct()
    shared = near.join(_side(stars.select("star", "account")), "account")
    shared = shared.join(_side(g.on.select("star", F.col("c").alias("to"), "n")), ["star", "to"]).join(_side(own.select("account", "mine")), "account").select("account", "to", ((F.col("n") - (F.col("mine") == F.col("to")).cast("int")) * UNIT).alias("w"))
    weight = cut_lineage(paid.unionByName(shared).groupBy("account", "to").agg(_big(F.sum("w")).alias("w")))
    k = lambda c, name: _side(g.degree.select(F.col("c").alias(c), F.col("k").alias(name)))
    stay = weight.withColumnsRenamed({"to": "mine", "w": "w_mine"})
    asks = weight.join(_side(own), "account").where(F.col("to") != F.col("mine")).join(_side(stay), ["account", "mine"], "left")
    asks = asks.join(k("to", "k_to"), "to").join(k("mine", "k_mine"), "mine")
    gain = g.total * (F.col("w") - F.coalesce("w_mine", _big(F.lit(0)))) - F.col("ka") * (F.col("k_to") - F.col("k_mine") + F.col("ka"))
    asks = asks.withColumn("gain", gain).where(F.col("gain") > 0)
    best = F.max(F.struct("gain", _digest("account", "to").alias("digest"), "to", "mine", "ka"))
    asks = cut_lineage(asks.groupBy("account").agg(best.alias("p")).select("account", "p.*"))
    pair = asks.groupBy("mine", "to").agg(F.max("gain").alias("gain")).withColumn("tie", _digest("mine", "to"))
    most = F.struct("gain", "tie")
    pick = pair.select(F.explode(F.array("mine", "to")).alias("c"), most.alias("p")).groupBy("c").agg(F.max("p").alias("p"))
    end = lambda c, name: _side(pick.select(F.col("c").alias(c), F.col("p.tie").alias(name)))
    agreed = pair.join(end("mine", "x"), "mine").join(end("to", "y"), "to").where((F.col("tie") == F.col("x")) & (F.col("tie") == F.col("y")))
    ready = asks.join(_side(agreed.select("mine", "to")), ["mine", "to"], "left_semi").withColumn("class", gain_class(F.col("gain")))
    ready = _before(cut_lineage(ready), ["mine", "to"], F.col("ka"), "ahead", n)
    left = F.col("gain") - 2 * F.col("ka") * _big(F.col("ahead"))
    return cut_counting(_while_gaining(ready, ["mine", "to"], left).select("account", F.col("to").alias("into")), F.lit(True))


def communities(money: DataFrame, stars: DataFrame, rounds: list | None = None) -> DataFrame:
    """(account, community), the community named by its smallest account.

    ``money(a, b, weight)`` are undirected edges; ``stars(star, account, size)`` stand for an edge of weight 1 between any two of a
    star's accounts. No edges give no rows. ``rounds`` is told what each round did: (kind, how many).
    """
    money, edges = cut_counting(money.select("a", "b", F.round(F.col("weight") * UNIT).cast("bigint").alias("w")).where("w > 0"), F.lit(True))
    stars = stars.select("star", "account", "size")
    stars, odd = cut_counting(stars, F.col("star").isNull() | F.col("size").isNull())
    ends = money.select(F.explode(F.array("a", "b")).alias("account"), "w")
    ends = ends.unionByName(stars.select("account", ((F.col("size") - 1) * UNIT).alias("w")))
    own = ends.groupBy("account").agg(_big(F.sum("w")).alias("k"))
    label, n = cut_counting(own.select("account", F.col("account").alias("c"), "k"), F.lit(True))
    if not n:
        return label.select("account", F.col("c").alias("community"))
    accounts = n
    total = label.agg(_big(F.sum("k"))).first()[0]  # every edge counts at both ends
    if not odd and edges + stars.count() <= ONE_TASK_ROWS and total < ONE_TASK_TOTAL:
        done = cut_lineage(in_one_task(money, stars, label, int(total)))
        if rounds is not None:
            steps = done.where(F.col("account").isNull()).orderBy("kind").select("kind", "n").collect()
            rounds.extend((r.kind.split()[1], r.n) for r in steps)
        return done.where(F.col("account").isNotNull()).select("account", "community")
    count = 0
    told = rounds if rounds is not None else []
    while True:
        g, steps = Graph(money, stars, label, n, total), []
        while True:
            taken, merged = g.merges(count)
            count += 1
            if not merged:
                break
            told.append(("merge", merged))
            g.merge(taken, merged)
            steps.append((taken, merged))
        for taken, merged in steps:
            label = label.join(_side(taken), "c", "left").withColumn("c", F.coalesce("into", "c")).drop("into")
        label = cut_table(label) if steps else label
        moved, changed = _moves(money, stars, label, g, accounts)
        if not changed:
            break
        told.append(("move", changed))
        label = label.join(_side(moved), "account", "left").select("account", F.coalesce("into", "c").alias("c"), "k")
        label = cut_table(label)
        n = label.select("c").distinct().count()
    name = label.groupBy("c").agg(F.min("account").alias("community"))
    return label.join(_side(name), "c").select("account", "community")
