"""Stolen money followed batch by batch.

Every victim deposit is a case, whether or not its ring is known yet, so no case ever has to look back. Kept between
batches, as logs of changes under batch ids:

* ``purses``: balances of accounts, shared by all cases;
* ``taints``: tainted money per case and account. It is also the routing table: a payment goes to the cases that have
  its payer, and an account enters it, with no taint at first, when money can reach it;
* ``flows``: what moved between two accounts, added up when read;
* ``cases``: the deposit's payee, and the batch since which rows of the case count.

A batch in order of time reads these and its own transfers only. Transfers older than what was folded change balances
after the fact: the cases that had reached one of their ends, and late deposits, are traced anew from the ledger, all
others go on. After every batch the tables say what :func:`taint.trace` says of the whole ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muletrace.operators import taint
from muletrace.operators.balances import opening_or_default, sides
from muletrace.schemas import VICTIM_PREFIX
from muletrace.session import cut_counting, cut_lineage
from muletrace.streaming.tables import BatchTables

LATEST = 2**62


class LiveTraces:
    """``openings(account, opening_balance_paise)`` as for :func:`taint.trace`."""

    def __init__(self, spark: SparkSession, folder: str, openings: DataFrame):
        self.spark, self.openings, self.tables = spark, openings, BatchTables(spark, folder)

    def cases(self, before: int = LATEST) -> DataFrame | None:
        """(case_id, account, since): the deposit's payee, and the batch since which rows of the case count."""
        log = self.tables.log("cases", before)
        return None if log is None else log.groupBy("case_id").agg(F.max_by("account", "batch").alias("account"), F.max("since").alias("since"))

    def _valid(self, name: str, before: int) -> DataFrame | None:
        """Rows of a log that count: not older than the last time their case was traced anew."""
        log = self.tables.log(name, before)
        if log is None:
            return None
        return log.join(self.cases(before).select("case_id", "since"), "case_id").where(F.col("batch") >= F.col("since"))

    def taints(self, before: int = LATEST) -> DataFrame | None:
        """(case_id, account, tainted) as of a batch."""
        rows = self._valid("taints", before)
        return None if rows is None else rows.groupBy("case_id", "account").agg(F.max_by("tainted", "batch").alias("tainted"))

    def flows(self, before: int = LATEST) -> DataFrame | None:
        """(case_id, src, dst, value) as of a batch."""
        rows = self._valid("flows", before)
        return None if rows is None else rows.groupBy("case_id", "src", "dst").agg(F.sum("value").alias("value"))

    def balances(self, before: int = LATEST) -> DataFrame | None:
        """(case_id, account, balance, tainted) as of a batch."""
        rows = self.taints(before)
        return None if rows is None else self._purses(rows.select("account").distinct(), before).join(rows, "account").select(
            "case_id", "account", F.col("opening_balance_paise").alias("balance"), "tainted"
        )

    def _purses(self, accounts: DataFrame, before: int) -> DataFrame:
        """Balances of ``accounts(account)``, under the name an opening balance has."""
        rows = accounts.join(self.openings.select("account", "opening_balance_paise"), "account", "left")
        start = opening_or_default(F.col("account"), F.col("opening_balance_paise"))
        log = self.tables.log("purses", before)
        if log is None:
            return rows.select("account", start.alias("opening_balance_paise"))
        newest = log.join(accounts, "account", "left_semi").groupBy("account").agg(F.max_by("balance", "batch").alias("balance"))
        return rows.join(newest, "account", "left").select("account", F.coalesce("balance", start).alias("opening_balance_paise"))

    def update(self, batch_id: int, new: DataFrame, history: Callable[[], DataFrame]) -> DataFrame:
        """Take in transfers that are not in any earlier batch; returns ``(case_id)`` of the cases that changed.

        ``history()`` gives all transfers so far, these included; it is asked for only when late ones touch a case."""
        t = self.tables
        new = cut_lineage(new.select("txn_id", "src", "dst", "amount_paise", "us"))
        at = F.struct(F.col("us").alias("us"), F.col("txn_id").alias("txn"))
        both = sides(new)
        net = both.groupBy("account").agg(F.sum("delta").alias("net"))
        purses = cut_lineage(self._purses(net.select("account"), batch_id))
        ends = purses.select("account")
        everyone = self.taints(batch_id)
        if everyone is None:
            everyone = self.spark.createDataFrame([], "case_id string, account string, tainted bigint")
        known = cut_lineage(everyone.join(ends, "account", "left_semi").select("case_id", "account", "tainted"))
        deposits = new.where(F.col("src").startswith(VICTIM_PREFIX)).select(F.col("txn_id").alias("case_id"), F.col("dst").alias("account"))
        again, redone = self._late(batch_id, new.withColumn("at", at), known, deposits)
        if redone:
            known, fresh = known.join(again, "case_id", "left_anti"), deposits.join(again, "case_id", "left_anti")
        else:
            fresh = deposits
        whole = F.lit(taint.END_OF_TIME).cast("bigint").alias("as_of_us")
        cases = fresh.select("case_id", F.col("case_id").alias("victim_txn"), whole)
        reached = taint.reach(new, cases, known.select("case_id", "account", whole))
        rows, _ = taint.case_payments(new, purses, cases, reached)
        changed, flows = taint.fold(rows, known)
        routes = reached.select("case_id", "account").join(known.select("case_id", "account"), ["case_id", "account"], "left_anti")
        taints = changed.join(routes, ["case_id", "account"], "full").select(
            "case_id", "account", F.coalesce("tainted", F.lit(0)).cast("bigint").alias("tainted")
        )
        started = fresh.withColumn("since", F.lit(batch_id).cast("bigint"))
        if redone:
            old = again.join(deposits, "case_id", "left_anti")
            payees = deposits.join(again, "case_id", "left_semi")
            if (known_cases := self.cases(batch_id)) is not None:
                payees = payees.unionByName(known_cases.select("case_id", "account").join(old, "case_id", "left_semi"))
            started = started.unionByName(payees.withColumn("since", F.lit(batch_id).cast("bigint")))
            whole_ledger = history().select("txn_id", "src", "dst", "amount_paise", "us")
            held, moved = taint.trace(whole_ledger, self.openings, again.select("case_id", F.col("case_id").alias("victim_txn")))
            taints = taints.unionByName(held.select("case_id", "account", "tainted"))
            flows = flows.unionByName(moved)
        t.write("purses", batch_id, purses.join(net, "account").select("account", (F.col("opening_balance_paise") + F.col("net")).alias("balance")))
        t.write("taints", batch_id, taints)
        t.write("flows", batch_id, flows)
        t.write("cases", batch_id, started)
        t.write("clock", batch_id, new.agg(F.max(at).alias("at")).where(F.col("at").isNotNull()).select("at.us", "at.txn"))
        self._compact(batch_id)
        return t.until("taints", batch_id + 1).where(F.col("batch") == batch_id).select("case_id").distinct()

    def _late(self, batch_id: int, new: DataFrame, known: DataFrame, deposits: DataFrame) -> tuple[DataFrame | None, int]:
        """Cases that late transfers touch, and their number. Every end of a late transfer in ``known`` counts, however
        early or late the case reached it."""
        clocks = self.tables.until("clock", batch_id)
        last = None if clocks is None else clocks.agg(F.max(F.struct("us", "txn"))).first()[0]
        if last is None:
            return None, 0
        late = new.where(F.col("at") < F.struct(F.lit(last["us"]).alias("us"), F.lit(last["txn"]).alias("txn")))
        ends = late.select(F.explode(F.array("src", "dst")).alias("account")).distinct()
        hit = known.join(ends, "account", "left_semi").select("case_id")
        own = deposits.join(late.select(F.col("txn_id").alias("case_id")), "case_id", "left_semi").select("case_id")
        return cut_counting(hit.unionByName(own).distinct(), F.lit(True))

    def _compact(self, batch_id: int) -> None:
        t = self.tables
        if not t.merge_due("purses", batch_id):
            return
        newest = t.log("purses", batch_id + 1).groupBy("account").agg(F.max_by("balance", "batch").alias("balance"))
        t.write("taints_merged", batch_id, self.taints(batch_id + 1))
        t.write("flows_merged", batch_id, self.flows(batch_id + 1))
        t.write("cases_merged", batch_id, self.cases(batch_id + 1))
        t.write("purses_merged", batch_id, newest)
