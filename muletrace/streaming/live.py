"""The live form: running account features in state, rings and alerts per micro-batch.

Input order is not assumed: rows of a batch are sorted per account. Rows older than what an account has already folded
are late: they count in totals, degrees and first times like any other, only bursts and hold times, which need the order,
leave them out and ``late`` says how many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from muletrace.functions.exprs import iso_parse, risk_band
from muletrace.operators import graph, rings, taint
from muletrace.operators.events import account_events
from muletrace.operators.features import transaction_features
from muletrace.operators.matching import best_overlap
from muletrace.schemas import ledger_rules, split_valid
from muletrace.session import cut_lineage
from muletrace.streaming.ingest import observed_lines, observed_transfers
from muletrace.streaming.state import Counts, Queue
from muletrace.streaming.tables import BatchTables
from muletrace.streaming.traces import LiveTraces

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BURST_US = 600_000_000
SCORE_CHANGE_BP = 200
DISCOVER_EVERY_US = 300_000_000

FEATURE_ROW = (
    "account string, amount_in bigint, amount_out bigint, txn_in bigint, txn_out bigint, atm_out bigint, "
    "in_degree bigint, out_degree bigint, counterparties bigint, first_us bigint, last_us bigint, burst_10min bigint, "
    "matched bigint, median_hold_us double, late bigint"
)


def valid_transactions(txns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted ledger rows, rejects with reasons) of the text form, counted for :class:`ingest.IngestCounts`."""
    good, bad = split_valid(txns, ledger_rules(with_text_ts=True), observed_transfers)
    ts = iso_parse(F.col("ts"))
    return good.withColumn("us", F.unix_micros(ts.cast("timestamp"))).withColumn("ts", ts), bad


class AccountFeatures(StatefulProcessor):
    """Per account: totals in one value, counterparties in a map, open credits and the burst window as queues, hold times as
    counts by number. Every one of them is read and written by what a batch brings, however long the account's history.

    With ``idle_us``, an account that the watermark has left behind by its last transfer loses its state; what comes from it
    later starts anew.
    """

    def __init__(self, idle_us: int | None = None):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", ", ".join(f"{c} bigint" for c in (*self.COLUMNS, *self.HIDDEN)))
        self.partners = handle.getMapState("partners", "cp string", "sent int, got int")
        self.holds = handle.getMapState("holds", Counts.KEY, Counts.VALUE)
        self.credits = handle.getMapState("credits", Queue.KEY, Queue.VALUE)
        self.window = handle.getMapState("window", Queue.KEY, Queue.VALUE)

    HIDDEN = ("credit_head", "credit_tail", "window_head", "window_tail", "timer_ms")
    COLUMNS = (
        "amount_in",
        "amount_out",
        "txn_in",
        "txn_out",
        "atm_out",
        "in_degree",
        "out_degree",
        "counterparties",
        "first_us",
        "last_us",
        "burst_10min",
        "matched",
        "late",
    )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "dir", "txn_id"])
        kept = (*self.COLUMNS, *self.HIDDEN)
        t = dict(zip(kept, self.totals.get(), strict=True)) if self.totals.exists() else dict.fromkeys(kept, 0)
        seen_before = t["txn_in"] + t["txn_out"] > 0
        old = batch["us"] < t["last_us"] if seen_before else pd.Series(False, index=batch.index)
        t["late"] += int(old.sum())
        self._count(t, batch, seen_before)
        holds = Counts(self.holds)
        if not old.all():
            self._order(t, batch[~old], holds)
        if self.idle_us is not None:
            if t["timer_ms"]:
                self.handle.deleteTimer(int(t["timer_ms"]))
            t["timer_ms"] = t["last_us"] // 1000 + 1
            self.handle.registerTimer(int(t["timer_ms"]))
        self.totals.update(tuple(int(t[c]) for c in kept))
        yield pd.DataFrame([{"account": key[0], **t, "median_hold_us": holds.median(t["matched"])}])[
            [c.split()[0] for c in FEATURE_ROW.split(", ")]
        ]

    def _count(self, t: dict, batch: pd.DataFrame, seen_before: bool) -> None:
        credit = batch["dir"] == "C"
        amount = batch["amount_paise"]
        t["amount_in"] += int(amount[credit].sum())
        t["amount_out"] += int(amount[~credit].sum())
        t["txn_in"] += int(credit.sum())
        t["txn_out"] += int((~credit).sum())
        t["atm_out"] += int(amount[~credit & (batch["channel"] == "ATM")].sum())
        first, last = int(batch["us"].iloc[0]), int(batch["us"].iloc[-1])
        t["first_us"] = min(t["first_us"], first) if seen_before else first
        t["last_us"] = max(t["last_us"], last) if seen_before else last
        for cp, d in batch[["counterparty", "dir"]].drop_duplicates().itertuples(index=False):
            known = self.partners.containsKey((cp,))
            sent, got = self.partners.getValue((cp,)) if known else (0, 0)
            if not known:
                t["counterparties"] += 1
            if d == "C" and not sent:
                t["in_degree"] += 1
                sent = 1
            if d == "D" and not got:
                t["out_degree"] += 1
                got = 1
            self.partners.updateValue((cp,), (sent, got))

    def _order(self, t: dict, batch: pd.DataFrame, holds: Counts) -> None:
        window = Queue(self.window, t["window_head"], t["window_tail"])
        waiting = Queue(self.credits, t["credit_head"], t["credit_tail"])
        for us, d in batch[["us", "dir"]].itertuples(index=False):
            window.push(int(us))
            while us - window.first() > BURST_US:
                window.pop()
            t["burst_10min"] = max(t["burst_10min"], len(window))
            if d == "C":
                waiting.push(int(us))
            elif len(waiting):
                holds.add(int(us) - waiting.pop())
                t["matched"] += 1
        holds.flush()
        t["window_head"], t["window_tail"], t["credit_head"], t["credit_tail"] = window.head, window.tail, waiting.head, waiting.tail

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The account has been idle for long enough: all of its state goes."""
        for state in (self.totals, self.partners, self.holds, self.credits, self.window):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def running_features(ledger_stream: DataFrame, idle: str | None = None) -> DataFrame:
    """Latest features of every account a micro-batch touches.

    ``idle``, like "90 days": how long after its last transfer an account is kept, by the time of transfers; transfers later
    than that behind the newest are then left out. By default accounts stay for good.
    """
    e = account_events(ledger_stream).select("account", "counterparty", "dir", "amount_paise", "us", "channel", "txn_id")
    timed = {"timeMode": "None"}
    processor = AccountFeatures()
    if idle is not None:
        e = e.withColumn("at", F.timestamp_micros("us")).withWatermark("at", idle)
        processor, timed = AccountFeatures(int(pd.Timedelta(idle).total_seconds() * 1_000_000)), {"timeMode": "EventTime"}
    return e.groupBy("account").transformWithStateInPandas(statefulProcessor=processor, outputStructType=FEATURE_ROW, outputMode="Update", **timed)


def burst_windows(ledger_stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Approximate bursts for dashboards: sliding ten-minute windows every minute, with a watermark."""
    e = account_events(ledger_stream).withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)
    return e.groupBy(F.window("at", "10 minutes", "1 minute"), "account").agg(F.count(F.lit(1)).alias("events"))


def activity_sessions(ledger: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Bursts of activity per account separated by quiet gaps."""
    e = account_events(ledger).withColumn("at", F.timestamp_micros("us"))
    s = e.groupBy(F.session_window("at", gap).alias("w"), "account").agg(F.count(F.lit(1)).alias("events"), F.sum("amount_paise").alias("amount_paise"))
    return s.select("account", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "events", "amount_paise")


def tumbling_activity(ledger: DataFrame, width: str = "1 hour") -> DataFrame:
    e = ledger.withColumn("at", F.timestamp_micros("us"))
    g = e.groupBy(F.window("at", width).alias("w"), "channel").agg(F.count(F.lit(1)).alias("transfers"), F.sum("amount_paise").alias("amount_paise"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "channel", "transfers", "amount_paise")


def touched_accounts(batch: DataFrame, links: DataFrame, new_links: DataFrame) -> DataFrame:
    """Accounts to score again: endpoints of the batch, and everyone on an identifier that changed."""
    ends = account_events(batch).select("account").distinct()
    changed = new_links.select("type", "identifier_id").distinct()
    users = links.join(changed, ["type", "identifier_id"], "left_semi").select("account")
    return ends.unionByName(users).distinct()


def with_co_users(accounts: DataFrame, links: DataFrame) -> DataFrame:
    """The accounts and everyone on an identifier of theirs."""
    keys = links.join(accounts, "account", "left_semi").select("type", "identifier_id").distinct()
    users = links.join(keys, ["type", "identifier_id"], "left_semi").select("account")
    return accounts.select("account").unionByName(users).distinct()


def worth_sending(scores: DataFrame, sent: DataFrame) -> DataFrame:
    """Scores never sent, changed by 0.02 or more, or in a new band. ``provisional`` below three transfers."""
    new = scores.withColumn("band", risk_band(F.col("v2_bp") / F.lit(10000.0)))
    old = sent.select("account", F.col("v2_bp").alias("old_bp"), F.col("band").alias("old_band"))
    j = new.join(old, "account", "left")
    send = F.col("old_bp").isNull() | (F.abs(F.col("v2_bp") - F.col("old_bp")) >= SCORE_CHANGE_BP) | (F.col("band") != F.col("old_band"))
    return j.where(send).select("account", "v2_bp", "band", (F.col("txns") < 3).alias("provisional"))


def discovery_due(crossed: bool, last_us: int | None, now_us: int, any_ring: bool, any_seed: bool) -> bool:
    """Run discovery when an account crossed the threshold, on the first seed, or every five minutes once rings exist."""
    if crossed or (last_us is None and any_seed):
        return True
    return last_us is not None and any_ring and now_us - last_us >= DISCOVER_EVERY_US


def payload_digest(ring_rows: dict[str, DataFrame]) -> DataFrame:
    """(ring_id, digest) of what is known about each ring: tables by name, each with ``ring_id``. Counts and sums of row
    hashes, so the order of rows does not matter and a large ring is summed in parts."""
    parts = []
    for name, df in ring_rows.items():
        rest = sorted(c for c in df.columns if c != "ring_id")
        parts.append(df.select("ring_id", F.xxhash64(F.lit(name), *[F.col(c) for c in rest]).cast("decimal(38,0)").alias("h")))
    rows = reduce(DataFrame.unionByName, parts).groupBy("ring_id").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("s"))
    return rows.select("ring_id", F.md5(F.concat_ws("|", "n", "s")).alias("digest"))


def ring_payload(members: DataFrame, ledger: DataFrame, accounts: DataFrame, links: DataFrame) -> DataFrame:
    """Digest of a ring's members, edges, roles and volume; not of its risk, which moves with every batch."""
    m = members.select("ring_id", "account")
    own = m.select("account").distinct()
    theirs = ledger.join(own.withColumnRenamed("account", "src"), "src", "left_semi").unionByName(
        ledger.join(own.withColumnRenamed("account", "dst"), "dst", "left_semi").join(own.withColumnRenamed("account", "src"), "src", "left_anti").select(ledger.columns)
    )
    theirs = cut_lineage(theirs)
    features = transaction_features(accounts.join(own, "account", "left_semi"), theirs)
    return payload_digest(
        {
            "members": m,
            "edges": rings.ring_edges(theirs, m),
            "roles": rings.classify_roles(theirs, m, links, features).select("ring_id", "account", "role"),
            "volume": rings.ring_volumes(theirs, m).select("ring_id", "volume_paise"),
        }
    )


class RingRegistry:
    """Ring ids that stay the same between discovery runs, kept as a log of changes in a shared folder.

    A community continues the known ring it overlaps most (at least half of the smaller set). Members are only added. A run
    appends the members it adds and one row per ring whose payload digest is new, with the next version; readers merge
    the log, and every ``tables.COMPACT_EVERY`` batches a run also writes the merged tables, from which later reads start.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.tables = BatchTables(spark, folder)

    def rings(self, before: int = 2**62) -> DataFrame | None:
        """(ring_id, version, first_seen_us, digest) as of a batch."""
        log = self.tables.log("rings", before)
        if log is None:
            return None
        last = F.max_by(F.struct("version", "first_seen_us", "digest"), "version").alias("r")
        return log.groupBy("ring_id").agg(last).select("ring_id", "r.*")

    def members(self, before: int = 2**62) -> DataFrame | None:
        """(ring_id, account, version, first_seen_us) as of a batch."""
        log = self.tables.log("members", before)
        return None if log is None else log.select("ring_id", "account").join(self.rings(before).drop("digest"), "ring_id")

    def update(self, batch_id: int, found: DataFrame, clock_us: int, payload: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Merge communities ``found(ring_id, account)``; returns the alerts of rings confirmed for the first time.

        ``payload(members)`` gives (ring_id, digest) of what a version stands for; by default the member set."""
        known = self.tables.log("members", batch_id)
        added = fresh = cut_lineage(found.select("ring_id", "account").distinct())
        everyone = fresh
        if known is not None:
            known = cut_lineage(known.select("ring_id", "account"))
            match = best_overlap(fresh.withColumnRenamed("ring_id", "left_id"), known.withColumnRenamed("ring_id", "right_id"))
            named = fresh.join(match.select(F.col("left_id").alias("ring_id"), "right_id"), "ring_id", "left")
            named = named.select(F.coalesce("right_id", "ring_id").alias("ring_id"), "account").distinct()
            added = cut_lineage(named.join(known, ["ring_id", "account"], "left_anti"))
            everyone = known.unionByName(added)
        digests = payload(everyone) if payload else payload_digest({"members": everyone})
        if known is None:
            now = digests.withColumns({"old": F.lit(None).cast("string"), "version": F.lit(0), "first_seen_us": F.lit(None).cast("bigint")})
        else:
            now = digests.join(self.rings(batch_id).withColumnRenamed("digest", "old"), "ring_id", "left")
        changed = now.where(F.col("old").isNull() | (F.col("old") != F.col("digest")))
        changed = cut_lineage(
            changed.select(
                "ring_id",
                (F.coalesce("version", F.lit(0)) + 1).cast("int").alias("version"),
                F.coalesce("first_seen_us", F.lit(clock_us)).cast("bigint").alias("first_seen_us"),
                "digest",
                F.col("old").isNull().alias("new"),
            )
        )
        alerts = cut_lineage(changed.where("new").select("ring_id", F.lit(clock_us).cast("bigint").alias("fired_us")))
        self.tables.write("members", batch_id, added)
        self.tables.write("rings", batch_id, changed.drop("new"))
        self.tables.write("alerts", batch_id, alerts)
        self._compact(batch_id)
        return alerts

    def _compact(self, batch_id: int) -> None:
        if self.tables.merge_due("rings", batch_id):
            self.tables.write("members_merged", batch_id, self.tables.log("members", batch_id + 1).select("ring_id", "account"))
            self.tables.write("rings_merged", batch_id, self.rings(batch_id + 1))


def discover_in_neighbourhood(ledger: DataFrame, accounts: DataFrame, links: DataFrame, scores: DataFrame) -> DataFrame:
    """Discovery on the surroundings of risky accounts with at least two transfers, not on the whole ledger.

    ``scores(account, v2_bp, txns)``.
    """
    seed = cut_lineage(scores.where((F.col("v2_bp") >= 5000) & (F.col("txns") >= 2)).select("account"))
    around = cut_lineage(graph.neighbourhood(ledger, links, seed))
    near = ledger.join(around.withColumnRenamed("account", "src"), "src", "left_semi").unionByName(
        ledger.join(around.withColumnRenamed("account", "dst"), "dst", "left_semi").join(
            around.withColumnRenamed("account", "src"), "src", "left_anti"
        )
    )
    return graph.discover_rings(
        accounts.join(around, "account", "left_semi"),
        near,
        links.join(links.join(around, "account", "left_semi").select("identifier_id").distinct(), "identifier_id", "left_semi"),
        scores.join(around, "account", "left_semi"),
    )


class LiveMonitor:
    """Scores, rings, alerts and traces after every batch of accepted transfers.

    ``score(accounts, ledger, links)`` gives (account, v2_bp, txns). Per batch: the transfers are stored; touched accounts
    and everyone who shares an identifier with them are scored anew over their and their co-users' stored transfers, so
    scores equal those of the whole ledger; scores that changed enough are sent; when an account crosses the
    threshold, or five minutes after the last time, rings are looked for around risky accounts and merged into the
    registry; rings confirmed for the first time raise an alert with its reason. Every batch moves the victims' money on
    (:class:`LiveTraces`) and writes a summary of the cases of known rings that changed, or of all of them after a
    search for rings. All of it is written under the batch id and read from earlier batches only, so a batch repeated after a
    restart gives the same tables.
    """

    def __init__(self, spark: SparkSession, folder: str, accounts: DataFrame, links: DataFrame, score: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]):
        self.spark, self.accounts, self.links, self.score = spark, accounts, links, score
        self.tables, self.registry = BatchTables(spark, f"{folder}/live"), RingRegistry(spark, f"{folder}/registry")
        self.traces = LiveTraces(spark, f"{folder}/traces", accounts)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        t = self.tables
        columns = ["txn_id", "src", "dst", "amount_paise", "ts", "us", "channel", "city", "lat", "lng"]
        stored = t.until("ledger", batch_id)
        # a transfer delivered again is stored once
        new = batch.select(columns).dropDuplicates(["txn_id"])
        if stored is not None:
            new = new.join(stored.select("txn_id"), "txn_id", "left_anti").select(columns)
        t.write("ledger", batch_id, new)
        ledger = t.until("ledger", batch_id + 1).drop("batch")
        clock = t.until("ledger", batch_id + 1).agg(F.max("us")).first()[0]
        if clock is None:
            return
        # a co-user's neighbour risk changes with the first score of an endpoint, so co-users are scored anew as well
        ends = cut_lineage(touched_accounts(new, self.links, self.links.limit(0)))
        mine = cut_lineage(with_co_users(ends, self.links))
        # what is read for that: the co-users of these, with all their transfers and opening times
        near = cut_lineage(with_co_users(mine, self.links))
        of_near = cut_lineage(
            ledger.join(near.withColumnRenamed("account", "src"), "src", "left_semi").select(columns)
            .unionByName(ledger.join(near.withColumnRenamed("account", "dst"), "dst", "left_semi").select(columns)).distinct()
        )
        fresh = cut_lineage(
            self.score(self.accounts.join(near, "account", "left_semi"), of_near, self.links).join(mine, "account", "left_semi").select("account", "v2_bp", "txns")
        )
        before = t.latest("scores", batch_id)
        now = fresh if before is None else fresh.unionByName(before.join(mine, "account", "left_anti"))
        t.write("scores", batch_id, now)
        sent = t.latest("sent", batch_id)
        nothing = self.spark.createDataFrame([], "account string, v2_bp long, band string")
        out = cut_lineage(worth_sending(fresh, nothing if sent is None else sent))
        t.write("updates", batch_id, out)
        keep = out.select("account", "v2_bp", "band")
        t.write("sent", batch_id, keep if sent is None else keep.unionByName(sent.join(keep.select("account"), "account", "left_anti").select("account", "v2_bp", "band")))
        moved = self.traces.update(batch_id, new, lambda: ledger)
        searched = self._discover(batch_id, clock, ledger, now, before)
        members = self.registry.members(batch_id + 1)
        if members is not None:
            t.write("traces", batch_id, self.case_summaries(members, None if searched else moved, batch_id + 1))

    def case_summaries(self, members: DataFrame, changed: DataFrame | None = None, before: int = 2**62) -> DataFrame:
        """Summaries of the cases whose deposit went to a ring member; only of ``changed(case_id)``, if given."""
        inside = self.traces.cases(before).join(members.select("account").distinct(), "account", "left_semi").select("case_id")
        if changed is not None:
            inside = inside.join(changed, "case_id", "left_semi")
        return taint.case_summary(self.traces.taints(before).join(inside, "case_id", "left_semi"))

    def _discover(self, batch_id: int, clock: int, ledger: DataFrame, scores: DataFrame, before: DataFrame | None) -> bool:
        t = self.tables
        risky = scores.where((F.col("v2_bp") >= 5000) & (F.col("txns") >= 2))
        was = None if before is None else before.where((F.col("v2_bp") >= 5000) & (F.col("txns") >= 2))
        crossed = not (risky if was is None else risky.join(was, "account", "left_anti")).isEmpty()
        runs = t.latest("runs", batch_id)
        last = None if runs is None else runs.first()["us"]
        known = self.registry.members(batch_id)
        if not discovery_due(crossed, last, clock, known is not None, not risky.isEmpty()):
            return False
        found = discover_in_neighbourhood(ledger, self.accounts, self.links, scores)
        alerts = self.registry.update(batch_id, found, clock, lambda m: ring_payload(m, ledger, self.accounts, self.links))
        members = self.registry.members(batch_id + 1)
        t.write("runs", batch_id, self.spark.createDataFrame([(clock,)], "us long"))
        if members is not None:
            members = cut_lineage(members.select("ring_id", "account"))
            t.write("alerts", batch_id, alert_summary(ledger, members.join(alerts.select("ring_id"), "ring_id", "left_semi"), alerts))
        return True


def run_monitor(lines: DataFrame, monitor: LiveMonitor, checkpoint: str, parse: Callable[[DataFrame], DataFrame] | None = None):
    """Start the stream that feeds a monitor with accepted transfers; it takes what is available, then stops."""
    from muletrace.sources.readers import fan_out

    good, _bad = valid_transactions(parse(lines) if parse else fan_out(lines, observed_lines)["txn"])
    return good.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(monitor).start()


def run_live(
    lines: DataFrame,
    out: str,
    checkpoint: str,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    parse: Callable[[DataFrame], DataFrame] | None = None,
    idle: str | None = None,
):
    """Start the feature stream: accepted rows update state, features go to ``out`` by batch id; ``idle`` as in
    :func:`running_features`.

    Rejects are written by :func:`run_rejects` on the same source. Uses everything available, then stops, so a drain
    is a restart; the checkpoint gives exactly-once state and batch ids give idempotent output.
    """
    from muletrace.sources.readers import fan_out

    txns = parse(lines) if parse else fan_out(lines, observed_lines)["txn"]
    good, _bad = valid_transactions(txns)

    def write(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if on_batch:
            on_batch(df, batch_id)

    features = running_features(good, idle)
    return features.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def run_rejects(lines: DataFrame, out: str, checkpoint: str):
    """Rejected transactions and unknown lines with their reasons; :class:`ingest.IngestCounts` counts them."""
    from muletrace.sources.readers import fan_out

    branches = fan_out(lines)
    _good, bad = split_valid(branches["txn"], ledger_rules(with_text_ts=True))
    rows = bad.select("txn_id", F.array_join("broken_rules", ",").alias("reason")).unionByName(
        branches["unknown"].select(F.lit(None).cast("string").alias("txn_id"), F.lit("unknown line").alias("reason"))
    )
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_features(spark: SparkSession, out: str) -> DataFrame:
    """Newest row per account over all written batches."""
    df = spark.read.parquet(f"{out}/batch=*")
    return df.groupBy("account").agg(F.max_by(F.struct(*[c for c in df.columns if c != "account"]), "batch_id").alias("r")).select("account", "r.*")


def alert_summary(ledger: DataFrame, members: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts of a batch with size, volume, reason and whether cash had already been taken."""
    sizes = members.groupBy("ring_id").agg(F.count(F.lit(1)).alias("members"))
    reason = F.concat(F.col("members").cast("string"), F.lit(" linked accounts forwarding within minutes"))
    alerts = alerts.join(sizes, "ring_id", "left").withColumn("reason", reason)
    named = alerts.withColumn("alert_id", F.concat(F.lit("LIVE-"), F.col("ring_id")))
    eta = rings.cashout_eta(ledger, members, named).select("ring_id", "before_cashout")
    return named.join(rings.ring_volumes(ledger, members), "ring_id", "left").join(eta, "ring_id")
