"""Queries of the export forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from muletrace.operators import export, freeze, taint
from muletrace.plans.case_queries import _freeze_sql, _traced
from muletrace.plans.registry import query
from muletrace.plans.ring_queries import _roles
from muletrace.plans.tables import Tables
from muletrace.session import cut_lineage


def _rupees(paise: str) -> str:
    return f"CAST(round_even(greatest({paise},0)/100e0,0) AS BIGINT)"


@query(
    "export_accounts",
    f"""SELECT account, bank, home_city, opened_on, {_rupees("opening_balance_paise")} opening_balance, coalesce(risk_v1,0) risk_v1, coalesce(risk_v2,0) risk_v2, ring_id,
       CASE role WHEN 'coordinator' THEN 'controller' WHEN 'relay' THEN 'mule' ELSE role END role, role_reason
       FROM accounts LEFT JOIN (SELECT account, round(v1_bp/10000e0,4) risk_v1, round(v2_bp/10000e0,4) risk_v2 FROM scored) USING(account) LEFT JOIN roles USING(account)""",
)
def export_accounts(spark, d):
    t = Tables(spark, d)
    return export.accounts(t.accounts, t.scores(), _roles(t))


@query("export_rings", f"SELECT ring_id, members, {_rupees('volume_paise')} volume, risk FROM ring_summary")
def export_rings(spark, d):
    t = Tables(spark, d)
    return export.ring_totals(t.ledger, t.members, t.scores())


@query("export_ring_edges", f"SELECT ring_id, src, dst, {_rupees('CAST(sum(amount_paise) AS BIGINT)')} amount, count(*) transfers FROM internal GROUP BY 1,2,3")
def export_ring_edges(spark, d):
    t = Tables(spark, d)
    return export.ring_edges(t.ledger, t.members)


@query("export_taint_cases", f"WITH RECURSIVE one AS (SELECT 1) SELECT case_id, {_rupees('victim_amount')} victim_amount, {_rupees('lost_to_cash')} lost_to_cash, holders FROM tsum")
def export_taint_cases(spark, d):
    return export.taint_cases(taint.case_summary(_traced(Tables(spark, d))[1]))


@query("export_taint_accounts", f"WITH RECURSIVE one AS (SELECT 1) SELECT case_id, account, {_rupees('balance')} balance, {_rupees('tainted')} tainted, {_rupees('lien')} lien FROM tacc")
def export_taint_accounts(spark, d):
    return export.taint_accounts(taint.case_accounts(_traced(Tables(spark, d))[1]))


@query("export_taint_links", f"""WITH RECURSIVE one AS (SELECT 1) SELECT case_id, src, dst, {_rupees('"value"')} "value" FROM tflow""")
def export_taint_links(spark, d):
    return export.taint_links(_traced(Tables(spark, d))[2])


_PLAN = _freeze_sql()


@query("export_freeze", _PLAN.replace("b.risk at_risk_before, s.secured,", f"{_rupees('b.risk')} at_risk_before, {_rupees('s.secured')} secured,"))
def export_freeze(spark, d):
    t = Tables(spark, d)
    cases, balances, _f = _traced(t)
    plans = export.freeze_plans(freeze.recommend(t.ledger, cases, t.members, balances, k=3))
    return plans.withColumn("frozen", F.array_join("frozen", ","))


@query("secured_if_excluded", "WITH RECURSIVE one AS (SELECT 1) SELECT case_id, CAST(sum(tainted) AS BIGINT) secured FROM tacc JOIN scored USING(account) WHERE v2_bp>=5000 GROUP BY 1")
def secured_if_excluded(spark, d):
    """What the accounts at high risk hold of each case, had they been frozen."""
    t = Tables(spark, d)
    held = cut_lineage(taint.case_accounts(_traced(t)[1]))
    frozen = held.join(t.scores().where(F.col("v2_bp") >= 5000).select("account"), "account", "left_semi").select("case_id", "account")
    return taint.secured_if_excluded(held, frozen)
