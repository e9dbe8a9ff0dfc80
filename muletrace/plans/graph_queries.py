"""Queries on the candidate graph, found rings, matching and evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from muletrace.operators import evaluate, graph, matching, rings
from muletrace.operators.communities import communities
from muletrace.plans import sqlviews
from muletrace.plans.registry import query
from muletrace.plans.tables import Tables
from muletrace.session import cut_lineage

sqlviews.define("seedv", "SELECT account FROM scored WHERE v2_bp >= CASE WHEN (SELECT max(v2_bp) FROM scored)>=5000 THEN 5000 ELSE 3000 END")
sqlviews.define(
    "ringlike",
    """SELECT "type", identifier_id, count(*) FILTER (s.account IS NOT NULL) flagged, count(*) users FROM links l LEFT JOIN seedv s ON s.account=l.account GROUP BY 1,2
       HAVING count(*) FILTER (s.account IS NOT NULL)>=2 AND 2*count(*) FILTER (s.account IS NOT NULL)>=count(*)""",
)
sqlviews.define(
    "cand",
    """SELECT account FROM seedv UNION SELECT l.dst FROM ledger l JOIN seedv s ON s.account=l.src JOIN scored k ON k.account=l.dst AND k.v2_bp>=2000
       UNION SELECT l.src FROM ledger l JOIN seedv s ON s.account=l.dst JOIN scored k ON k.account=l.src AND k.v2_bp>=2000
       UNION SELECT l.account FROM links l JOIN ringlike USING("type", identifier_id)""",
)
sqlviews.define(
    "mpairs",
    """SELECT least(src,dst) a, greatest(src,dst) b, CAST(sum(amount_paise) AS BIGINT) total FROM ledger JOIN cand x ON x.account=src JOIN cand y ON y.account=dst WHERE src<>dst GROUP BY 1,2""",
)
sqlviews.define("medges", "SELECT a, b, total, least(total/greatest((SELECT median(total) FROM mpairs),1e0),3e0) weight FROM mpairs")
sqlviews.define(
    "stars",
    """SELECT concat("type",'|',identifier_id) star, account, count(*) OVER (PARTITION BY "type", identifier_id) size FROM links JOIN ringlike USING("type", identifier_id) JOIN cand USING(account)
       QUALIFY count(*) OVER (PARTITION BY "type", identifier_id)>=2""",
)
sqlviews.STORED.update({"scored", "cand", "ringlike"})


def _graph(t: Tables):
    scores = cut_lineage(t.scores())
    seed = cut_lineage(graph.seeds(scores))
    inside = cut_lineage(graph.candidates(t.accounts, t.ledger, t.links, scores, seed))
    return scores, seed, inside


@query("ring_seeds", "SELECT account FROM seedv")
def ring_seeds(spark, d):
    return graph.seeds(cut_lineage(Tables(spark, d).scores()))


@query("ring_like_identifiers", 'SELECT "type", identifier_id, flagged, users FROM ringlike')
def ring_like_identifiers(spark, d):
    t = Tables(spark, d)
    return graph.ring_like_identifiers(t.links, graph.seeds(cut_lineage(t.scores())))


@query("ring_candidates", "SELECT account FROM cand")
def ring_candidates(spark, d):
    return _graph(Tables(spark, d))[2]


@query(
    "seed_neighbourhood",
    """SELECT account FROM (SELECT account FROM seedv UNION SELECT dst FROM ledger JOIN seedv ON account=src UNION SELECT src FROM ledger JOIN seedv ON account=dst
       UNION SELECT l.account FROM links l JOIN links m ON m.identifier_id=l.identifier_id JOIN seedv s ON s.account=m.account) WHERE account LIKE 'ACC%'""",
)
def seed_neighbourhood(spark, d):
    t = Tables(spark, d)
    return graph.neighbourhood(t.ledger, t.links, cut_lineage(graph.seeds(cut_lineage(t.scores()))))


@query("ring_graph_money_edges", "SELECT a, b, total, round(weight,6) weight FROM medges")
def ring_graph_money_edges(spark, d):
    t = Tables(spark, d)
    m = graph.money_edges(t.ledger, _graph(t)[2])
    return m.withColumn("weight", F.round("weight", 6))


@query("ring_graph_identity_stars", "SELECT star, account, size FROM stars")
def ring_graph_identity_stars(spark, d):
    t = Tables(spark, d)
    _s, seed, inside = _graph(t)
    return graph.identity_stars(t.links, graph.ring_like_identifiers(t.links, seed), inside)


@query(
    "ring_graph_degrees",
    """SELECT account, round(sum(w),5) degree FROM (SELECT a account, weight w FROM medges UNION ALL SELECT b, weight FROM medges
       UNION ALL SELECT x.account, 1e0 FROM stars x JOIN stars y ON x.star=y.star AND x.account<>y.account) GROUP BY 1""",
)
def ring_graph_degrees(spark, d):
    t = Tables(spark, d)
    _s, seed, inside = _graph(t)
    stars = graph.identity_stars(t.links, graph.ring_like_identifiers(t.links, seed), inside)
    return graph.weighted_degrees(graph.money_edges(t.ledger, inside), stars).withColumn("degree", F.round("degree", 5))


@query(
    "identity_components",
    """WITH RECURSIVE one AS (SELECT 1), dl AS (SELECT * FROM links WHERE "type" IN ('device')),
     r(account, root) AS (SELECT account, account FROM (SELECT DISTINCT account FROM dl) UNION
       SELECT r.account, y.account FROM r JOIN dl x ON x.account=r.root JOIN dl y ON y.identifier_id=x.identifier_id AND y.account<r.account)
     SELECT account, min(root) component FROM r GROUP BY 1""",
)
def identity_components(spark, d):
    """Accounts connected by devices, directly or through others; devices are nodes, not cliques."""
    dev = Tables(spark, d).links.where(F.col("type") == "device")
    pairs = dev.select(F.concat(F.lit("a:"), "account").alias("a"), F.concat(F.lit("s:"), "identifier_id").alias("b"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    c = graph.connected_components(nodes, pairs).where(F.col("node").startswith("a:"))
    return c.select(F.expr("substring(node, 3)").alias("account"), F.expr("substring(component, 3)").alias("component"))


@query(
    "money_components",
    """WITH RECURSIVE one AS (SELECT 1), e AS (SELECT DISTINCT src a, dst b FROM ledger WHERE src LIKE 'ACC%' AND dst LIKE 'ACC%'), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
     r(account, seen) AS (SELECT account, account FROM accounts UNION SELECT r.account, g.b FROM r JOIN g ON g.a=r.seen)
     SELECT account, min(seen) component FROM r GROUP BY 1""",
)
def money_components(spark, d):
    t = Tables(spark, d)
    real = F.col("src").startswith("ACC") & F.col("dst").startswith("ACC")
    e = t.ledger.where(real).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    c = graph.connected_components(t.accounts.select(F.col("account").alias("node")), e)
    return c.withColumnRenamed("node", "account")


# Merges and moves until nothing changes; ``lab`` has the labels of every round.
_COMMUNITIES = """
me AS MATERIALIZED (SELECT a, b, CAST(round(weight*1000000) AS BIGINT) w FROM medges WHERE CAST(round(weight*1000000) AS BIGINT)>0),
st AS MATERIALIZED (SELECT star, account, size FROM stars),
deg AS MATERIALIZED (SELECT account, CAST(sum(w) AS HUGEINT) deg FROM (SELECT a account, w FROM me UNION ALL SELECT b, w FROM me UNION ALL SELECT account, (size-1)*1000000 FROM st) GROUP BY 1),
tot AS MATERIALIZED (SELECT CAST(sum(deg) AS HUGEINT) t FROM deg),
lab(round, account, c) AS (
  SELECT 0, account, account FROM deg
  UNION ALL
  SELECT round+1, account, c FROM (
    WITH now AS (SELECT l.round, l.account, l.c, deg.deg FROM lab l JOIN deg USING(account)),
    k AS (SELECT c, CAST(sum(deg) AS HUGEINT) k, any_value(round) round FROM now GROUP BY 1),
    paid AS (SELECT least(x.c,y.c) c, greatest(x.c,y.c) d, sum(w) w FROM me JOIN now x ON x.account=a JOIN now y ON y.account=b WHERE x.c<>y.c GROUP BY 1,2),
    onn AS (SELECT star, c, count(*) n FROM st JOIN now USING(account) GROUP BY 1,2),
    tops AS (SELECT star, c top FROM onn QUALIFY row_number() OVER (PARTITION BY star ORDER BY n DESC, c DESC)=1),
    near AS (SELECT c, d FROM paid UNION SELECT least(c,top), greatest(c,top) FROM onn JOIN tops USING(star) WHERE c<>top),
    wt AS (SELECT c, d, CAST(sum(w) AS HUGEINT) w FROM (SELECT * FROM paid UNION ALL SELECT q.c, q.d, x.n*y.n*1000000 FROM near q JOIN onn x ON x.c=q.c JOIN onn y ON y.c=q.d AND y.star=x.star) GROUP BY 1,2),
    gains AS (SELECT wt.c, wt.d, x.k kc, y.k kd, (SELECT t FROM tot)*w-x.k*y.k gain, md5(concat(wt.c,'|',wt.d)) tie, x.round FROM wt JOIN k x ON x.c=wt.c JOIN k y ON y.c=wt.d WHERE (SELECT t FROM tot)*w-x.k*y.k>0),
    pick AS (SELECT * FROM (SELECT c, d "to", kc, kd, gain, tie, round FROM gains UNION ALL SELECT d, c, kd, kc, gain, tie, round FROM gains) QUALIFY row_number() OVER (PARTITION BY c ORDER BY gain DESC, tie DESC)=1),
    asked AS (SELECT p.*, q."to"=p.c mutual FROM pick p JOIN pick q ON q.c=p."to"),
    wanted AS (SELECT DISTINCT "to" c FROM asked WHERE NOT mutual),
    roles AS (SELECT *, CASE WHEN mutual THEN kc<kd OR (kc=kd AND c<"to") ELSE c NOT IN (SELECT c FROM wanted) OR md5(concat(c,'|',round))[1]<'8' END joins FROM asked),
    ready AS (SELECT c, "to", gain, kc, kd, length(CAST(gain AS VARCHAR))*100+CAST(CAST(gain AS VARCHAR)[1:2] AS INT) cl, md5(concat(c,'|',"to")) dg FROM roles WHERE joins AND "to" IN (SELECT c FROM roles WHERE NOT joins)),
    beside AS (SELECT c, sum(n*coalesce(ahead,0))*1000000 shared FROM (SELECT r.c, o.n, sum(o.n) OVER (PARTITION BY r."to", o.star ORDER BY cl DESC, dg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ahead FROM ready r JOIN onn o ON o.c=r.c) GROUP BY 1),
    eager AS (SELECT r.*, gain+(SELECT t FROM tot)*CAST(coalesce(shared,0) AS HUGEINT)-kc*CAST(coalesce(sum(kc) OVER (PARTITION BY "to" ORDER BY cl DESC, dg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS HUGEINT) rest FROM ready r LEFT JOIN beside USING(c)),
    taken AS MATERIALIZED (SELECT c, "to" FROM eager QUALIFY sum(CASE WHEN rest<=0 THEN 1 ELSE 0 END) OVER (PARTITION BY "to" ORDER BY cl DESC, dg ROWS UNBOUNDED PRECEDING)=0),
    apaid AS (SELECT e.account, o.c "to", sum(w) w FROM (SELECT a account, b other, w FROM me UNION ALL SELECT b, a, w FROM me) e JOIN now o ON o.account=other GROUP BY 1,2),
    anear AS (SELECT account, "to" FROM apaid UNION SELECT account, top FROM st JOIN tops USING(star) UNION SELECT account, c FROM now),
    awt AS (SELECT account, "to", CAST(sum(w) AS HUGEINT) w FROM (SELECT * FROM apaid UNION ALL SELECT q.account, o.c, (o.n-CASE WHEN z.c=o.c THEN 1 ELSE 0 END)*1000000 FROM anear q JOIN st ON st.account=q.account JOIN onn o ON o.star=st.star AND o.c=q."to" JOIN now z ON z.account=q.account) GROUP BY 1,2),
    asks AS (SELECT q.account, q."to", now.c mine, now.deg ka, (SELECT t FROM tot)*(q.w-coalesce(s.w,0))-now.deg*(x.k-y.k+now.deg) gain FROM awt q JOIN now ON now.account=q.account LEFT JOIN awt s ON s.account=q.account AND s."to"=now.c
      JOIN k x ON x.c=q."to" JOIN k y ON y.c=now.c WHERE q."to"<>now.c),
    best AS (SELECT *, md5(concat(account,'|',"to")) dg FROM asks WHERE gain>0 QUALIFY row_number() OVER (PARTITION BY account ORDER BY gain DESC, md5(concat(account,'|',"to")) DESC)=1),
    pair AS (SELECT mine, "to", max(gain) gain, md5(concat(mine,'|',"to")) tie FROM best GROUP BY 1,2),
    ppick AS (SELECT * FROM (SELECT mine c, gain, tie FROM pair UNION ALL SELECT "to", gain, tie FROM pair) QUALIFY row_number() OVER (PARTITION BY c ORDER BY gain DESC, tie DESC)=1),
    agreed AS (SELECT mine, "to" FROM pair JOIN ppick x ON x.c=mine AND x.tie=pair.tie JOIN ppick y ON y.c="to" AND y.tie=pair.tie),
    swap AS (SELECT b.*, length(CAST(gain AS VARCHAR))*100+CAST(CAST(gain AS VARCHAR)[1:2] AS INT) cl FROM best b JOIN agreed USING(mine, "to")),
    srest AS (SELECT *, gain-2*ka*CAST(coalesce(sum(ka) OVER (PARTITION BY mine, "to" ORDER BY cl DESC, dg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS HUGEINT) rest FROM swap),
    moved AS MATERIALIZED (SELECT account, "to" FROM srest QUALIFY sum(CASE WHEN rest<=0 THEN 1 ELSE 0 END) OVER (PARTITION BY mine, "to" ORDER BY cl DESC, dg ROWS UNBOUNDED PRECEDING)=0)
    SELECT now.round, now.account, CASE WHEN EXISTS (SELECT 1 FROM taken) THEN coalesce(taken."to", now.c) ELSE coalesce(moved."to", now.c) END c
    FROM now LEFT JOIN taken ON taken.c=now.c LEFT JOIN moved ON moved.account=now.account WHERE EXISTS (SELECT 1 FROM taken) OR EXISTS (SELECT 1 FROM moved)
  )
),
labels AS MATERIALIZED (SELECT account, min(account) OVER (PARTITION BY c) community FROM lab WHERE round=(SELECT max(round) FROM lab))"""


@query("ring_communities", f"WITH RECURSIVE {_COMMUNITIES} SELECT account, community FROM labels")
def ring_communities(spark, d):
    """Communities of the whole candidate graph."""
    t = Tables(spark, d)
    _s, seed, inside = _graph(t)
    stars = graph.identity_stars(t.links, graph.ring_like_identifiers(t.links, seed), inside)
    return communities(graph.money_edges(t.ledger, inside), stars)


# A stored score table: known members of rings between 0.55 and 0.95, others up to 0.45, by account number. The views of
# the candidate graph are defined over it a second time.
sqlviews.define(
    "scored2",
    """SELECT account, CASE WHEN account IN (SELECT account FROM truth) THEN 5500+TRY_CAST(substr(account,4) AS INT)*97%40*100 ELSE TRY_CAST(substr(account,4) AS INT)*61%45*100 END v2_bp FROM accounts""",
)
_OVER_STORED = {n: n + "2" for n in ("scored", "seedv", "ringlike", "cand", "mpairs", "medges", "stars")}


def _over_stored(sql: str) -> str:
    return re.sub(r"\b(" + "|".join(_OVER_STORED) + r")\b", lambda m: _OVER_STORED[m[0]], sql)


for _name in list(_OVER_STORED)[1:]:
    sqlviews.define(_OVER_STORED[_name], _over_stored(sqlviews.VIEWS[_name]))
sqlviews.STORED.update({"scored2", "cand2", "ringlike2"})


def _stored_scores(t: Tables):
    no = F.expr("cast(substring(account, 4) as int)")
    known = t.truth.select("account").distinct().withColumn("known", F.lit(True))
    bp = F.when(F.col("known"), 5500 + no * 97 % 40 * 100).otherwise(no * 61 % 45 * 100)
    return t.accounts.select("account").join(known, "account", "left").select("account", bp.cast("bigint").alias("v2_bp"))


def _rings_sql(floor: float) -> str:
    return f"""{_COMMUNITIES},
      kept AS (SELECT l.account, l.community, k.v2_bp FROM labels l JOIN scored k USING(account) WHERE k.v2_bp>=3000 OR l.account IN (SELECT account FROM st)),
      good AS (SELECT community, min(account) f, avg(v2_bp) m FROM kept GROUP BY 1 HAVING count(*)>=3 AND avg(v2_bp)>={floor}*10000),
      found AS (SELECT concat('RING-', f) ring_id, account, round(m/10000e0,4) risk FROM kept JOIN good USING(community))"""


def _found(t: Tables):
    return graph.discover_rings(t.accounts, t.ledger, t.links, _stored_scores(t))


@query("rings_discovered", _over_stored(f"WITH RECURSIVE {_rings_sql(0.6)} SELECT ring_id, account, risk FROM found"))
def rings_discovered(spark, d):
    """Rings among accounts with stored scores."""
    return _found(Tables(spark, d))


@query("rings_by_rule", f"WITH RECURSIVE {_rings_sql(0.5)} SELECT ring_id, account, risk FROM found")
def rings_by_rule(spark, d):
    """Rings by the rule score, which rarely gives a whole ring 0.6; so a mean of 0.5 is asked for."""
    t = Tables(spark, d)
    return graph.discover_rings(t.accounts, t.ledger, t.links, t.scores(), min_mean_risk=0.5)


@query(
    "rings_discovered_summary",
    _over_stored(
        f"""WITH RECURSIVE {_rings_sql(0.6)}, flow AS (SELECT x.ring_id, sum(amount_paise) v, count(*) n FROM ledger JOIN found x ON x.account=src JOIN found y ON y.account=dst AND y.ring_id=x.ring_id GROUP BY 1)
        SELECT ring_id, count(*) members, CAST(coalesce(any_value(v),0) AS BIGINT) volume_paise, coalesce(any_value(n),0) transfers, round(sum(v2_bp)/CAST(count(*) AS DOUBLE)/10000e0,4) risk
        FROM found JOIN scored USING(account) LEFT JOIN flow USING(ring_id) GROUP BY 1"""
    ),
)
def rings_discovered_summary(spark, d):
    t = Tables(spark, d)
    found = cut_lineage(_found(t))
    return rings.ring_summary(t.ledger, found.select("ring_id", "account"), cut_lineage(_stored_scores(t)))


def _ap(col: str) -> str:
    return f"""(SELECT round(sum(tp*ctp/CAST(cn AS DOUBLE))/sum(tp),4) FROM (SELECT tp, sum(tp) OVER (ORDER BY s DESC) ctp, sum(n) OVER (ORDER BY s DESC) cn FROM
      (SELECT {col} s, sum(CASE WHEN account IN (SELECT account FROM truth) THEN 1 ELSE 0 END) tp, count(*) n FROM scored GROUP BY 1)))"""


@query("pr_auc", f"SELECT {_ap('v2_bp')} pr_auc")
def pr_auc(spark, d):
    t = Tables(spark, d)
    return evaluate.average_precision(evaluate.labelled(t.scores(), t.truth), "risk_v2")


def _recall_sql(col: str) -> str:
    return f"""(SELECT round(count(*) FILTER ({col}>=5000)/CAST(count(*) AS DOUBLE),4) FROM scored WHERE account IN (SELECT account FROM truth)) ring_recall,
      (SELECT round(count(*) FILTER ({col}>=5000)/CAST(count(*) AS DOUBLE),4) FROM scored WHERE account IN (SELECT account FROM truth WHERE pattern='D')) pattern_d_recall"""


@query(
    "model_metrics",
    f"SELECT 'V1 transaction only' model, {_ap('v1_bp')} pr_auc, {_recall_sql('v1_bp')} UNION ALL SELECT 'V2 with identity', {_ap('v2_bp')}, {_recall_sql('v2_bp')}",
)
def model_metrics(spark, d):
    t = Tables(spark, d)
    return evaluate.metrics_table(cut_lineage(t.scores()), t.truth, {"V1 transaction only": "risk_v1", "V2 with identity": "risk_v2"})


@query(
    "account_degrees",
    "SELECT account, count(*) degree, round(sqrt(1e0+0.3e0*(count(*)-1)),6) display_weight FROM (SELECT src account FROM ledger UNION ALL SELECT dst FROM ledger) GROUP BY 1",
)
def account_degrees(spark, d):
    return graph.account_degrees(Tables(spark, d).ledger)
