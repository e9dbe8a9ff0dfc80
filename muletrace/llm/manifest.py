"""Merkle manifest of a dataset, its trees kept as nested intervals of leaf ranks. DataFrame functions only.

Leaves are ranked by source and id over the whole table: a range partition, and every partition's offset. A node covers an
interval [lo, hi) of ranks. A level is grouped from the one below, sixteen neighbouring intervals into one that covers
them, so a level is a sixteenth of the last and no group holds more than sixteen rows, however large a source is. A
second tree of the same kind stands on the roots of the sources, with ranks of sources in place of ranks of leaves.

Ancestors are attached from the top down by containment: a node and its parent on the next level share a bucket of that
level's width, and the parent's interval covers the node's. Which siblings a node has follows from interval difference:
they cover what is left of the parent's interval without the node's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muletrace.llm.base import cut_lineage

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:string,right:string>"


def sha(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' text in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Of a row: every field as its byte count, a colon and its text; ``-`` where it is missing."""
    said = [c.cast("string") for c in fields.values()]
    return sha(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in said])


def ranked(df: DataFrame, order: list, group: str) -> DataFrame:
    """``df`` with ``rank``, its place in the whole order from 0, and ``group_lo``, ``group_hi``, ``group_no``: the ranks that
    its group covers and the group's own place. ``order`` must keep a group's rows together; ``group`` is a column.

    Only counts per partition and group are looked at beside the range partition, and the rows meet them by partition and
    group, so that a large group stays spread.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    runs = dealt.groupBy("pid", group).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # one row per partition
    totals = runs.groupBy("pid").agg(F.sum("n").alias("total"), F.min("first").alias("start"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("offset", F.coalesce(F.sum("total").over(before), F.lit(0).cast("long")))
    runs = runs.join(F.broadcast(totals), "pid")
    lo = F.col("offset") + F.col("first") - F.col("start")
    runs = cut_lineage(runs.select("pid", F.col(group).alias("g"), "start", "offset", "n", lo.alias("run_lo")))
    # one row per group; a group has one run at most per partition
    groups = runs.groupBy("g").agg(F.min("run_lo").alias("group_lo"), F.max(F.col("run_lo") + F.col("n")).alias("group_hi"), F.min(F.struct("run_lo", "pid")).alias("head"))
    groups = groups.withColumn("home", F.col("head.pid")).drop("head")
    new = groups.groupBy("home").agg(F.count(F.lit(1)).alias("starts"))
    new = new.withColumn("earlier", F.coalesce(F.sum("starts").over(Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    nth = F.row_number().over(Window.partitionBy("home").orderBy("group_lo")) - 1
    groups = groups.join(F.broadcast(new), "home").withColumn("group_no", F.col("earlier") + nth).drop("home", "earlier", "starts")
    placed = runs.join(groups.withColumnRenamed("g", "same"), F.col("g").eqNullSafe(F.col("same"))).drop("same")
    here = dealt.withColumnRenamed("pid", "p")
    joined = here.join(placed, (F.col("p") == F.col("pid")) & F.col(group).eqNullSafe(F.col("g")))
    rank = F.col("offset") + F.col("at") - F.col("start")
    return joined.withColumn("rank", rank).drop("p", "pid", "at", "g", "start", "offset", "n", "run_lo")


def _above(nodes: DataFrame, width: int) -> DataFrame:
    """The next level over ``nodes(tree_lo, tree_hi, lo, hi, digest, ...)``, its nodes ``width`` ranks wide, for trees that are
    wider than a node so far. ``children`` hold the nodes below, in order, with all they carry."""
    child = [c for c in nodes.columns if c not in ("tree_lo", "tree_hi")]
    grown = nodes.where(F.col("tree_hi") - F.col("tree_lo") > width // FAN)
    nth = F.floor((F.col("lo") - F.col("tree_lo")) / width)
    up = grown.groupBy("tree_lo", "tree_hi", nth.alias("nth")).agg(F.sort_array(F.collect_list(F.struct(*child))).alias("children"))
    return up.select(
        "tree_lo",
        "tree_hi",
        F.get("children", F.lit(0))["lo"].alias("lo"),
        F.element_at("children", -1)["hi"].alias("hi"),
        sha(F.array_join(F.col("children.digest"), "")).alias("digest"),
        "children",
    )


def _step(children: Column, lo: Column, hi: Column) -> Column:
    """The siblings of the node [lo, hi): what its parent covers without it, before and behind."""
    said = lambda some: F.array_join(F.transform(some, lambda c: c["digest"]), "")
    left, right = F.filter(children, lambda c: c["hi"] <= lo), F.filter(children, lambda c: c["lo"] >= hi)
    return F.struct(said(left).alias("left"), said(right).alias("right"))


def _whole(width: int) -> Column:
    """Whether a node of a level ``width`` wide is the root of its tree."""
    return F.col("tree_hi") - F.col("tree_lo") <= width


def grow(leaves: DataFrame, widest: int) -> list[DataFrame]:
    """All levels over ``leaves(tree_lo, tree_hi, lo, hi, digest, ...)``, the leaves first; no tree has more than ``widest``."""
    levels, width = [leaves], 1
    while width < widest:
        width *= FAN
        below = levels[-1]
        if len(levels) > 1:
            below = below.drop("children")
        levels.append(cut_lineage(_above(below, width)))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree_lo, tree_hi, digest): the root of every tree."""
    tops = [n.where(_whole(FAN**k)).select("tree_lo", "tree_hi", "digest") for k, n in enumerate(levels)]
    # a tree of one leaf is whole on level 0, and nothing of it is on the next; larger ones likewise
    return reduce(DataFrame.unionByName, tops)


def with_path(levels: list[DataFrame], beyond: DataFrame, lowest: int) -> list[DataFrame]:
    """Levels ``lowest`` and up, top down, each node with ``path``: sibling steps from itself to its root and on through
    ``beyond(tree_lo, path, ...)``, whose other columns come along."""
    more = [c for c in beyond.columns if c not in ("tree_lo", "path")]
    out: dict[int, DataFrame] = {}
    for k in range(len(levels) - 1, lowest - 1, -1):
        nodes, width = levels[k], FAN ** (k + 1)
        found = nodes.where(_whole(FAN**k)).join(beyond, "tree_lo")
        if k + 1 < len(levels):
            ends = F.array_distinct(F.array(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))
            parents = out[k + 1].select(F.col("lo").alias("over_lo"), F.col("hi").alias("over_hi"), "children", "path", *more, F.explode(ends).alias("bucket"))
            parents = parents.withColumnsRenamed({"children": "beside", "path": "on"})
            inside = (F.col("over_lo") <= F.col("lo")) & (F.col("hi") <= F.col("over_hi"))
            held = nodes.where(~_whole(FAN**k)).withColumn("bucket", F.floor(F.col("lo") / width)).join(parents, "bucket").where(inside)
            path = F.concat(F.array(_step(F.col("beside"), F.col("lo"), F.col("hi"))), F.col("on"))
            held = held.withColumn("path", path).drop("bucket", "over_lo", "over_hi", "beside", "on")
            found = found.unionByName(held)
        out[k] = found
    return [out[k] for k in sorted(out)]


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to, given the siblings on its way."""
    return F.aggregate(path, start, lambda at, s: sha(s["left"], at, s["right"]))


def manifest(leaves: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified): one row per row of ``leaves(doc_id, source, leaf, shown)``.

    ``leaf`` is the digest of the row as recorded, ``shown`` that of the row as it is now shown. Per source the leaves
    ascend by id; runs of 16 become one node until one is left, the source's ``subroot``; the subroots, by source, likewise
    give ``root``. ``proof`` lists the siblings before and behind on every level up to the root; ``folded_root`` is what
    ``shown`` leads to with them, ``verified`` whether that is the root.

    A missing source is a source of its own, the first; a missing id comes first, equal ids are ordered by leaf, and equal
    rows each have a leaf. An empty table gives an empty result.
    """
    rows = cut_lineage(leaves.select("doc_id", "source", "leaf", "shown", F.monotonically_increasing_id().alias("tie")))
    placed = ranked(rows, ["source", "doc_id", "leaf", "tie"], "source")
    base = placed.select(
        F.col("group_lo").alias("tree_lo"),
        F.col("group_hi").alias("tree_hi"),
        F.col("rank").alias("lo"),
        (F.col("rank") + 1).alias("hi"),
        F.col("leaf").alias("digest"),
        "group_no",
        "doc_id",
        "shown",
    )
    base = cut_lineage(base)
    widest, sources = base.agg(F.max(F.col("tree_hi") - F.col("tree_lo")), F.max("group_no") + 1).first()
    low = grow(base, widest or 1)
    numbers = base.where(F.col("lo") == F.col("tree_lo")).select("tree_lo", "group_no")
    tops = roots(low).join(numbers, "tree_lo").select(
        F.lit(0).cast("long").alias("tree_lo"),
        F.lit(sources or 0).cast("long").alias("tree_hi"),
        F.col("group_no").alias("lo"),
        (F.col("group_no") + 1).alias("hi"),
        "digest",
        F.col("tree_lo").alias("source_lo"),
    )
    high = grow(cut_lineage(tops), sources or 1)
    root = roots(high).select("digest").first()
    nothing = leaves.sparkSession.range(1).select(F.lit(0).cast("long").alias("tree_lo"), F.array().cast(f"array<{STEP}>").alias("path"))
    above = with_path(high, nothing, 0)[0].select(F.col("source_lo").alias("tree_lo"), "path", F.col("digest").alias("subroot"))
    single = with_path(low[:1], above, 0)[0].select("doc_id", "digest", "shown", "subroot", F.col("path").alias("proof"))
    found = single
    if len(low) > 1:
        pages = with_path(low, above, 1)[0]
        proof = lambda c: F.concat(F.array(_step(F.col("children"), c["lo"], c["hi"])), F.col("path"))
        each = F.transform("children", lambda c: F.struct(c["doc_id"].alias("doc_id"), c["digest"].alias("digest"), c["shown"].alias("shown"), proof(c).alias("proof")))
        found = found.unionByName(pages.select("subroot", F.inline(each)))
    done = found.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(root.digest if root else None).cast("string").alias("root"),
        "proof",
        folded(F.col("shown"), F.col("proof")).alias("folded_root"),
    )
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
