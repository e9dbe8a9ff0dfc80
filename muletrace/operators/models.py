"""Trained scores: boosted trees, isolation forest, explanations, persistence."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muletrace.functions.exprs import signal_label
from muletrace.operators import evaluate
from muletrace.operators.attribution import attributed_signals, attributions
from muletrace.operators.features import V1_FEATURES, V2_FEATURES, feature_matrix
from muletrace.operators.scoring import blend, normalised_anomaly, top_signals
from muletrace.operators.snapshots import SNAPSHOT_DAYS, labelled_rows, snapshot_features, snapshot_money
from muletrace.session import cut_counting, cut_lineage, ensure_checkpoint_dir

# Settings of the trained models.
TREES, DEPTH, STEP = 200, 4, 0.1
ISOLATION_TREES, ISOLATION_SAMPLE = 200, 256
# Sizes that choose a way: rows of a training task, and most of them where there are more than tasks run at a time.
ROWS_PER_TASK, MOST_ROWS_PER_TASK = 20_000, 500_000


def with_class_weight(df: DataFrame) -> DataFrame:
    """Positives weigh max(1, negatives // positives)."""
    w = df.agg(
        F.greatest(F.lit(1), F.floor(F.count_if(F.col("label") == 0) / F.greatest(F.count_if(F.col("label") == 1), F.lit(1))))
    ).scalar()
    return df.withColumn("weight", F.when(F.col("label") == 1, w.cast("double")).otherwise(F.lit(1.0)))


def train(df: DataFrame, columns: list[str], trees: int = TREES) -> PipelineModel:
    """Boosted trees on ``columns`` with ``label``; the distributed trainer reads one row per account.

    Every tree is as many jobs as it is deep, over rows of a few hundred bytes, so tasks get ``ROWS_PER_TASK`` rows or the
    session's parallelism is used; more and smaller tasks cost a fixed time each in some two thousand jobs."""
    data, n = cut_counting(with_class_weight(df.na.fill(0).select(*columns, F.col("label").cast("double").alias("label"))), F.lit(True))
    tasks = min(max(1, -(-n // ROWS_PER_TASK)), max(data.sparkSession.sparkContext.defaultParallelism, -(-n // MOST_ROWS_PER_TASK)))
    data = data.coalesce(tasks)
    gbt = GBTClassifier(labelCol="label", featuresCol="v", weightCol="weight", maxIter=trees, maxDepth=DEPTH, stepSize=STEP, seed=42)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="v"), gbt]).fit(data)


def probability(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    p = model.transform(df.na.fill(0))
    return p.withColumn(out, vector_to_array("probability")[1]).drop("v", "rawPrediction", "probability", "prediction")


# ---- isolation forest ---------------------------------------------------------------------------------------------


def isolation_samples(df: DataFrame, columns: list[str], trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, features): up to ``sample`` rows per tree, drawn by hash so every run draws the same rows.

    A row is offered to about trees * sample / rows trees, so the offered rows stay near trees * sample at any scale.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    offers = F.least(F.lit(trees), F.ceil(F.lit(1.3 * trees * sample) / F.greatest(total, F.lit(1)))).cast("int")
    keep = F.pmod(F.xxhash64("account", F.lit(seed)), F.lit(1_000_000)) / F.lit(1e6) < F.lit(1.3 * trees * sample) / total
    offered = df.where(keep).select("account", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.explode(F.sequence(F.lit(1), offers)).alias("i"))
    spread = F.when(offers >= trees, F.col("i") - 1).otherwise(F.pmod(F.xxhash64("account", "i", F.lit(seed + 1)), F.lit(trees)))
    placed = offered.select("account", "x", spread.cast("int").alias("tree")).dropDuplicates(["account", "tree"])
    w = W.partitionBy("tree").orderBy(F.xxhash64("account", "tree", F.lit(seed + 2)), "account")
    return placed.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= sample).select("tree", "account", "x")


def _grow(pdf: pd.DataFrame) -> pd.DataFrame:
    """One isolation tree as flat arrays: feature (-1 for a leaf), threshold, children, rows in the leaf."""
    tree = int(pdf["tree"].iloc[0])
    x = np.stack(pdf.sort_values("account")["x"].to_numpy())
    rng = np.random.default_rng(1000 + tree)
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1.0, 0.0, -1.0, -1.0, float(len(rows))])
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth < limit and len(rows) > 1 and len(usable):
            f = int(rng.choice(usable))
            cut = float(rng.uniform(lo[f], hi[f]))
            left = x[rows, f] <= cut
            a, b = split(rows[left], depth + 1), split(rows[~left], depth + 1)
            nodes[at] = [float(f), cut, float(a), float(b), float(len(rows))]
        return at

    split(np.arange(len(x)), 0)
    return pd.DataFrame({"tree": [tree], "sample": [len(x)], "nodes": [[float(v) for n in nodes for v in n]]})


def _average_path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    big = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


FOREST = "tree int, sample int, nodes array<double>"


def grow_forest(
    df: DataFrame, columns: list[str] = V1_FEATURES, trees: int = ISOLATION_TREES, sample: int = ISOLATION_SAMPLE, seed: int = 42
) -> DataFrame:
    """(tree, sample, nodes): isolation trees, one group each, from at most ``sample`` rows. A table like any other, to be
    kept and applied to other rows."""
    df = df.na.fill(0, subset=columns)
    return isolation_samples(df, columns, trees, sample, seed).groupBy("tree").applyInPandas(_grow, FOREST)


def forest_scores(df: DataFrame, forest: DataFrame, columns: list[str] = V1_FEATURES) -> DataFrame:
    """Adds ``iso_raw`` (higher is more ordinary) by a grown forest, which has at most trees x 2 x sample nodes."""
    df = df.na.fill(0, subset=columns)
    trees = [(r["sample"], np.array(r["nodes"]).reshape(-1, 5)) for r in forest.orderBy("tree").collect()]
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[columns].to_numpy(dtype=float)
            depth = np.zeros(len(x))
            for _n, nodes in shared.value:
                at = np.zeros(len(x), dtype=int)
                steps = np.zeros(len(x))
                while True:
                    f = nodes[at, 0].astype(int)
                    inner = f >= 0
                    if not inner.any():
                        break
                    left = x[np.arange(len(x)), np.maximum(f, 0)] <= nodes[at, 1]
                    at = np.where(inner, np.where(left, nodes[at, 2], nodes[at, 3]), at).astype(int)
                    steps += inner
                depth += steps + _average_path(nodes[at, 4])
            norm = _average_path(max(n for n, _ in shared.value)) if shared.value else 1.0
            yield pdf.assign(iso_raw=-(2.0 ** (-depth / max(len(shared.value), 1) / max(float(norm), 1e-9))))

    return df.mapInPandas(score, _with_field(df))


def isolation_scores(
    df: DataFrame, columns: list[str] = V1_FEATURES, trees: int = ISOLATION_TREES, sample: int = ISOLATION_SAMPLE, seed: int = 42
) -> DataFrame:
    """``iso_raw`` of rows by a forest grown on these rows."""
    df = cut_lineage(df)
    return forest_scores(df, grow_forest(df, columns, trees, sample, seed), columns)


def _with_field(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", iso_raw double"


# ---- two-pass scoring ---------------------------------------------------------------------------------------------


@dataclass
class Detector:
    """What scoring needs: both models, the forest with the bounds of its scores in training, the columns."""

    v1: PipelineModel
    v2: PipelineModel
    forest: DataFrame
    bounds: tuple[float, float]
    v1_columns: list[str] = field(default_factory=lambda: list(V1_FEATURES))
    v2_columns: list[str] = field(default_factory=lambda: list(V2_FEATURES))


def by_model(v1: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """A scorer for the feature matrix: the first model's probability as ``v1_bp``, from which neighbour risk is taken."""
    return lambda df: probability(v1, df, "p1").withColumn("v1_bp", F.round(F.col("p1") * 10000).cast("bigint"))


def train_detector(
    accounts: DataFrame,
    ledger: DataFrame,
    links: DataFrame,
    truth: DataFrame,
    days: tuple[int, ...] = SNAPSHOT_DAYS,
    trees: int = TREES,
) -> Detector:
    """First model on the money features of the snapshots; second on all features, neighbour risk by the first one; the
    forest on the same rows, with the bounds of its scores. Called with later data it retrains."""
    money = snapshot_money(accounts, ledger, days)  # read for both models
    base = cut_lineage(labelled_rows(money, V1_FEATURES, ledger, truth))
    v1 = train(base, V1_FEATURES, trees)
    full = snapshot_features(accounts, ledger, links, truth, by_model(v1), days, money)
    v2 = train(full, V2_FEATURES, trees)
    rows = cut_lineage(base.select(F.concat_ws("|", "day", "account").alias("account"), *V1_FEATURES))
    forest = cut_lineage(grow_forest(rows))
    low, high = forest_scores(rows, forest).agg(F.min("iso_raw"), F.max("iso_raw")).first()
    return Detector(v1, v2, forest, (low, high))


def detect(detector: Detector, accounts: DataFrame, ledger: DataFrame, links: DataFrame) -> DataFrame:
    """Scores of all accounts: first model, neighbour risk from it, second model, anomaly, combined risk."""
    matrix = feature_matrix(accounts, ledger, links, by_model(detector.v1), geo=False).select("account", *detector.v2_columns)
    return score_accounts(cut_lineage(matrix), detector)


def evaluate_on(detector: Detector, accounts: DataFrame, ledger: DataFrame, links: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of quality for each of the three scores."""
    scores = cut_lineage(detect(detector, accounts, ledger, links))
    return evaluate.metrics_table(
        scores, truth, {"V1 transaction only": "risk_v1", "V2 with identity": "risk_v2", "Combined with anomaly": "risk_combined"}
    )


def score_accounts(df: DataFrame, detector: Detector) -> DataFrame:
    """Probabilities of both models, anomaly, combined risk; four decimals for risks, six for probabilities."""
    s = forest_scores(df, detector.forest, detector.v1_columns)
    s = probability(detector.v2, probability(detector.v1, s, "p1"), "p2")
    s = normalised_anomaly(s, "iso_raw", detector.bounds)
    return s.select(
        *df.columns,
        F.round("p1", 4).alias("risk_v1"),
        F.round("p2", 4).alias("risk_v2"),
        F.round("anomaly", 4).alias("anomaly_score"),
        blend(F.col("p1"), F.col("p2"), F.col("anomaly")).alias("risk_combined"),
        F.round("p1", 6).alias("prob_v1"),
        F.round("p2", 6).alias("prob_v2"),
    )


def gain_signals(model: PipelineModel, columns: list[str] = V2_FEATURES) -> Column:
    """Top-three explanation from the model's own feature weights."""
    weights = model.stages[-1].featureImportances.toArray()
    total = max(float(weights.sum()), 1e-9)
    items = [
        F.struct(F.lit(round(float(w) / total, 4)).alias("weight"), F.lit(c).alias("feature"), signal_label(c, F.col(c)).alias("label"))
        for c, w in zip(columns, weights, strict=True)
    ]
    return top_signals(F.array(*items))


def explain(detector: Detector, accounts: DataFrame, ledger: DataFrame, links: DataFrame, floor: float = 0.5) -> DataFrame:
    """(account, risk_combined, signals): for accounts of at least ``floor`` the three features that raised the second model's
    margin most, by exact Shapley values."""
    ensure_checkpoint_dir(ledger.sparkSession)
    folder = f"{ledger.sparkSession.sparkContext.getCheckpointDir()}/tables/{uuid4().hex}"
    matrix = feature_matrix(accounts, ledger, links, by_model(detector.v1), geo=False).select("account", *detector.v2_columns)
    flagged = score_accounts(cut_lineage(matrix), detector).where(F.col("risk_combined") >= floor)
    told = attributions(detector.v2, flagged.select("account", "risk_combined", *detector.v2_columns), folder, detector.v2_columns)
    return told.select("account", "risk_combined", attributed_signals(detector.v2_columns).alias("signals"))


# ---- persistence --------------------------------------------------------------------------------------------------


def fingerprint(training: DataFrame) -> DataFrame:
    """One row naming the training data: schema hash, row count, order-free content hash."""
    schema = F.lit(training.schema.simpleString())
    content = F.sum(F.pmod(F.xxhash64(*training.columns), F.lit(2**40)))
    return training.agg(F.md5(F.max(schema)).alias("schema_hash"), F.count(F.lit(1)).alias("rows"), content.alias("content"))


def save_detector(detector: Detector, training: DataFrame, folder: str) -> None:
    """Models, forest, bounds and columns, with the fingerprint of the training data."""
    detector.v1.write().overwrite().save(f"{folder}/v1")
    detector.v2.write().overwrite().save(f"{folder}/v2")
    detector.forest.write.mode("overwrite").parquet(f"{folder}/forest")
    rest = [(*map(float, detector.bounds), detector.v1_columns, detector.v2_columns)]
    training.sparkSession.createDataFrame(rest, "low double, high double, v1 array<string>, v2 array<string>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/rest")
    fingerprint(training).coalesce(1).write.mode("overwrite").parquet(f"{folder}/fingerprint")


def load_detector(spark: SparkSession, folder: str, training: DataFrame) -> Detector | None:
    """The stored detector, or None when it was trained on other data."""
    if spark.read.parquet(f"{folder}/fingerprint").first() != fingerprint(training).first():
        return None
    r = spark.read.parquet(f"{folder}/rest").first()
    models = (PipelineModel.load(f"{folder}/{n}") for n in ("v1", "v2"))
    return Detector(*models, spark.read.parquet(f"{folder}/forest"), (r.low, r.high), list(r.v1), list(r.v2))
