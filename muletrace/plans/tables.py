"""The composed tables most queries start from."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muletrace.operators import events as ev
from muletrace.operators import features, scoring
from muletrace.session import cut_lineage
from muletrace.sources import derived


@dataclass
class Tables:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def ledger(self) -> DataFrame:
        return derived.ledger(self.spark, self.sf_dir)

    @cached_property
    def accounts(self) -> DataFrame:
        return derived.accounts(self.spark, self.sf_dir)

    @cached_property
    def links(self) -> DataFrame:
        return derived.identifier_links(self.spark, self.sf_dir)

    @cached_property
    def hits(self) -> DataFrame:
        return derived.hits(self.spark, self.sf_dir)

    @cached_property
    def members(self) -> DataFrame:
        return derived.planted_members(self.spark, self.sf_dir)

    @cached_property
    def truth(self) -> DataFrame:
        return derived.ground_truth(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        return ev.account_events(self.ledger)

    @cached_property
    def v1(self) -> DataFrame:
        return scoring.rule_score_v1(features.transaction_features(self.accounts, self.ledger))

    @cached_property
    def money(self) -> DataFrame:
        """Money features, written once for scores and roles."""
        return cut_lineage(features.transaction_features(self.accounts, self.ledger))

    @cached_property
    def matrix(self) -> DataFrame:
        return features.feature_matrix(self.accounts, self.ledger, self.links, scoring.rule_score_v1, money=self.money)

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.with_risk(scoring.rule_score_v2(self.matrix))

    def scores(self) -> DataFrame:
        return self.scored.select("account", "v1_bp", "v2_bp", "risk_v1", "risk_v2")


def rounded(c: str, digits: int):
    return F.round(F.col(c), digits).alias(c)
