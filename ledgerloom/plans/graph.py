"""A payment graph as named frames, and the order in which its parts are built."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import features, flow, graph, identity


@dataclass(frozen=True)
class PaymentGraph:
    """Immutable: every derived part is a new frame. ``accounts(id)``, ``ledger``, ``owners``, ``identities``, ``pii``."""

    accounts: DataFrame
    ledger: DataFrame
    owners: DataFrame
    identities: DataFrame
    pii: DataFrame
    bin_days: int = flow.BIN_DAYS

    @cached_property
    def flows(self) -> DataFrame:
        return flow.has_paid(self.ledger, self.bin_days)

    @cached_property
    def edges(self) -> DataFrame:
        return flow.account_edges(self.flows)

    @cached_property
    def matches(self) -> DataFrame:
        return identity.party_matches(self.pii)

    @cached_property
    def entities(self) -> DataFrame:
        return identity.resolved_entities(self.pii.select("party").distinct(), self.matches)

    def account_attributes(self) -> DataFrame:
        """All attributes written back to every account, defaults where an account has none."""
        d = self.accounts.join(graph.pagerank(self.edges), "id", "left").na.fill(0.0, ["pagerank"])
        for more in (graph.wcc(self.accounts, self.edges), graph.aa_degree(self.accounts, self.edges), graph.triangles(self.accounts, self.edges),
                     flow.money_flow(self.accounts, self.flows), flow.temporal_features(self.accounts, self.flows), identity.identity_sharing(self.accounts, self.owners, self.identities)):
            d = d.join(more, "id")
        d = d.withColumnsRenamed({"in_txns": "in_txn_count", "out_txns": "out_txn_count"})
        return d if "is_external" in d.columns else d.withColumn("is_external", F.lit(0))

    def account_features(self) -> DataFrame:
        return features.account_features(self.account_attributes())

    def edge_features(self) -> DataFrame:
        spec = flow.temporal_spec(self.flows)
        return features.edge_features(self.flows, self.flows.agg(F.max("last_ts")), spec["bins"])
