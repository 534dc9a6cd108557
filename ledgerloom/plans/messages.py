"""Messages along edges, round after round, where a few vertices have a large share of all edges.

Edges of a hub are dealt out over all tasks and stay there; what a hub sends is broadcast to them. Hubs have
more than ``HUB`` edges and more than one in ``HUBS`` of all, so fewer than ``HUBS`` rows are broadcast, whatever the
graph's size. Other edges are dealt out by their source once, and meet what it sends there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.fixpoint import HUB, HUBS, cut


@dataclass(frozen=True)
class Messages:
    """Materialised edges (src, dst, ...): those of hubs apart, if there are any."""

    few: DataFrame
    many: DataFrame | None = None
    hubs: DataFrame | None = None

    def sent(self, values: DataFrame, key: str = "id") -> DataFrame:
        """Every edge with the columns of ``values`` (one row for each key) at its source; edges without one get none."""
        values = values.withColumnRenamed(key, "src")
        one = self.few.join(values, "src")
        if self.many is None:
            return one
        return one.unionByName(self.many.join(F.broadcast(values.join(F.broadcast(self.hubs), "src", "left_semi")), "src"))

    def kept(self, values: DataFrame, *columns, key: str = "id") -> Messages:
        """The same edges, dealt out alike, with ``columns`` made from their own and those of ``values``."""
        own = lambda part: cut(Messages(part, None, None).sent(values, key).select("src", "dst", *columns))
        if self.many is None:
            return Messages(own(self.few))
        sent = values.withColumnRenamed(key, "src").join(F.broadcast(self.hubs), "src", "left_semi")
        many = cut(self.many.join(F.broadcast(sent), "src").select("src", "dst", *columns))
        return Messages(own(self.few), many, self.hubs)

    def edges(self) -> DataFrame:
        return self.few if self.many is None else self.few.unionByName(self.many)


def messages(edges: DataFrame, hub: int = HUB, hubs: int = HUBS) -> Messages:
    """``edges(src, dst, ...)`` ready to be sent along."""
    degree = cut(edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg")))
    total = degree.agg(F.sum("deg")).first()[0] or 0
    large = degree.where(F.col("deg") > max(hub, total // hubs)).select("src")
    if large.isEmpty():
        return Messages(cut(edges.repartition("src")))
    few = cut(edges.join(F.broadcast(large), "src", "left_anti").repartition("src"))
    many = cut(edges.join(F.broadcast(large), "src", "left_semi").repartition("src", "dst"))
    return Messages(few, many, large)
