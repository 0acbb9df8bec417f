"""Propagation of tags between agents: ordered edges to paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_edges(edges: DataFrame, tags: DataFrame) -> DataFrame:
    """Edges (tag_id, ord, src, dst) of registered tags only."""
    return edges.join(tags.select("tag_id").distinct(), "tag_id", "left_semi")


def paths(edges: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag_id, path, hops): from the origin, each edge adds its source unless it is last already, then its target."""
    start = tags.groupBy("tag_id").agg(F.min("origin_agent").alias("origin"))
    hops = known_edges(edges, tags).groupBy("tag_id").agg(F.array_sort(F.collect_list(F.struct("ord", "src", "dst"))).alias("e"))

    def stops(e, i):
        last = F.when(i == 0, F.col("origin")).otherwise(F.get("e", i - 1)["dst"])
        return F.when(last == e["src"], F.array(e["dst"])).otherwise(F.array(e["src"], e["dst"]))

    rows = start.join(hops, "tag_id", "left")
    path = F.when(F.col("e").isNull(), F.array("origin")).otherwise(F.concat(F.array("origin"), F.flatten(F.transform("e", stops))))
    return rows.select("tag_id", path.alias("path"), F.coalesce(F.size("e"), F.lit(0)).alias("hops"))


def register(tags: DataFrame, order: str) -> DataFrame:
    """The last registration of each tag."""
    rest = [c for c in tags.columns if c != "tag_id"]
    return tags.groupBy("tag_id").agg(F.max_by(F.struct(*rest), order).alias("t")).select("tag_id", "t.*")
