"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _with_least(edges: DataFrame, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` with the least neighbour ``m`` of ``u``, as ``of`` has it.  The least ones
    are written first: then both sides of the join are dealt out for it alone, and
    Spark can split a hub's rows over tasks."""
    least = common.staged(of.groupBy("u").agg(F.min("v").alias("m")), "least")
    return edges.join(least.hint("merge"), "u"), least


def _round(edges: DataFrame) -> DataFrame:
    """Edges point from the larger ``u`` to the smaller ``v``."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, least = _with_least(both.filter("v > u"), both)
    large = common.staged(joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v")), "large")
    hung, less = _with_least(large, large)
    small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(less.select("u", F.col("m").alias("v")))
    out = common.staged(small.filter("u <> v").distinct(), "edges")
    common.discard(least, large, less)
    return out


def _settled(edges: DataFrame) -> bool:
    """Every node has one edge down, and none that is pointed at has any."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    state = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return state.agg(F.count_if((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0] == 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u long, v long)`` to ``(node, label)``, the label being the smallest
    node of the component; nodes without an edge have no row.  A round's edges are
    written to the shared folder, so lineage stays short, and the last round's go."""
    now = common.staged(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        if _settled(now):
            break
        before, now = now, _round(now)
        common.discard(before)
    else:
        raise RuntimeError("components did not settle")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
