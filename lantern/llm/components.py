"""Connected components of an edge table, without a driver-side union-find.

Two rewritings alternate until nothing changes: every vertex links its larger neighbours to the smallest
vertex it knows, then its smaller neighbours. Each round is two aggregations and two joins on vertex
identifiers. Both sides of a join are tables written to the shared folder, so Spark broadcasts the smaller one if its
measured size allows and else parts a hub's rows (skew join); an aggregation combines them first. Lineage stays
short, a lost executor costs one step at most, and what a later step has replaced is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, int(row.h or 0)


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(u, v) long pairs in any order to (id, component_id) for every vertex of an edge; component_id is the smallest id reachable."""
    edges = common.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        # larger neighbours to the smallest of the neighbourhood
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = common.written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "components")
        up = common.written(both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "components")
        # the vertex itself and its smaller neighbours to the smallest of these
        least = common.written(up.groupBy("u").agg(F.min("v").alias("m")), "components")
        down = up.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, old = state, edges
        edges = common.written(down, "components")
        common.forget(old, smallest, up, least)
        state = _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components haven't settled in {most_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).distinct()
