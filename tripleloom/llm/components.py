"""Connected components by joins, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.session import materialise, shuffled

#: Rounds double the reach of a label; more than this many mean an error, not a longer graph.
ROUNDS = 200


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the least id reachable from each node of ``nodes`` (id) over ``edges`` (a, b).

    Labels spread by joins and pointer jumping until none changes; a graph that does not
    settle raises an error. Nodes without edges are their own root. Nothing is collected.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("way")
    both = materialise(edges.where("a != b").select(ways).select("way.a", "way.b").distinct(), "component-edges")
    state = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("root"))
    state = materialise(state, "component-roots")
    for _ in range(ROUNDS):
        lower = both.join(shuffled(state.withColumnRenamed("id", "b")), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        spread = state.join(shuffled(lower), "id").select("id", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = state.select(F.col("id").alias("root"), F.col("root").alias("top"))
        following = materialise(spread.join(shuffled(jump), "root", "left").select("id", F.least("root", F.coalesce("top", "root")).alias("root"), "was"), "component-roots")
        state = following.select("id", "root")
        if following.where("root < was").limit(1).count() == 0:
            return nodes.select("id").join(shuffled(state), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    raise RuntimeError(f"the components did not settle in {ROUNDS} rounds")
