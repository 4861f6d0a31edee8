"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialis.llm.common import partitions, staged

#: Edges that a task takes, and tasks at least.
TASK_EDGES, LEAST_TASKS = 200_000, 8


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    Each round joins every neighbour of a node to the smallest of them, until all nodes hang on roots. The
    minima are written before the join, so a node with very many edges is a skewed join that Spark splits,
    not one task. A round makes no more edges than there are edges and nodes, and gets tasks by their count.
    """
    now = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    n = now.count()
    while True:
        tasks = min(partitions(now.sparkSession), max(LEAST_TASKS, -(-n // TASK_EDGES)))
        write = lambda df, name: staged(df.coalesce(tasks), name)
        now = now.coalesce(tasks)
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).coalesce(tasks)
        n, open_nodes = ends.agg(F.sum("up"), F.count_if(F.expr("up > 1 or up > 0 and down > 0"))).first()
        if not open_nodes:  # each node has one edge, to a node that has none: a star for each component
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = write(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        least = write(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        now = write(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
