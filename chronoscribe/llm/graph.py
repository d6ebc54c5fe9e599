"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoscribe.llm import common


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b); the component is its least node.

    Each round takes the least component among a node's neighbours and then the component of that component, so
    distances halve at least; it ends when nothing changes. Runs jobs; nothing is gathered."""
    both = common.cut(links.select("a", "b").union(links.select("b", "a")).toDF("node", "near").distinct())
    at = common.cut(both.groupBy("node").agg(F.least("node", F.min("near")).alias("component")))
    while True:
        near = both.join(at.select(F.col("node").alias("near"), "component"), "near").groupBy("node").agg(F.min("component").alias("least"))
        new = at.join(near, "node").select("node", F.least("component", "least").alias("component"), F.col("component").alias("old"))
        new = common.cut(new)
        up = new.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        new = common.cut(new.join(up, "component").select("node", F.least("higher", "component").alias("component"), "old"))
        at = new.select("node", "component")
        if new.filter("component < old").isEmpty():
            return at
