"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); a component is named by its least node.

    Each round gives a node the least name among its neighbours and then the name that its new name
    has, so paths shrink by half; every round is written out.  Joins are between tables read from
    files, so that hot keys are split at run time; counts of links meet in partial aggregates.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    names = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "names")
    while True:
        heard = both.join(names.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("heard"))
        stepped = cut(names.join(heard, "node").select("node", "component", F.least("component", "heard").alias("least")), "step")
        jumped = stepped.select("node", F.col("component").alias("was"), F.col("least").alias("via")).join(stepped.select(F.col("node").alias("via"), F.col("least").alias("end")), "via")
        names = cut(jumped.select("node", F.least("via", "end").alias("component"), "was"), "names")
        changed = names.where("component <> was").limit(1).count()
        names = names.select("node", "component")
        if not changed:
            return names
