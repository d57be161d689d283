"""Connected components of links between document ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has a link.

    links: (a, b). Each round every id takes the smallest label among its own,
    its neighbours' and that of the id its label names, so long chains halve.
    A hub's neighbours meet in partial sums, never in one list. Each round is
    written to the shared folder. Null ids and loops are left out.
    """
    real = links.select("a", "b").where(F.col("a") != F.col("b"))
    edges = materialize(real.unionAll(real.select(F.col("b").alias("a"), F.col("a").alias("b"))).dropDuplicates(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")), "labels")
    while True:
        offered = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("offer"))
        nearer = labels.join(offered, "id").select("id", F.col("component").alias("was"), F.least("component", "offer").alias("near"))
        nearer = materialize(nearer, "near")
        named = nearer.select(F.col("id").alias("near"), F.col("near").alias("jump"))
        following = materialize(nearer.join(named, "near").select("id", "was", F.least("near", "jump").alias("component")), "labels")
        changed = following.where(F.col("was") != F.col("component")).limit(1).count()
        labels = following.select("id", "component")
        if not changed:
            return labels
