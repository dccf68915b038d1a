"""Connected components of a link table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(links: DataFrame, space: Workspace) -> DataFrame:
    """``links`` (a, b) to (node, component): the smallest node reachable, by nodes that have a link.

    Each round takes the least label among a node's neighbours, then follows that label's own
    label, until nothing changes; a path of n nodes takes about log n rounds. Every round is
    written to the shared folder. Nulls and self-links are ignored; no links give no rows.
    """
    pairs = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = space.stow(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = space.stow(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        step = step.join(up, "component").select("node", "was", F.least("component", "up").alias("component"))
        step = space.stow(step, "labels")
        changed = step.where("was <> component").limit(1).count()
        space.drop(labels)
        labels = step.select("node", "component")
        if not changed:
            space.drop(both)
            return labels
