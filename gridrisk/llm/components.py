"""Connected components of a table of links, by alternating min-label hooking and pointer jumping.

Each round every node takes the least label among itself and its neighbours' labels, then labels jump to their own
labels. Rounds are tables in the shared folder, so no plan grows and a lost executor costs one round. Chains halve with
every jump, so rounds grow with the logarithm of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """links: a, b (longs). One row (node, label, ...) per node that has a link to another; label is the least node of its
    component. Self-links and repeated links change nothing."""
    links = links.where("a <> b").select("a", "b")
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select("node", "label"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.select("node", "label").join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        # The least label that any node of a label has found becomes that label's own: whole trees hook at once.
        roots = hooked.groupBy(F.col("was").alias("tree")).agg(F.min("next").alias("root"))
        moved = hooked.join(roots, F.col("next") == F.col("tree"), "left").select("node", F.least("next", F.coalesce("root", "next")).alias("label"), "was")
        moved = stored(moved, "labels")
        changed = not moved.where("label <> was").isEmpty()
        discard(labels)
        labels = moved
        if not changed:
            discard(both)
            return labels
