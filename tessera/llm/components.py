"""Connected components of a table of links, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """links(a, b): pairs of long ids, any order, repeats and loops allowed. Returns node, component: each id in a link
    between different ids, with the smallest id it reaches.

    Each round hooks every node to the smallest id near it (a map-side combined minimum, so a hub costs one row per
    task), follows that pointer once, and contracts the links; the number of rounds grows with the logarithm of the
    longest path. Every round is stored in the shared folder."""
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        hooked = stored(near.select("node", F.least("node", "low").alias("parent")), "hooked")
        up = hooked.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        step = stored(hooked.join(up, "parent").select("node", F.col("grand").alias("component")), "step")
        if found is None:
            found = step
        else:
            onward = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
            found = stored(found.join(onward, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "found")
        links = (
            links.join(step.select(F.col("node").alias("a"), F.col("component").alias("x")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        links = stored(links, "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")) if found is None else found
