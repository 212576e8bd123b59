"""Connected components of a table of links, by contraction.

Every round hooks each node to its smallest neighbour, follows two pointers and rewrites the
links between the nodes that are left; at least half of them go in each round. Rows move in
joins and partial aggregates only: links are never collected, and no node's neighbours meet in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, publish


def components(links: DataFrame) -> DataFrame:
    """links(u long, v long) -> (node long, comp long): comp is one node of the component, the same for all of it."""
    links = publish(links.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), "links")
    both = links.union(links.select("v", "u")).toDF("u", "v")
    found = both.select(F.col("u").alias("node")).distinct().withColumn("comp", F.col("node"))
    first = True
    while not links.isEmpty():
        both = links.select("u", "v").union(links.select("v", "u"))
        hook = publish(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "hook")
        two = join_hot(hook, hook.select(F.col("u").alias("p"), F.col("p").alias("next")), ["p"]).select("u", F.col("next").alias("p"))
        two = publish(two, "hooks")
        renamed = two.select(F.col("u").alias("comp"), "p")
        found = two.select(F.col("u").alias("node"), F.col("p").alias("comp")) if first else join_hot(found, renamed, ["comp"], "left").select("node", F.coalesce("p", "comp").alias("comp"))
        found = publish(found, "components")
        first = False
        left = two.select(F.col("u").alias("x"), F.col("p").alias("px"))
        right = two.select(F.col("u").alias("y"), F.col("p").alias("py"))
        links = links.join(left, F.col("u") == F.col("x")).join(right, F.col("v") == F.col("y"))
        links = publish(links.where("px <> py").select(F.least("px", "py").alias("u"), F.greatest("px", "py").alias("v")).distinct(), "links")
    return found
