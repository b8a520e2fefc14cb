"""Connected components of a link table, without the driver ever seeing a link."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .scratch import cut, forget


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node of ``edges``.

    Rows (node, component), a row for every node that occurs in a link.  Each
    round points a node to the smallest of its neighbours and itself, follows
    these pointers to their ends, and puts the ends in the place of the nodes of
    the links.  Links within an end are done with, so that each link is read once
    and at most half of the nodes come to the next round; rounds end when no link
    is left.  Minima are combined before each shuffle, so that a hub costs a
    row per task, and joins on hubs are left to the adaptive skew join.  Links
    with a null end and loops are ignored; repeated links count once.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    links = cut(_distinct(links))
    home = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        end = _ends(cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("c"))))
        of = lambda name: end.select(F.col("node").alias(name), F.col("c").alias(f"{name}c"))
        seen = Observation()
        rest = links.join(of("v"), "v").join(of("u"), "u").select(F.col("uc").alias("u"), F.col("vc").alias("v"))
        rest = cut(_distinct(rest).observe(seen, F.count("*").alias("n")))
        forget(links)
        links = rest
        if home is None:
            home = end
        else:
            was, home = home, cut(home.join(end.select(F.col("node").alias("c"), F.col("c").alias("__c")), "c", "left").select("node", F.coalesce("__c", "c").alias("c")))
            forget(was, end)
        if not seen.get["n"]:
            forget(links)
            return home.select("node", F.col("c").alias("component"))


def _distinct(links: DataFrame) -> DataFrame:
    """Links (u, v) between different nodes, once each, from the smaller to the larger."""
    return links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _ends(label: DataFrame) -> DataFrame:
    """Where the pointers (node, c) end, each to a node that is no larger; two steps in a round, so that ways shrink geometrically."""
    while True:
        one = label.select(F.col("node").alias("c"), F.col("c").alias("one"))
        two = label.select(F.col("node").alias("one"), F.col("c").alias("two"))
        seen = Observation()
        step = cut(label.join(one, "c").join(two, "one").observe(seen, F.max((F.col("one") != F.col("two")).cast("int")).alias("on")).select("node", F.col("two").alias("c")))
        forget(label)
        label = step
        if not seen.get["on"]:
            return label
