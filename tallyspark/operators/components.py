"""Connected components of an edge table, as an iterated join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.shared import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) -> (node, component): the least node reachable. Nodes without edges aren't listed.

    Each round gives every node the least label among its neighbours (summed up before the shuffle, so a hub
    costs no more than its edges) and then follows labels one step on, which halves the length of chains. Every round is
    written to the shared folder, and deleted once the next one is. Labels only fall, so the rounds end; an edge whose ends have the
    same label stays, as its label may still fall.
    """
    both = edges.select("src", "dst").where("src is not null and dst is not null and src != dst")
    both = stored(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    last = labels = stored(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        told = both.join(labels, both["src"] == labels["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("told"))
        nearer = labels.join(told, "node").select("node", F.col("component").alias("old"), F.least("component", "told").alias("component"))
        onward = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = stored(nearer.join(onward, "component").select("node", "old", F.least("component", "next").alias("component")))
        discard(last)
        last, labels = new, new.select("node", "component")
        if new.where("component != old").isEmpty():
            discard(both)
            return labels


def star_components(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(head, key), each head a key of its own star -> two stored tables: (key, head, last), every key once with its first and last head, and
    (head, component, nodes), the least key that hangs together with the head and how many keys do.

    A key of one star joins nothing, so the rounds of connected_components see only those that several stars share, and no table
    of all edges in both directions is made.
    """
    ends = stored(members.groupBy("key").agg(F.min("head").alias("head"), F.max("head").alias("last")))
    shared = stored(ends.where("head != last").select("key"))
    joined = connected_components(members.join(shared, "key", "left_semi").select(F.col("head").alias("src"), F.col("key").alias("dst")))
    heads = members.where("head = key").select("head").distinct()
    parts = stored(heads.join(joined, F.col("head") == F.col("node"), "left").select("head", F.coalesce("component", "head").alias("part")))
    least = ends.groupBy("head").agg(F.min("key").alias("component"), F.count("*").alias("nodes")).join(parts, "head").groupBy("part").agg(F.min("component").alias("component"), F.sum("nodes").alias("nodes"))
    home = stored(parts.join(least, "part").select("head", "component", "nodes"))
    discard(shared, parts)
    return ends, home
