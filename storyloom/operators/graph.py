"""Connected components by contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.storage import cut


def components(members: DataFrame) -> DataFrame:
    """(node, root) of every node of members (tile, node), where nodes that share a tile are joined; root is the
    component's least node.

    Every round gives each tile its least node and each node the least of its tiles, follows these pointers once
    more, renames nodes by them, and drops repeated rows and tiles with one node left. Rows only ever shrink, and
    a tile's nodes are never paired, so a tile that holds most nodes costs no more than its rows."""
    own = members.select("tile", F.col("node").alias("at")).distinct()
    names = members.select("node", F.col("node").alias("root")).distinct()
    edges, names = cut(_open(own), "edges"), cut(names, "names")
    while edges.head(1):
        low = edges.groupBy("tile").agg(F.min("at").alias("low"))
        step = cut(edges.join(low, "tile").groupBy("at").agg(F.min("low").alias("to")), "step")
        again = step.select(F.col("at").alias("to"), F.col("to").alias("next"))
        step = cut(step.join(again, "to", "left").select("at", F.coalesce("next", "to").alias("to")), "step")
        edges = cut(_open(edges.join(step, "at").select("tile", F.col("to").alias("at")).distinct()), "edges")
        names = cut(names.join(step.withColumnRenamed("at", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "names")
    return names


def _open(edges: DataFrame) -> DataFrame:
    """The rows of tiles that hold several nodes."""
    several = edges.groupBy("tile").agg(F.min("at").alias("low"), F.max("at").alias("high")).filter("low <> high").select("tile")
    return edges.join(several, "tile", "left_semi")
