"""Connected components by contraction of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _mapped(edges: DataFrame, up: DataFrame) -> DataFrame:
    """The edges between what ``up`` (node, to) makes of their ends, each once and without loops."""
    for end in ("u", "v"):
        edges = edges.join(up.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", known: DataFrame | None = None, task_rows: int | None = None) -> DataFrame:
    """``(node, label)``: the smallest node reachable from each linked node.

    links: pairs of comparable ids. Null ends are ignored, repeated pairs and
    loops do no harm, and no links give an empty result. known: an earlier result, to which
    the links are added. In every round each node goes to its smallest neighbour's smallest
    neighbour, and only edges between different nodes are left for the next one. A round is joins and
    map-side combined minima over the edges that are left; rounds end when none is. task_rows: what a round writes comes from
    few tasks of about so many edges, however many partitions a shuffle has.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    if known is not None:
        e = _mapped(e, known.withColumnRenamed("label", "to"))
    e = materialize(e, "edges")
    tasks = None if task_rows is None else max(1, -(-e.count() // task_rows))
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    labels = nodes.select("node", F.col("node").alias("label"))
    if known is not None:
        labels = known.unionByName(labels.join(known, "node", "left_anti"))
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("to")), "low", tasks)
        up = materialize(low.join(low.select(F.col("node").alias("to"), F.col("to").alias("up")), "to").select("node", F.col("up").alias("to")), "up", tasks)
        labels = materialize(labels.join(up.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels", tasks)
        e = materialize(_mapped(e, up), "edges", tasks)
    return materialize(labels, "labels", tasks)
