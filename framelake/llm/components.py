"""Connected components of an edge table, by label propagation with pointer jumping.

Every round is two joins on nodes, a map-side combined minimum and a look-up of
the labels in use; tables are written to the shared folder between rounds. Only
labels that moved are looked up, and that few are broadcast (counted first), so
that the many nodes of a giant component never meet in one task. Beyond the bound
the look-up is a shuffled join, which adaptive execution splits where a label is
frequent. Nothing is gathered on the driver but the numbers of labels that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.workspace import settle

#: Rows (about 60 bytes each) up to which a counted table is broadcast.
BROADCAST_ROWS = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b", values: DataFrame | None = None) -> DataFrame:
    """(node, label, value) for every node of an edge: the node of least value that it reaches and that value.

    values is (node, value); nulls and nodes without a row come last, ties go by
    node. Without it, a node's value is the node itself. Loops, repeats and an
    empty table do no harm.
    """
    both = settle(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "edges")
    nodes = both.select(F.col("x").alias("node")).distinct()
    valued = nodes.withColumn("value", F.col("node")) if values is None else nodes.join(values, "node", "left")
    labels = settle(valued.select("node", F.struct(F.col("value").isNull().alias("none"), "value", "node").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("x")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooked = settle(hooked, "hooked")
        if not hooked.where("old.node <> label.node").limit(1).count():  # then no label has one to follow
            return hooked.select("node", F.col("label.node").alias("label"), F.col("label.value").alias("value"))
        used = hooked.select(F.col("label.node").alias("p")).distinct()
        moved = settle(used.join(hooked.select(F.col("node").alias("p"), F.col("label").alias("far")), "p").where("far.node <> p"), "moved")
        n = moved.count()
        if n:
            jump = F.broadcast(moved) if n <= BROADCAST_ROWS else moved
            hooked = settle(hooked.join(jump, F.col("label.node") == F.col("p"), "left").select("node", "old", F.coalesce("far", "label").alias("label")), "labels")
        labels = hooked.select("node", "label")
