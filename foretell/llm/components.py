"""Connected components by minimum labels, hooking and pointer jumping, as joins and map-side-combined minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretell.llm.common import discard, few, materialise

#: Tables of up to so many nodes go to the tasks that ask for them.
SMALL = 200_000


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, label) for every node of edges (u, v); equal labels mean connected, a label is the smallest node.

    Each round every node takes the smallest label among its neighbours, the node that was its label is hooked to the same one, and labels are replaced by their own labels.  Rounds grow with the logarithm of the longest path.  A round is two minima and two joins, each worked out once: what a node finds goes on as one row or two, whether its label changed goes along with the minimum, and both sides of the jump read one written table.  In the first round a node is its own label, so one minimum over its edges does.  Every table is written to the shared folder, by as many tasks as its rows are worth; labels of up to SMALL nodes are sent to the tasks.  The driver sees counts only.  An edge table without rows gives no row.

    rows: how many rows edges has at most, if that is known.
    """
    both = edges.select("u", "v").union(edges.select("v", "u")).filter("u <> v").distinct()
    both = materialise(both if rows is None else few(both, 2 * rows))
    n, labels, small = both.count(), None, False
    side = lambda df: F.broadcast(df) if small else df

    def told() -> DataFrame:
        """node, x: the smallest label told to a node, and whether the label of the one that told it changed."""
        if labels is None:
            found = few(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")), n)
            return found.select("node", F.struct(F.least("least", "node").alias("least"), (F.col("least") < F.col("node")).alias("moved")).alias("x"))
        own = labels.select("node", F.col("label").alias("least"), "label")
        near = both.join(side(labels.withColumnRenamed("node", "v")), "v").select(F.col("u").alias("node"), F.col("label").alias("least"), F.lit(None).alias("label"))
        found = few(own.union(near).groupBy("node").agg(F.min("least").alias("least"), F.max("label").alias("label")), n)
        lower = F.col("least") < F.col("label")
        told_rows = F.array(F.struct("node", "least", lower.alias("moved")), F.when(lower, F.struct(F.col("label").alias("node"), "least", lower.alias("moved"))))
        return few(found.select(F.explode(told_rows).alias("x")).filter("x IS NOT NULL").groupBy("x.node").agg(F.min(F.struct("x.least", "x.moved")).alias("x")), n)

    while True:
        least = materialise(told())
        small = least.count() <= SMALL if labels is None else small
        jump = least.select(F.col("node").alias("least"), F.col("x").alias("next"))
        jumped = least.select("node", "x.least", "x.moved").join(side(jump), "least")
        new = materialise(few(jumped.select("node", F.col("next.least").alias("label"), (F.col("moved") | (F.col("next.least") < F.col("least"))).alias("moved")), n))
        changed = new.filter("moved").limit(1).count()
        discard(least, *([] if labels is None else [labels]))
        labels = new.drop("moved")
        labels._shared_path = new._shared_path
        if not changed:
            discard(both)
            return labels
