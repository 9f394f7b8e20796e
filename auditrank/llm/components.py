"""Connected components of links by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditrank.session import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all ends of ``links`` (one, two); component is the
    smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so labels travel along paths of doubling length.  Every round
    is written to the shared folder; folds are partial before their shuffle.
    """
    both = links.select(F.explode(F.array(F.struct("one", "two"), F.struct(F.col("two").alias("one"), F.col("one").alias("two")))).alias("e"))
    edges = stage(both.select(F.col("e.one").alias("node"), F.col("e.two").alias("other")), "edges")
    label = stage(
        edges.groupBy("node").agg(F.min("other").alias("near")).select("node", F.least("node", "near").alias("component")),
        "labels",
    )
    while True:
        near = edges.join(label.select(F.col("node").alias("other"), "component"), "other")
        best = (
            near.select("node", "component", F.lit(None).cast("long").alias("before"))
            .unionByName(label.select("node", "component", F.col("component").alias("before")))
            .groupBy("node").agg(F.min("component").alias("component"), F.max("before").alias("before"))
        )
        ends = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        label = stage(
            best.join(ends, "component", "left").select(
                "node", F.least("component", F.coalesce("further", "component")).alias("component"), "before"
            ),
            "labels",
        )
        if label.where("component != before").isEmpty():
            return label.select("node", "component")
