"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.workspace import Workspace


def components(links: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    """``node`` and ``label``, the least node it is connected to, of every node of ``links(a, b)``.

    In each round a node takes the least label around it and then its label's label, until
    none changes. Rounds are written, so no lineage grows; nothing comes to the driver
    but whether a label changed. Minima are combined before the shuffle, so a node with
    very many links is one row per task.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = workspace.table(f"{name}_edges", lambda: both.where("a <> b").distinct())
    labels = workspace.table(
        f"{name}_labels_0",
        lambda: edges.groupBy(F.col("a").alias("node")).agg(
            F.least(F.first("a"), F.min("b")).alias("label")
        ),
    )
    round_no = 0
    while True:
        round_no += 1
        around = (
            edges.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("label").alias("around"))
        )
        near = labels.join(around, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("before"), F.least("label", "around").alias("near")
        )
        target = labels.select(F.col("node").alias("target"), F.col("label").alias("further"))
        jumped = near.join(target, F.col("near") == F.col("target")).select(
            "node",
            F.least("near", "further").alias("label"),
            (F.least("near", "further") != F.col("before")).alias("changed"),
        )
        written = workspace.table(f"{name}_labels_{round_no}", lambda jumped=jumped: jumped)
        labels = written.drop("changed")
        if written.where("changed").isEmpty():
            return labels
