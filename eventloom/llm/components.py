"""Connected components of a link table by hanging nodes on smaller ones and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import clear, made, swept, written


def _turn(links: DataFrame) -> DataFrame:
    return links.select(F.col("v").alias("u"), F.col("u").alias("v"))


def followed(rows: DataFrame, roots: DataFrame, name: str, to: str | None = None) -> DataFrame:
    """The rows with the root of the node in column `name`, or that node if roots (node, root) lacks it, in its place or in column `to`."""
    known = roots.select(F.col("node").alias(name), F.col("root").alias("_root"))
    return rows.join(known, name, "left").withColumn(to or name, F.coalesce("_root", name)).select(*rows.columns, *([to] if to else []))


def _hung(links: DataFrame) -> DataFrame:
    """(node, root): each node beside the least node within two links of it."""
    both = links.unionByName(_turn(links))
    near = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "components-near")
    return both.join(near, "v").groupBy(F.col("u").alias("node")).agg(F.min("m").alias("root"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (u, v), two longs, or two byte strings: root is the least node that it reaches.

    In a round each node is hung on the least node within two links, pointers are doubled until all lead to the root of
    their tree, and links are carried over to these roots; those inside a tree go. A star needs one round, a chain in order
    one round with pointers doubled as often as its length can be halved. All is written, and removed but for the result; the
    driver only learns whether links, or pointers that moved, are left. Links to oneself, doubled links and either direction are allowed; nulls are dropped; an empty
    table gives none.
    """
    spark, before = links.sparkSession, made()
    now, trees = written(links.where("u <> v").select("u", "v"), "components"), []
    for _ in range(max_rounds):
        with swept(spark):
            if now.isEmpty():
                break
        at = made()
        tree, moved = written(_hung(now), "components-tree"), True
        while moved:
            clear(spark, since=at, keep=1)
            tree = written(followed(tree.select("node", "root", F.col("root").alias("was")), tree, "root").select("node", "root", (F.col("root") != F.col("was")).alias("moved")), "components-tree")
            with swept(spark):
                moved = not tree.where("moved").isEmpty()
        clear(spark, since=at, keep=1)
        trees.append(tree.select("node", "root"))
        now = written(followed(followed(now, trees[-1], "u"), trees[-1], "v").where("u <> v"), "components")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = trees[0] if trees else now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for tree in trees[1:]:
        out = followed(out, tree, "root")
    out = written(out, "components-roots")
    clear(spark, since=before, keep=1)
    return out
