"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, lean, written


def forest(edges: DataFrame) -> DataFrame:
    """Union-find within each partition: edges ``u > v`` from each node to the smallest one that the partition's edges join it to.
    Partitions are dealt out by size, so a task holds the nodes of a bounded number of edges."""

    def rows(batches):
        import pyarrow as pa

        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (above := root.get(top, top)) != top:
                top = above
            while (above := root.get(x, x)) != top:
                root[x], x = top, above
            return top

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(x), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
        nodes = list(root)
        for k in range(0, len(nodes), 100_000):
            some = nodes[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], ["u", "v"])

    return edges.hint("rebalance").mapInArrow(lean(rows), "u bigint, v bigint")


def stars(edges: DataFrame) -> bool:
    """Whether each node is either a root or has one edge, to a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 or up = 1 and n > 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has an edge to another one; root is its component's smallest node
    (roots themselves are left out).

    Union-find within partitions leaves a forest of stars for each.  Where several meet, large-star and small-star steps take turns: each node's neighbours are joined to its smallest one, until
    all edges end in roots.  Each round is written to the shared folder; no edge leaves the executors.
    """
    x, y = F.col(a), F.col(b)
    now = written(forest(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))), "edges")
    while not stars(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, now = now, written(forest(moved.union(low.select("u", "m")).where("u != v")).distinct(), "edges")
        dropped(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (of ``components``) after more links (``a, b``).  Only the roots that the links join are
    gone through again; all other nodes are renamed by one join."""
    ends = roots.select(F.col("node").alias("end"), F.col("root").alias("top"))
    for x in ("a", "b"):
        links = links.join(ends.withColumnRenamed("end", x), x, "left").withColumn(x, F.coalesce("top", x)).drop("top")
    tops = components(links)
    if tops.isEmpty():
        return roots
    above = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(moved.union(tops), "roots")
