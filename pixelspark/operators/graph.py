"""Connected components of a table of links, and work on each component by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import scratch_path


def _stars(edges: DataFrame) -> DataFrame:
    """One alternation: the larger neighbours of every node, then its smaller ones, are tied to its smallest neighbour.

    Each half is one shuffle by node; duplicates go and the smallest neighbour is found where the shuffle put them.
    """
    both = edges.unionByName(edges.selectExpr("b as a", "a as b")).repartition("a").dropDuplicates(["a", "b"])
    large = both.withColumn("m", F.expr("least(a, min(b) over (partition by a))")).where("b > a").selectExpr("b as a", "m as b")
    down = large.repartition("a").dropDuplicates(["a", "b"]).withColumn("m", F.expr("min(b) over (partition by a)"))
    ties = F.explode(F.expr("if(b = m, array(struct(a, m as b)), array(struct(b as a, m as b)))")).alias("e")
    return down.select(ties).select("e.*").where("a <> b")


def components(links: DataFrame) -> tuple[DataFrame, int]:
    """(node, root) for every linked node, and a bound on the number of nodes: root is the smallest node that links (a, b) reach.

    The rounds grow with the logarithm of the longest path. Each round's links are written to the shared folder, and counted while they
    are; the run is over when a round leaves them as they were.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    before = None
    while True:
        folder, seen = scratch_path(spark, "stars"), Observation()
        sums = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
        made = _stars(edges)
        made.observe(seen, *sums).write.parquet(folder)
        edges = spark.read.schema(made.schema).parquet(folder)
        now = seen.get
        if now == before or not now["n"]:
            return edges.selectExpr("a as node", "b as root").distinct(), 2 * now["n"]
        before = now
