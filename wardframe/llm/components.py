"""Connected components of an edge table by alternating star contractions."""

from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir

ROUNDS = 60


def components(edges):
    """(node, root): the smallest node reachable, for every node of edges(a, b).

    Each round hangs all larger neighbours of a node on its smallest one, then all smaller
    neighbours; the number of rounds grows with the logarithm of the longest path. Every round is
    cut off by a checkpoint. Both steps are minima combined before the shuffle and equi joins.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(
        "a <> b").distinct().checkpoint()
    before = None
    for _ in range(ROUNDS):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"),
                                                             F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = small.filter("a <> b").unionAll(least.select("a", F.col("m").alias("b"))) \
            .distinct().checkpoint()
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
