"""Connected components of a graph given by its edges, by large-star and small-star steps."""

from pyspark.sql import functions as F

from pressmill.llm.common import stored

ROUNDS = 60


def _both(edges):
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges):
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b").distinct())


def _small_star(edges):
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a")
    return (linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())


def components(edges):
    """node, root: the smallest node reachable, for every node of an edge (a, b).

    Every round is stored; rounds grow with the logarithm of the longest path.  A node with
    very many neighbours is met by minima inside the tasks and by joins whose larger side can be split.
    """
    edges = stored(edges.filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(ROUNDS):
        edges = stored(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
