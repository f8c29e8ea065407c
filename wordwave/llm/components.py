"""Connected components of a link table, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that links reach, for every node with a link.

    ``edges`` has columns a, b (any orderable type).  Alternates the large-star
    and small-star steps of Kiveris et al. (2014) until the table stands still;
    each round is written to the shared folder, so that a lost executor costs
    one round.  Minima are aggregated before the shuffle; nothing is collected
    but one count and one checksum per round.  Null ends and self-links are
    ignored; repeated links count once; no links give an empty table.
    """
    current = materialise(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = _mark(current)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        # large star: every larger neighbour of a node goes to the least neighbour (or the node)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        grown = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour, and the node, go to the least neighbour
        low = grown.groupBy("a").agg(F.min("b").alias("m"))
        shrunk = (
            grown.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        )
        last, current = current, materialise(shrunk)
        discard(last)
        now = _mark(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return int(row["n"]), int(row["h"] or 0)
