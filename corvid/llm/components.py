"""Connected components of an edge table by alternating star contraction.

Each round hangs every node on the smallest neighbour (large star, then small
star) and writes the edges to the shared folder, so lineage stays short and
nothing is gathered anywhere.  Nodes are compared as signed longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import materialise


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
                  F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31))).alias("s")).collect()[0]
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of different longs -> (node, root): every node of an edge
    with the smallest node that can be reached from it; roots are left out."""
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        sym = now.select(F.inline(both))
        # minima are written before they are joined: adaptive execution can split
        # a hub only where both sides of the join come straight from a shuffle
        least = materialise(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = sym.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")) \
            .filter("a <> b").distinct()
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        small = large.join(low, "a").select(F.inline(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("m").alias("b"))))).filter("a <> b").distinct()
        now = materialise(small, "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
