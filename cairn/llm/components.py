"""Connected components by alternating star contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, checkpoint

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` that is not its component's smallest.

    Large stars hook larger neighbours to the smallest neighbour, small stars
    hook smaller ones; rounds are logarithmic in practice. Each round is
    written to the shared folder, which cuts the lineage. Links with a null end
    or of a node to itself are none; repeated links count once; no links give no rows.
    """
    spark = edges.sparkSession
    with Scratch(spark) as scratch:
        now = scratch.keep(
            "edges0",
            edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        )
        state = _state(now)
        for k in range(1, MAX_ROUNDS + 1):
            if not state[0]:
                break
            both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
            # Kept before the joins, so that the join of a hub with its many neighbours can be split.
            least = scratch.keep(f"least{k}", both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            large = scratch.keep(f"large{k}", large.filter("hi <> lo").distinct())
            lowest = scratch.keep(f"lowest{k}", large.groupBy("hi").agg(F.min("lo").alias("m")))
            small = large.join(lowest, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            then = scratch.keep(f"edges{k}", small.union(lowest.select("hi", "m")).distinct())
            for table in (f"edges{k - 1}", f"least{k}", f"large{k}", f"lowest{k}"):
                scratch.drop(table)
            now, before, state = then, state, _state(then)
            if state == before:
                break
        else:
            raise RuntimeError("components did not settle")
        return checkpoint(now.select(F.col("hi").alias("node"), F.col("lo").alias("root")))
