"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.shared import materialize, salted_join

EDGE_SCHEMA = "u long, v long"


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node with an edge and the smallest node it can reach.

    edges: two bigint columns, in any direction, repeats and loops allowed; a row with
    a null end is ignored. Alternating large-star and small-star rounds: each links
    nodes to the smallest neighbour by an aggregation with partial sums and a salted
    join, which adaptive execution can split further, so no node's neighbours ever meet
    in one task. Each round is written to the shared folder, which cuts the lineage.
    The number of rounds grows with the logarithm of the longest path.
    """
    a, b = (F.col(c).cast("long") for c in edges.columns[:2])
    stars = edges.select(a.alias("u"), b.alias("v")).where("u is not null and v is not null and u <> v")
    stars = materialize(stars.distinct(), "edges")
    print_of = None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = salted_join(both, low, ["u"], "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low, ["u"], "v").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == print_of:
            break
        print_of = now
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
