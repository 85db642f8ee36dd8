"""Connected components of an edge table by alternating large and small stars.

Every round reads a written table and writes the next one, so lineage stays short and a lost
executor costs one round. A round's tables have no more rows than it has edges, which are counted, so they are written to
as many files as that takes and not to one for each shuffle partition. Hubs are met by partial aggregation and by salted joins; no neighbourhood is
ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import salted_join, stage

#: Rows of a written file, two numbers each.
FILE_ROWS = 50_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``edges`` (long columns), root being the smallest of its
    component. Loops and repeats do no harm; rows with a null end are left out."""
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ends = known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = stage(ends.where("u != v").distinct(), "edges")
    print_of = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == print_of:
            break
        print_of, files = seen, -(-seen[0] // FILE_ROWS) or 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        least = stage(least, "large-least", files)
        large = salted_join(both, least, ["u"], "n", ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stage(large, "large-star", files)
        least = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "small-least", files)
        small = salted_join(large, least, ["u"], "n", ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star", files)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
