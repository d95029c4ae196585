"""Connected components of an edge table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import cut, remove


def components(edges: DataFrame, *, max_rounds: int = 200) -> DataFrame:
    """(id, comp): for each id in ``edges`` (a, b) the least id that it is linked to.

    Each round gives every id the least label among its neighbours and then follows the labels one step further, so
    chains shorten geometrically. Labels are written to the shared folder between rounds. The label of a hub reaches
    its neighbours in a join that adaptive execution can split, and minima are taken with map-side partial results.
    Labels that haven't settled after ``max_rounds`` raise.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both, both_path = cut(both, keep_path=True)
    labels, path = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), keep_path=True)
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("seen"))
        hop = labels.select(F.col("id").alias("comp"), F.col("comp").alias("onward"))
        new = (
            labels.join(near, "id")
            .select("id", "comp", F.least("comp", "seen").alias("best"))
            .join(hop.withColumnRenamed("comp", "best"), "best")
            .select("id", F.least("best", "onward").alias("comp"), (F.least("best", "onward") < F.col("comp")).alias("moved"))
        )
        new, new_path = cut(new, keep_path=True)
        moved = not new.where("moved").isEmpty()
        remove(edges.sparkSession, path)
        labels, path = new.select("id", "comp"), new_path
        if not moved:
            break
    else:
        raise RuntimeError(f"labels still move after {max_rounds} rounds")
    remove(edges.sparkSession, both_path)
    return labels
