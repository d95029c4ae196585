"""Small groups through a Python function, many to an Arrow batch.

``applyInPandas`` hands over one group at a time, which costs more than the work when groups are beams of a few rows. Here
a group is gathered into one row by Spark, and a task's Python function sees thousands of them in a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_groups(rows: DataFrame, key: str, columns: list[str], function: Callable[[object, list[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """``function(key, rows)`` for each group, whose rows it may order as it likes; it yields tuples of ``schema``."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for k, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in function(k, own)]
            cols = list(zip(*out, strict=True)) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return rows.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("rows")).mapInArrow(run, kind)
