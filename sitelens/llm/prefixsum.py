"""Exclusive prefix sums over rows in a total order, however many rows there are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sitelens.llm.common import discard, private, stored


def prefix_sums(rows: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """``rows`` with, for each ``out: column`` of ``sums``, the sum of ``column`` over all rows before it in ``order``.

    Rows are dealt by ranges of ``order`` and sorted; each range adds up its own rows as they stream through. The ranges'
    totals, one row a range, become offsets. ``order`` has to tell rows apart for large groups to be split; rows
    equal in all of it come in any order. Null values count as 0. The result reads a written table.
    """
    part = private(rows, "part")
    outs = list(sums)
    schema = StructType([*rows.schema.fields, *[StructField(o, LongType()) for o in outs], StructField(part, LongType())])
    columns = list(sums.values())

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        carried = np.zeros(len(outs), np.int64)
        for batch in batches:
            added = []
            for i, c in enumerate(columns):
                values = batch.column(batch.schema.get_field_index(c)).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(values) + carried[i]
                added.append(pa.array(upto - values, pa.int64()))
                carried[i] = upto[-1] if len(upto) else carried[i]
            arrays = [*batch.columns, *added, pa.array(np.full(batch.num_rows, here, np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    local = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(running, schema), name)
    totals = local.groupBy(part).agg(*[F.sum(c).alias(o) for o, c in sums.items()]).orderBy(part).collect()
    offsets, so_far = [], [0] * len(outs)
    for t in totals:
        offsets.append((t[part], *so_far))
        so_far = [x + (t[o] or 0) for x, o in zip(so_far, outs, strict=True)]
    shifts = {o: private(local, f"{o}_shift") for o in outs}
    table = rows.sparkSession.createDataFrame(offsets, StructType([StructField(part, LongType()), *[StructField(shifts[o], LongType()) for o in outs]]))
    out = local.join(F.broadcast(table), part).select(*rows.columns, *[(F.col(o) + F.col(shifts[o])).alias(o) for o in outs])
    out._stored_at = local._stored_at
    return out


__all__ = ["discard", "prefix_sums"]
