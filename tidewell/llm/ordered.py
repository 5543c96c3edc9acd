"""Positions and running sums along an order, over ranges instead of whole groups.

A window puts all rows of a group into one task, and one without groups all
rows of a table. Here rows are dealt by ranges of (group, order), so that a
group of any size is cut over many tasks; each task numbers its own rows, and
what a range's first group had before it is added from a table of one row a
range.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm import common


def _local(group: list[int], sums: list[int], xors: list[int]):
    """What a task adds to its sorted rows: its number, and positions and running values within it."""

    def run(batches):
        part, key, nth, held = TaskContext.get().partitionId(), None, 0, [0] * (len(sums) + len(xors))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(k).to_numpy() for k in group]
            new = np.zeros(n, bool)
            for c in keys:
                new[1:] |= c[1:] != c[:-1]
            first = tuple(c[0] for c in keys)
            new[0] = key is None or first != key
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            old = start == 0 if not new[0] else np.zeros(n, bool)  # rows of the group that the batch before ended in
            place = np.arange(n) - start + 1 + np.where(old, nth, 0)
            out = [pa.array(np.full(n, part, np.int32)), pa.array(place)]
            for j, k in enumerate([*sums, *xors]):
                x = batch.column(k).to_numpy()
                if j < len(sums):
                    total = np.cumsum(x)
                    total = total - (total - x)[start] + np.where(old, held[j], 0)
                else:
                    total = np.bitwise_xor.accumulate(x)
                    total = total ^ (total ^ x)[start] ^ np.where(old, held[j], 0)
                held[j] = total[-1]
                out.append(pa.array(total))
            key, nth = tuple(c[-1] for c in keys), int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *(f"_run{k}" for k in range(len(out)))])

    return run


def running(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], *, nth: str, sums: dict[str, str] | None = None, xors: dict[str, str] | None = None, label: str = "ordered") -> DataFrame:
    """``df`` with each row's position (from 1) in its group, and sums and exclusive ors of columns up to and with the row.

    ``group`` are long columns without nulls, or none: then the position is that
    in the whole table. ``sums`` and ``xors`` map new names to long columns
    without nulls. Rows that are equal in all of ``order`` have an order too, but
    any; give an order that has no ties where that matters. The driver sees one
    row a range. The result is a written table.
    """
    sums, xors = sums or {}, xors or {}
    spark, names = df.sparkSession, df.columns
    by = [*group, *order]
    dealt = df.repartitionByRange(common.partitions(df), *by).sortWithinPartitions(*by)
    at = {c: k for k, c in enumerate(names)}
    values = [nth, *sums, *xors]
    schema = T.StructType([*df.schema.fields, T.StructField("_run0", T.IntegerType()), *(T.StructField(f"_run{k + 1}", T.LongType()) for k in range(len(values)))])
    local = common.written(dealt.mapInArrow(_local([at[c] for c in group], [at[c] for c in sums.values()], [at[c] for c in xors.values()]), schema), label)
    runs = [f"_run{k + 1}" for k in range(len(values))]
    own = F.struct(*(F.col(c) for c in group), *(F.col(c) for c in runs))
    ends = local.groupBy("_run0").agg(F.min(F.struct(F.lit(0), *group)).alias("first"), F.max_by(own, F.struct(*group, "_run1")).alias("last")).collect()
    carried, before, key = [], [0] * len(values), None
    for row in sorted(ends):
        first, last = tuple(row["first"])[1:], tuple(row["last"])
        if key == first:
            carried.append((row["_run0"], *first, *before))
        joined = key == first == last[: len(group)]  # the range is the middle of one group
        key, add = last[: len(group)], last[len(group) :]
        before = [a + (b if joined else 0) if k <= len(sums) else a ^ (b if joined else 0) for k, (a, b) in enumerate(zip(add, before, strict=True))]
    keep = [F.col(f"`{c}`") for c in names]
    if not carried:
        return local.select(*keep, *(F.col(r).alias(v) for r, v in zip(runs, values, strict=True)))
    fields = ["_part int", *(f"_g{k} long" for k in range(len(group))), *(f"_c{k} long" for k in range(len(values)))]
    carry = spark.createDataFrame(carried, ", ".join(fields))
    hit = F.col("_run0") == F.col("_part")
    for k, c in enumerate(group):
        hit = hit & (F.col(c) == F.col(f"_g{k}"))
    more = lambda k: F.coalesce(F.col(f"_c{k}"), F.lit(0))
    done = [(F.col(r) + more(k) if k <= len(sums) else F.col(r).bitwiseXOR(more(k))).alias(v) for k, (r, v) in enumerate(zip(runs, values, strict=True))]
    # one row a range at most
    return local.join(F.broadcast(carry), hit, "left").select(*keep, *done)
