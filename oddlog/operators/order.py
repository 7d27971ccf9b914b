"""Global row positions without a single-task sort."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from oddlog.functions.rows import quoted
from oddlog.session import freeze

_LOCAL_BITS = (1 << 33) - 1


def with_position(df: DataFrame, order_by: list[str], out: str = "pos") -> tuple[DataFrame, int]:
    """0-based position under ``order_by`` (its last key unique) and the row count.

    Rows are range-partitioned and sorted, numbered inside each partition, and
    shifted by the sizes of the partitions before it. Only one count per
    partition reaches the driver.
    """
    keys = [quoted(k) for k in order_by]
    numbered = freeze(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS)))
    )
    sizes = sorted((r["_part"], r["count"]) for r in numbered.groupBy("_part").count().collect())
    ends = list(accumulate(size for _, size in sizes))
    shifts = [(part, end - size) for (part, size), end in zip(sizes, ends)]
    offsets = df.sparkSession.createDataFrame(shifts, "_part int, _shift long")
    placed = numbered.join(F.broadcast(offsets), "_part")
    return placed.withColumn(out, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"), (
        ends[-1] if ends else 0
    )


def with_entity_position(df: DataFrame, entity: str, order_by: list[str], out: str = "pos") -> DataFrame:
    """0-based position of each row among its entity's rows under ``order_by`` (its last key unique).

    Rows are range-partitioned by entity and order, so an entity of many rows spans many tasks. Each task numbers the
    rows of each entity it sees; only its first one may continue another task's, and the driver, which sees an entity
    and a count for each partition, carries that on.
    """
    keys = [quoted(k) for k in (entity, *order_by)]
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([*sorted_.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])

    def number(batches):
        part, held, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column(batch.schema.get_field_index(entity))
            same = np.zeros(batch.num_rows, bool)
            codes = name.dictionary_encode(null_encoding="encode").indices.to_numpy()
            same[1:] = codes[1:] == codes[:-1]
            same[0] = held is not None and held == (name[0].as_py(),)
            first = np.flatnonzero(~same)
            place = np.arange(batch.num_rows)
            began = np.concatenate([[-count], first]) if same[0] else first
            at = place - began[np.searchsorted(began, place, "right") - 1]
            held, count = (name[-1].as_py(),), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(at, pa.int64())], [*batch.schema.names, "_part", "_at"]
            )

    numbered = freeze(sorted_.mapInArrow(number, schema))
    name = quoted(entity)
    ends = numbered.groupBy("_part").agg(
        F.min(F.struct(name.alias("e"))).alias("first"), F.max(F.struct(name.alias("e"), "_at")).alias("last")
    ).orderBy("_part").collect()
    carried, last, count = [], None, 0
    for row in ends:
        goes_on = last is not None and row["first"]["e"] == last[0]
        carried.append((row["_part"], count if goes_on else 0))
        alone = row["first"]["e"] == row["last"]["e"]
        count = row["last"]["_at"] + 1 + (count if goes_on and alone else 0)
        last = (row["last"]["e"],)
    offsets = df.sparkSession.createDataFrame(carried, "_part int, _shift long")
    firsts = numbered.groupBy("_part").agg(F.min(F.struct(name.alias("e"))).alias("_first"))
    shifts = F.broadcast(offsets.join(firsts, "_part"))
    shift = F.when(name.eqNullSafe(F.col("_first.e")), F.col("_shift")).otherwise(F.lit(0))
    return numbered.join(shifts, "_part").withColumn(out, F.col("_at") + shift).drop("_part", "_at", "_shift", "_first")
