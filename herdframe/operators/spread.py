"""Dealing rows out, and gathering a cell's few numbers into one array."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of an array that are aggregates of their own; longer arrays are gathered as (place, value) rows.
WIDE = 64


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by hash of the keys in as many partitions as the session shuffles into, which aren't merged for being small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dense(rows: DataFrame, keys: list[str], place: Column, size: int, **values: Column | str) -> DataFrame:
    """(keys, one column a value): arrays of `size` numbers a key, by place; 0 where there is no row, and of rows with the same place the largest value.

    Short arrays are plain maxima, with partial aggregation and in generated code; long ones are
    gathered and laid out by a vectorised kernel.
    """
    rows = rows.select(*keys, place.cast("int").alias("_place"), *[F.coalesce(v, F.lit(0.0)).alias(f"_{n}") for n, v in values.items()])
    if size <= WIDE:
        each = {n: [F.coalesce(F.max(F.when(F.col("_place") == k, F.col(f"_{n}"))), F.lit(0.0)) for k in range(size)] for n in values}
        return rows.groupBy(*keys).agg(*[F.array(*cells).alias(n) for n, cells in each.items()])

    @F.arrow_udf("array<double>")
    def laid_out(places: pa.Array, numbers: pa.Array) -> pa.Array:
        at, v = places.offsets.to_numpy().astype(np.int64), numbers.flatten().to_numpy()
        cell = np.repeat(np.arange(len(places)) * size, np.diff(at)) + places.flatten().to_numpy()
        order = np.lexsort((v, cell))
        out = np.zeros(len(places) * size)
        out[cell[order]] = v[order]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1) * size, pa.int32()), pa.array(out))

    held = rows.groupBy(*keys).agg(F.collect_list(F.struct("_place", *[f"_{n}" for n in values])).alias("_cells"))
    return held.select(*keys, *[laid_out("_cells._place", f"_cells._{n}").alias(n) for n in values])
