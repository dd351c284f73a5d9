"""Vectors in array columns, and sums of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; the longer vector is cut to the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for different lengths or a zero vector."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def _sums(keys: Sequence[str], vector: str, first: bool):
    """Sums of runs of equal keys: of the vectors (first) or of earlier sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def flush() -> pa.RecordBatch:
            kept = list(held.items())
            held.clear()
            columns = [pa.array([k[i] for k, _ in kept], types[i]) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([s if s is None else s.tolist() for _, (s, _) in kept], pa.list_(pa.float64())), pa.array([n for _, (_, n) in kept], pa.int64())], [*keys, "_sum", "_n"])

        types = []
        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            counts = [1] * b.num_rows if first else b.column("_n").to_pylist()
            column = b.column(vector if first else "_sum").cast(pa.list_(pa.float64()))
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            ragged = column.is_null().to_pylist()
            for i, key in enumerate(zip(*(b.column(k).to_pylist() for k in keys), strict=True)):
                if not first and key not in held and held:
                    yield flush()  # rows come sorted: the key before is complete
                x = None if ragged[i] else flat[ends[i] : ends[i + 1]]
                if key not in held:
                    held[key] = [None if x is None else x.copy(), counts[i]]
                    continue
                have = held[key]
                have[0] = None if have[0] is None or x is None or len(have[0]) != len(x) else have[0] + x
                have[1] += counts[i]
            if first and held:
                yield flush()
        if held:
            yield flush()

    return run


def mean_pool(rows: DataFrame, keys: Sequence[str], vector: str = "vector") -> DataFrame:
    """Renormalised mean vector of each key. Keys whose vectors differ in length
    are left out; null vectors do not count.

    Each batch adds up its vectors by key, the sums are exchanged and added up
    in key order; a key of any size is one sum in memory.
    """
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", _sum array<double>, _n long"
    some = rows.where(F.col(vector).isNotNull()).select(*keys, vector).mapInArrow(_sums(keys, vector, True), schema)
    sums = some.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_sums(keys, vector, False), schema)
    return sums.where("_sum IS NOT NULL").select(*keys, normalise(F.transform("_sum", lambda x: x / F.col("_n"))).alias(vector))


#: Partial sums that a centroid adds up last.
LANES = 64


def centroid(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """Renormalised mean of all vectors: one row ``_centre``, none without a
    vector or if lengths differ. Sums go through ``LANES`` tasks before the last."""
    schema = "_lane int, _sum array<double>, _n long"
    sums = rows.where(F.col(vector).isNotNull()).select((F.spark_partition_id() % LANES).alias("_lane"), vector).mapInArrow(_sums(["_lane"], vector, True), schema)
    sums = sums.repartition("_lane").sortWithinPartitions("_lane").mapInArrow(_sums(["_lane"], vector, False), schema)
    last = sums.withColumn("_lane", F.lit(0)).repartition(1).mapInArrow(_sums(["_lane"], vector, False), schema)
    return last.where("_sum IS NOT NULL").select(normalise(F.transform("_sum", lambda x: x / F.col("_n"))).alias("_centre"))
