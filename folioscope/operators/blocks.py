"""Rows packed in blocks, and each block with each other one.

Where everything meets, sending each row to every task that needs it takes disk
that grows with the square of the rows. Here rows are packed once, compressed,
and a task reads the blocks that it compares: nothing is written a second time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.store import held

#: Most bytes of a block before it is compressed.
BYTES = 32 << 20


def _block(some: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(some).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
        out.write_table(table)
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["_block"])


def packed(rows: DataFrame, many: int) -> DataFrame:
    """Blocks (_k, _block) of up to ``many`` rows, of those that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n, size = [], 0, 0
        for b in batches:
            # a batch can be larger than a block
            step = max(1, min(many, b.num_rows * BYTES // max(1, b.nbytes)))
            k = 0
            while k < b.num_rows:
                part = b.slice(k, min(step, many - n))
                k += part.num_rows
                some.append(part)
                n, size = n + part.num_rows, size + part.nbytes
                if n >= many or size >= BYTES:
                    yield _block(some)
                    some, n, size = [], 0, 0
        if some:
            yield _block(some)

    return rows.mapInArrow(run, "_block binary").select(F.monotonically_increasing_id().alias("_k"), "_block")


def unpacked(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all().combine_chunks()


def fixed(blocks: DataFrame) -> DataFrame:
    """Blocks that are made once, so that tasks agree on what is in them."""
    return held(blocks) if blocks.sparkSession.sparkContext.getCheckpointDir() else blocks.persist(StorageLevel.DISK_ONLY)


def met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each block of ``left`` (_i, _a) with each of ``right`` (_j, _b). A task
    reads a partition of both; that of ``right`` is kept in memory meanwhile."""
    return left.toDF("_i", "_a").hint("shuffle_replicate_nl").crossJoin(right.toDF("_j", "_b"))
