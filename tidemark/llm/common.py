"""Helpers the operators of this folder share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.blocks import settle

BATCH_BYTES = 4 << 20
EDGES_A_PART = 50_000


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows whose column holds about ``limit`` bytes, so that the work arrays of a
    task are bounded by that or by its longest single value."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def giving_back(make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``make`` for ``mapInArrow``, after which a Python worker, which lives on for other tasks, gives the memory that is free
    back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # glibc alone has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges(a, b)``: bigint ends; nulls and loops are ignored, repeated edges harmless. Returns (node, component)
    for every node of an edge, ``component`` being the smallest node it reaches. Large-star and small-star steps
    alternate until the edges are stars around the smallest nodes; each step is a partial aggregate and a join on
    the node, which the adaptive planner splits where a hub is hot, and ends in a reliable checkpoint of about
    ``EDGES_A_PART`` edges a partition.
    """
    now = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    mark = _mark(now)
    while mark[0]:
        parts = -(-mark[0] // EDGES_A_PART)
        now = now.coalesce(parts)
        both = now.select(F.inline(F.array(F.struct("hi", "lo"), F.struct(F.col("lo").alias("hi"), F.col("hi").alias("lo")))))
        low = both.groupBy("hi").agg(F.least(F.col("hi"), F.min("lo")).alias("m"))
        wide = (
            both.where("lo > hi").join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        )
        low = wide.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = wide.join(low, "hi").select(
            F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")
        )
        now = settle(moved.where("hi <> lo").distinct().coalesce(parts))
        before, mark = mark, _mark(now)
        if before == mark:
            break
    tops = now.select(F.col("lo").alias("node")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        tops.select("node", F.col("node").alias("component"))
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
    return tuple(row)
