"""What the operators of this subpackage share: reading tables, tables written to the shared folder, components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.storage import dropped, fresh_path, shared_dir, stored  # noqa: F401  (for the operators)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader only, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, fold: int) -> Column:
    """crc32 of the id as text leaves 1 modulo fold; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % fold == 1, F.lit(False))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def batches(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def returned() -> None:
    """Give back what a worker no longer uses: it lives on between stages, and the allocators would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Bytes of text after which a worker gives back what it no longer uses.
RETURN = 4 << 20


def text_blocks(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a block hold about `most` bytes, or are one row: memory stays bounded for very long texts, and is given back every RETURN bytes."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start, total, since = 0, 0, 0
    for k, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield batch.slice(start, k - start)
            start, since, total = k, since + total, 0
            if since >= RETURN:
                returned()
                since = 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
    returned()


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node, component its smallest node.

    Large-star and small-star steps alternate until the edges stay as they are; each round's edges are written to the
    shared folder, so lineage stays short. Both steps keep a minimum per node (partial aggregation) and join it back on
    the node, which adaptive execution splits where one node has very many edges. Null ends and loops are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("a is not null and b is not null and a <> b").distinct()
    e = stored(e, name)
    size = F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
    before = e.agg(F.count("*"), size).first()
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select("u", "v"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # each node now points to smaller ones only: link them, and the node, to the smallest
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").union(least.select("v", "m")).distinct()
        after = stored(small, name)
        now = after.agg(F.count("*"), size).first()
        dropped(e)
        e = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select("u", "u").distinct())
