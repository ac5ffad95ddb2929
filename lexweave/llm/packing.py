"""Packing along a space-filling curve: documents near each other in content share training sequences.

Each document's words are hashed into a vector, the vector is projected to a few dimensions with fixed random signs, and
the point is numbered along a Hilbert curve. Documents stand in the order (curve number, id); their token ids, each with
an end id, form one stream in this order, cut every `length` tokens. Only the last sequence can hold padding.

The order is made on narrow rows (id, curve number, tokens) by a range partitioning; ranges learn their place in the
stream from the totals of the ranges before them, one row per partition. Ids are joined to their places afterwards.

Null and empty texts are documents of one token, the end id. An empty table has no sequences; a very long text has many pieces.
Other columns are not looked at. A repeated id is told apart by its place of reading.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.byte_bpe import BLOCK, coder
from lexweave.llm.common import stored, text_blocks

#: Hashed vector's size, projected dimensions and bits of each on the curve: 3 x 16 bits fit a long.
BUCKETS, DIMENSIONS, BITS = 256, 3, 16


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Number along the Hilbert curve of each row of non-negative integer coordinates below 2**bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess rotations and reflections from the highest bit down
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(documents: list[np.ndarray], vocabulary: int, seed: int = 7) -> np.ndarray:
    """Curve number of each document's token ids: hashed counts, square roots, a projection by random normals, and 2**BITS levels a dimension."""
    rng = np.random.default_rng(seed)
    bucket = rng.integers(0, BUCKETS, vocabulary)
    projection = rng.standard_normal((BUCKETS, DIMENSIONS))
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    owner = np.repeat(np.arange(len(documents)), sizes)
    ids = np.concatenate(documents).astype(np.int64) if len(documents) else np.zeros(0, np.int64)
    counts = np.bincount(owner * BUCKETS + bucket[ids], minlength=len(documents) * BUCKETS).reshape(-1, BUCKETS)
    vector = np.sqrt(counts)
    vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-12)
    place = 0.5 + 0.5 * np.tanh(vector @ projection / 2)  # to the open unit cube, monotone in each dimension
    return hilbert_key(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tokenised(df: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, curve, n, ids binary) of each document, ids as little-endian unsigned 16- or 32-bit numbers with the end id."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, special=True)
        for part in (b for p in parts for b in text_blocks(p, text_col, BLOCK)):
            found = c.encode(part.column(text_col))
            keys = curve_keys(found, len(c.tokens))
            end = np.array([end_id], dtype=c.kind).tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column(id_col), pa.array(keys), pa.array([len(x) + 1 for x in found], pa.int64()), pa.array([x.tobytes() + end for x in found], pa.binary())],
                names=["row", "id", "curve", "n", "ids"],
            )

    own = df.select(F.monotonically_increasing_id().alias("row"), id_col, text_col)
    return own.mapInArrow(run, f"row long, id {own.schema[id_col].dataType.simpleString()}, curve long, n long, ids binary")


def places(narrow: DataFrame) -> DataFrame:
    """(row, at): each document's first place in the stream, from rows (row, id, curve, n)."""
    spark = narrow.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = narrow.repartitionByRange(parts, "curve", "id", "row").sortWithinPartitions("curve", "id", "row")
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("part").agg(F.sum("n").alias("total"))  # a row per range
    before = before.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    running = F.sum("n").over(Window.partitionBy("part").orderBy("curve", "id", "row").rowsBetween(Window.unboundedPreceding, -1))
    within = ranged.select("part", "row", F.coalesce(running, F.lit(0)).alias("inside"))
    return within.join(F.broadcast(before), "part").select("row", (F.col("base") + F.col("inside")).alias("at"))


def pack(df: DataFrame, path: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of packed sequences: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids, ids array<int>).

    start counts the document's ids before the piece; offset is the piece's place in its sequence, without gaps from 0.
    """
    tokens = stored(tokenised(df, path, end_id, id_col, text_col), "tokens")
    at = places(tokens.select("row", "id", "curve", "n"))
    joined = tokens.select("row", "id", "n", "ids").join(at, "row").drop("row")
    kind = joined.schema["id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = coder(path, special=True).kind
        for part in (b for p in parts for b in text_blocks(p, "ids")):
            rows = []
            for k, (n, at, data) in enumerate(zip(part.column("n").to_pylist(), part.column("at").to_pylist(), part.column("ids").to_pylist(), strict=True)):
                ids = np.frombuffer(data, dtype=width).astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    rows.append((k, start, size, zlib.crc32(ids[start : start + size]), n, sequence, offset, ids[start : start + size].astype(np.int32) if with_ids else None))
                    start += size
            columns = list(zip(*rows, strict=True)) or [()] * 8
            arrays = [part.column("id").take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            if with_ids:
                arrays.append(pa.array(columns[7], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

    return joined.select("id", "n", "at", "ids").mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
