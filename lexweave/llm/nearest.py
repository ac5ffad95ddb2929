"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised separately, so K centroids a half make K*K cells. A query walks pairs of centroids in
the order of their summed distances, with a heap, until the cells passed hold `share` of all vectors and 50 k at least; the vectors in these
cells are reranked by their exact Euclidean distance in double precision.

Centroids come from a sample of at most SAMPLE vectors (those of smallest hashed id); every vector is indexed. Cells are
dealt to chunks of about CHUNK vectors (a crowded cell to several), and queries to the chunks that hold cells they passed,
in blocks of at most BLOCK queries, so that no task holds more than a chunk and a block. Cell counts, at most K*K numbers,
are all that the driver sees of the whole.

Vectors that are null, zero, or hold nulls or non-finite numbers take no part, nor do null ids; vectors of another length than
most have no distance to them and take no part either. An empty table has no neighbours. Every row is a candidate, repeated ones
too, but none with the query's own id. An id is one query, however often its row is repeated (with the smallest of its vectors).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import stored

CENTROIDS, SAMPLE, SHARE, CHUNK, BLOCK = 256, 10_000, 0.3, 4096, 20_000


def sound(c: Column) -> Column:
    """The vector can take part."""
    wrong = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(c) > 0) & ~wrong & F.exists(c, lambda x: x != 0), F.lit(False))


def centroids(x: np.ndarray, k: int, rounds: int = 20, seed: int = 11) -> np.ndarray:
    """Lloyd's k-means from distinct rows."""
    kinds = np.unique(x, axis=0)
    c = kinds[np.random.default_rng(seed).permutation(len(kinds))[:k]].copy()
    for _ in range(rounds):
        own = squared(x, c).argmin(axis=1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * x @ c.T, 0)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells in the order of summed distances, until they hold `wanted` vectors; each heap entry is the next pair of its row."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a], second[b]
    heap, out, held = [(float(da[0] + db[0]), 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        if j + 1 < len(b):
            heapq.heappush(heap, (float(da[i] + db[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (float(da[i + 1] + db[0]), i + 1, 0))
    return out


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the vectors; a vector of one component has a second half of zero."""
    if x.shape[1] == 1:
        return x, np.zeros_like(x)
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


def search(df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE, cells: int = CENTROIDS, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row whose id is divisible by `every`, the query's own id apart."""
    spark = df.sparkSession
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & sound(F.col("v")))
    sizes = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = sizes[0]["n"]
    own = own.where(F.size("v") == size)
    some = np.array([r[0] for r in own.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()], dtype=np.float64)
    c1, c2 = (centroids(h, cells) for h in halves(some))
    kind = own.schema["v"].dataType.simpleString()

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _matrix(part.column("v"), size)
            a, b = halves(x)
            cell = squared(a, c1).argmin(axis=1) * len(c2) + squared(b, c2).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

    index = stored(own.mapInArrow(place, f"id long, v {kind}, cell int"), "cells")
    counts = np.zeros(len(c1) * len(c2), dtype=np.int64)
    for r in index.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    wanted = max(share * counts.sum(), min(counts.sum(), 50 * k))

    # consecutive cells share a chunk until it is full; a cell beyond a chunk's size is spread over chunks of its own
    chunks: list[tuple[int, int, int]] = []
    at, held = 0, 0
    for cell in np.flatnonzero(counts).tolist():
        n = math.ceil(int(counts[cell]) / chunk)
        if n > 1 or held + int(counts[cell]) > chunk:
            at, held = at + (held > 0), 0
        chunks.append((cell, at, n))
        at, held = (at + n, 0) if n > 1 else (at, held + int(counts[cell]))
    of_cell = np.zeros((len(counts), 2), dtype=np.int64)
    for cell, first, n in chunks:
        of_cell[cell] = first, n
    dealt = F.broadcast(spark.createDataFrame(chunks, "cell int, first int, n int"))
    vectors = index.join(dealt, "cell").select("id", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("n"))).cast("int").alias("chunk"))
    queries = index.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks = math.ceil(max(1, queries.count()) / BLOCK)

    def probes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _matrix(part.column("v"), size)
            rows, chunk_ids, passed = [], [], []
            one, two = halves(x)
            for q, (a, b) in enumerate(zip(squared(one, c1), squared(two, c2), strict=True)):
                by_chunk: dict[int, list[int]] = {}
                for cell in walk(a, b, counts, wanted):
                    first, n = of_cell[cell].tolist()
                    for c in range(first, first + n):
                        by_chunk.setdefault(c, []).append(cell)
                rows += [q] * len(by_chunk)
                chunk_ids += by_chunk
                passed += by_chunk.values()
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("v").take(take), pa.array(chunk_ids, pa.int32()), pa.array(passed, pa.list_(pa.int32()))], names=["id", "v", "chunk", "passed"])

    asked = queries.mapInArrow(probes, f"id long, v {kind}, chunk int, passed array<int>").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    spread = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else vectors.withColumn("block", F.lit(0))

    def rerank(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        x, ids, cell = np.array(held["v"].tolist(), dtype=np.float64), held["id"].to_numpy(), held["cell"].to_numpy()
        out = []
        for query, v, passed in zip(asked["id"], asked["v"], asked["passed"], strict=True):
            use = np.flatnonzero(np.isin(cell, passed) & (ids != query))
            if len(use):
                d = np.sqrt(np.square(x[use] - np.asarray(v, dtype=np.float64)).sum(axis=1))
                best = np.lexsort((ids[use], d))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[use][best], "score": d[best]}))
        return pd.concat(out) if out else rerank(asked[:0], held)

    found = asked.groupBy("chunk", "block").cogroup(spread.groupBy("chunk", "block")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
