"""Splitting texts into chunks and packing texts into bounded batches, in a stated order.

Packing is greedy and so sequential in its order, but what a range of the order needs from the one before is only how full the
last batch is. Each range tells what it makes of any number of leading items that still belong there; the driver links these
answers, one row a range, and every range then numbers its batches by itself. The result is that of one sequential pass.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import strip, text
from lexweave.storage import stored

_SENTENCE = re.compile(r"(?<=[。！？!?…])")


def length_class(chars: Column, short: int = 30, long: int = 200) -> Column:
    """0 short, 1 medium, 2 long."""
    return F.when(chars <= short, 0).when(chars <= long, 1).otherwise(2)


def effective_items(texts: Column, items: Column, eligible: Column, most: Column, large: int = 2000) -> Column:
    """Batch size of large inputs with providers that take them: doubled, 8 at least, most at most."""
    grown = F.least(most, F.greatest(items, F.least(most, F.greatest(F.lit(8), 2 * items))))
    return F.when((texts >= large) & eligible, grown).otherwise(items)


def _limits(items: int, chars: int, fast: tuple[int, int] | None) -> dict[int, tuple[int, int]]:
    """(items, characters) of a batch by class."""
    if fast:
        base, width = min(max(items, 1), fast[0]), max(chars, fast[1])
        return {0: (min(2 * base, 32), 2 * width), 1: (base, width), 2: (1, 0)}
    return {0: (min(2 * items, 20), 2 * chars), 1: (items, chars), 2: (1, 0)}


def _jumps(sizes: np.ndarray, most: int, width: int) -> np.ndarray:
    """For a batch that starts at each item: where the next one starts, or the number of items if the batch is still open."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    full = np.searchsorted(total, total[:-1] + width, side="left") - 1  # the item that brings it to the width
    return np.minimum(np.minimum(np.arange(n) + most, np.maximum(full, np.arange(n) + 1)), n)


def _segments(group: pd.DataFrame) -> list[tuple[int, int]]:
    """Starts and ends of the runs of one lane and class in sorted rows."""
    change = (group["lane"] != group["lane"].shift()) | (group["class"] != group["class"].shift())
    starts = np.flatnonzero(change.to_numpy())
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True))


def _outcome(sizes: np.ndarray, most: int, width: int, leading: int) -> tuple[list[int], list[int], list[int]]:
    """After each number of leading items, below `leading`, that aren't its own: batches begun, and the open batch's items and characters."""
    jumps, n = _jumps(sizes, most, width), len(sizes)
    begun, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        j = jumps[i]
        begun[i], last[i] = (1, i) if j >= n else (1 + begun[j], last[j])
    k = min(n, leading)
    total = np.concatenate([[0], np.cumsum(sizes)])
    return begun[:k].tolist(), (n - last[:k]).tolist(), (total[n] - total[last[:k]]).tolist()


def packed(df: DataFrame, lane: str, order: str, text_col: str, items: int, chars: int, short: int = 30, long: int = 200, fast: tuple[int, int] | None = None) -> DataFrame:
    """df's lane and order with class, batch (from 0 in its lane and class) and n_chars.

    A batch closes when it holds its class's items, or when the next text would bring it to the class's characters or more;
    long texts stand alone. Short texts get twice the items (20 at most; 32 with fast limits) and characters.
    fast: (items, characters) of large inputs. Batches of a lane run short, medium, long. Ties of the order are broken by size.
    """
    limits = _limits(items, chars, fast)
    own = df.select(F.col(lane).alias("lane"), F.col(order).alias("ord"), F.length(text(F.col(text_col))).alias("n_chars"))
    own = own.withColumn("class", length_class(F.col("n_chars"), short, long))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(own.repartitionByRange(parts, "lane", "class", "ord", "n_chars").withColumn("part", F.spark_partition_id()), "batch-ranges")
    lane_type, ord_type = (own.schema[c].dataType.simpleString() for c in ("lane", "ord"))
    sort = ["lane", "class", "ord", "n_chars"]

    def summary(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(sort, kind="stable")
        runs = _segments(group)
        rows = []
        for k in sorted({0, len(runs) - 1}):
            a, b = runs[k]
            most, width = limits[int(group["class"].iloc[a])]
            sizes = group["n_chars"].to_numpy()[a:b].astype(np.int64)
            begun, n, total = _outcome(sizes, most, width, most + 1)
            rows.append((int(group["part"].iloc[0]), k, len(runs), group["lane"].iloc[a], int(group["class"].iloc[a]), sizes[: most + 1].tolist(), b - a, begun, n, total))
        return pd.DataFrame(rows, columns=["part", "k", "runs", "lane", "class", "head", "size", "begun", "n", "total"])

    told = ranged.groupBy("part").applyInPandas(summary, f"part int, k int, runs int, lane {lane_type}, class int, head array<long>, size long, begun array<long>, n array<long>, total array<long>")
    # entry of each range's first run: (number of the batch it continues, its leading items), carried from range to range
    entry: dict[int, tuple[int, int]] = {}
    held: tuple | None = None  # (lane, class) of the last run, batches begun so far, open items, open characters
    for r in sorted(told.collect(), key=lambda r: (r["part"], r["k"])):
        most, width = limits[r["class"]]
        batches, n, total, e = 0, 0, 0, 0
        if held and r["k"] == 0 and held[0] == (r["lane"], r["class"]):
            _, batches, n, total = held
            while e < len(r["head"]) and n < most and total + r["head"][e] < width:
                n, total, e = n + 1, total + r["head"][e], e + 1
            entry[r["part"]] = (batches, e)
        if e < r["size"]:
            batches, n, total = batches + r["begun"][e], r["n"][e], r["total"][e]
        held = ((r["lane"], r["class"]), batches, n, total)

    def number(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(sort, kind="stable")
        out = np.zeros(len(group), np.int64)
        for k, (a, b) in enumerate(_segments(group)):
            most, width = limits[int(group["class"].iloc[a])]
            base, e = entry.get(int(group["part"].iloc[0]), (0, 0)) if k == 0 else (0, 0)
            starts = np.zeros(b - a, np.int64)
            jumps, i = _jumps(group["n_chars"].to_numpy()[a:b].astype(np.int64), most, width), e
            while i < b - a:
                starts[i] = 1
                i = int(jumps[i])
            out[a:b] = base + np.cumsum(starts) - 1
        return group.assign(batch=out)[["lane", "ord", "n_chars", "class", "batch"]]

    return ranged.groupBy("part").applyInPandas(number, f"lane {lane_type}, ord {ord_type}, n_chars int, class int, batch long")


def batch_statistics(batches: DataFrame) -> DataFrame:
    """(lane, class, texts, batches, chars)."""
    return batches.groupBy("lane", "class").agg(F.count("*").alias("texts"), (F.max("batch") + 1).alias("batches"), F.sum("n_chars").alias("chars"))


def resplit(batches: DataFrame, limit: int) -> DataFrame:
    """(batch, part, pos, ...) of queued batches (batch, pos) cut anew to a smaller limit: the head first, the rest in order."""
    return batches.withColumn("part", F.floor(F.col("pos") / max(1, limit)).cast("int")).withColumn("pos", F.col("pos") % max(1, limit))


def split_text(value: str, size: int) -> list[str]:
    """Pieces of at most size characters: lines, and sentences of longer lines, joined by line ends while they fit."""
    value = value.strip()
    if len(value) <= size:
        return [value] if value else []
    out: list[str] = []
    held = ""
    for line in filter(None, value.split("\n")):
        parts = [line] if len(line) <= size else [s for s in map(str.strip, _SENTENCE.split(line)) if s]
        for part in parts:
            if held and len(held) + 1 + len(part) > size:
                out.append(held)
                held = ""
            if len(part) > size:
                out += [part[k : k + size] for k in range(0, len(part), size)]
            else:
                held = f"{held}\n{part}" if held else part
    return out + [held] if held else out


def chunks(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, pos, chunk) of each text's pieces."""
    @F.pandas_udf("array<string>")
    def cut(column: pd.Series) -> pd.Series:
        return column.fillna("").map(lambda t: split_text(t, size))

    return df.select(F.col(id_col).alias("id"), F.posexplode(cut(F.col(text_col))).alias("pos", "chunk"))


def sample_in_order(df: DataFrame, lane: str, order: str, text_col: str, most: int = 120, chars: int = 30_000) -> DataFrame:
    """Of each lane's different texts in order of first sight, those before the first that exceeds a limit; the first always."""
    first = df.where(strip(text(F.col(text_col))) != "").groupBy(F.col(lane).alias("lane"), F.col(text_col).alias("text")).agg(F.min(order).alias("ord"))
    w = Window.partitionBy("lane").orderBy("ord", "text")
    # the limit of places first, so that each task keeps only so many of a lane before they meet
    early = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(1, most))
    seen = early.withColumn("total", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.where((F.col("n") == 1) | (F.col("n") <= most) & (F.col("total") <= chars)).select("lane", "ord", "text", "n", "total")
