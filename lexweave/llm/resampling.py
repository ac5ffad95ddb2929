"""Target-distribution importance resampling over hashed word runs.

One scan of a text keeps a ring of running zlib CRC states, one for each of the last n starts. A word extends each state by a
space and itself, and begins a state of its own; every state then is the CRC of a run of words, modulo the number of buckets
its feature. A document's weight is the sum over its features of how much likelier their buckets are in the target than in the
corpus; adding Gumbel noise from a hash of the id and taking the highest scores draws without replacement.

Only A-Z are lower-cased; words are runs of digits, a-z and anything beyond ASCII. A null or empty text has no features and weight
0, and is not drawn. Repeated rows are documents each, their ties settled by id, then by the order they were read in; a null id
is hashed as an empty one and comes after all others. An empty corpus gives an empty result, an empty target equal counts of none.
Columns other than id and text are not looked at, whatever they are called. A very long text is scanned whole, one at a time.

The scan's buckets are written once; counts are added up in each task before a shuffle of at most `buckets` rows a task, and the
gains sent to the tasks are one number a bucket, MOST_BUCKETS at most. Ranks come from ranges of (score, id): a row per
range, never one task, tells where the range begins.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import LOWER, UPPER, batches, dropped, stored, text_blocks

MOST_BUCKETS = 1 << 20
#: In UTF-8, lower-cased: what the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] leaves.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def runs(words: list[bytes], n: int) -> list[int]:
    """CRCs of all runs of 1 to n words, joined by one space: those that end in the first word, then in the second, and so on, longest first."""
    if n == 1:
        return list(map(zlib.crc32, words))
    ring: deque[int] = deque()
    out: list[int] = []
    for word in words:
        if len(ring) == n:
            ring.popleft()
        spaced = b" " + word
        ring = deque(zlib.crc32(spaced, state) for state in ring)
        ring.append(zlib.crc32(word))
        out.extend(ring)
    return out


def features(df: DataFrame, n: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_words, buckets array<int>) of each document; row numbers the rows as they were read."""
    if not 0 < buckets <= MOST_BUCKETS or n < 1:
        raise ValueError(f"runs of one word or more, and 1 to {MOST_BUCKETS} buckets")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b for p in parts for b in text_blocks(p, "text")):
            sizes, found = [], []
            for text in batches(part.column("text")):
                words = WORD.findall(text.encode().lower())
                sizes.append(len(words))
                found.append((np.array(runs(words, n), np.uint32) % buckets).astype(np.int32))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(sizes, pa.int64()), lists], names=["row", "id", "n_words", "buckets"])

    own = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"row long, id {own.schema['id'].dataType.simpleString()}, n_words long, buckets array<int>")


def bucket_counts(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how many features fall in each bucket."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in parts:
            total += np.bincount(part.column(0).flatten().to_numpy(), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over its share of the corpus; at most `buckets` rows of each come here."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, df in ((s, corpus), (t, target)):
        for bucket, n in df.collect():
            counts[bucket] = n
    all_s, all_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, id, n_words, n_features, weight): the sum of the gains of each document's features."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column("buckets")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            sums = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "id", "n_words")), pa.array(sizes), pa.array(sums[ends] - sums[ends - sizes])], names=["row", "id", "n_words", "n_features", "weight"])

    own = found.select("row", "id", "n_words", "buckets")
    return own.mapInArrow(run, f"row long, id {own.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def drawn(weights: DataFrame, percent: int, least_words: int, seed: int) -> DataFrame:
    """(id, n_features, weight, score, rank): rank of the documents drawn, highest score first, null for the others.

    Drawn are percent of the documents with least_words words at least, rounded down.
    """
    spark = weights.sparkSession
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weights.withColumn("score", F.col("weight") + noise).withColumn("member", F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    ranged = scored.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for part in parts:
            place = before + np.cumsum(part.column("member").to_numpy(zero_copy_only=False).astype(np.int64))
            before = int(place[-1]) if len(place) else before
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(place)], names=[*part.schema.names, "place"])

    own = ranged.select("id", "n_features", "weight", "score", "member", F.spark_partition_id().alias("part"))
    numbered = stored(own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, n_features long, weight long, score long, member boolean, part int, place long"), "scores")
    ranges = numbered.groupBy("part").agg(F.max("place").alias("n")).orderBy("part").collect()  # a row per range
    ends = np.cumsum([r.n for r in ranges]).tolist()
    base = spark.createDataFrame([(r.part, end - r.n) for r, end in zip(ranges, ends, strict=True)], "part int, base long")
    at = F.col("base") + F.col("place")
    most = percent * (ends[-1] if ends else 0) // 100
    return numbered.join(F.broadcast(base), "part", "left").select("id", "n_features", "weight", "score", F.when(F.col("member") & (at <= most), at).alias("rank"))


def resample(df: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every document of df, drawn towards the texts of target."""
    found = stored(features(df, n, buckets, id_col, text_col), "features")
    wanted = features(target.select(F.lit(0).alias("id"), F.col(target_col).alias("text")), n, buckets, "id", "text")
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets), buckets)
    out = drawn(weighed(found, gain), percent, least_words, seed)
    dropped(found)  # its scores are written
    return out


def crc32_sql(text: str) -> str:
    """DuckDB's expression for the unsigned CRC-32 of a text's UTF-8 bytes: what a byte adds is linear in its bits."""
    def step(state: int) -> int:
        for _ in range(8):
            state = state >> 1 ^ (0xEDB88320 if state & 1 else 0)
        return state

    bit = [f"((xor(c, b) >> {k}) & 1) * {step(1 << k)}" for k in range(8)]
    added = "c >> 8"
    for x in bit:
        added = f"xor({added}, {x})"
    digits = "'0123456789ABCDEF'"
    octets = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: CAST(16 * (instr({digits}, substr(hex({text}), i, 1)) - 1) + instr({digits}, substr(hex({text}), i + 1, 1)) - 1 AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: {added}, CAST(4294967295 AS BIGINT)), 4294967295)"


#: The same by DuckDB over documents and benchmark, in the columns of the query.
SQL = rf"""
WITH split AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
aimed AS (SELECT unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
coded AS (SELECT word, {crc32_sql('word')} % 10000 AS bucket FROM (SELECT word FROM split UNION SELECT word FROM aimed)),
s AS (SELECT bucket, count(*) AS s FROM split JOIN coded USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aimed JOIN coded USING (word) GROUP BY bucket),
whole AS (SELECT (SELECT count(*) FROM split) AS all_s, (SELECT count(*) FROM aimed) AS all_t),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), whole),
weights AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM split JOIN coded USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS members FROM scored)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN n_features >= 20 AND place <= 10 * members // 100 THEN place END AS BIGINT) AS rank FROM ranked
"""
