"""Toxicity by compression distance with two zstandard dictionaries.

The toxic dictionary is made of toxic text's own words, those that ordinary text hardly has, then ordinary text; the ordinary
dictionary holds the same ordinary text behind as many bytes that match nothing. Whole toxic passages in the toxic dictionary, or
a dictionary that zstandard trains on toxic texts, were tried and find less (README): what tells toxic text is a word in twenty,
and chance matches of all the other words, and near copies of whole passages, outweigh it. Texts are coded before: each byte of a word is followed by a hash byte of the
word's beginning up to it, so that a match is a common beginning of words and saves enough to stand out in a few windows.
Each window is compressed with both: what the toxic dictionary saves is the window's distance. A document's mean, largest and mean positive distance go through a logistic calibration.

What marks toxic text is found in the labelled sample: beginnings of words at least `ODDS` times as frequent in toxic as in
other texts, counted once per preceding word (so that near copies of one text count once), and lengthened while nearly all
occurrences go on alike. The model learns from at most SAMPLE labelled texts a class, those of smallest hashed id, none
longer than LONGEST characters; every text is scored whole.

Nulls count as empty; an empty text has distance zero. An empty table gives an empty result, very long texts are scored whole,
window by window. Without labels of both classes the score is the share of toxic
labels (0 without any). Several labels of one id: the largest counts. Repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import batches, held_out, text_blocks

SAMPLE, LONGEST = 3000, 20_000
ODDS, ORDINARY, WINDOW, LEVEL, MATCH, SLACK = 20, 16_000, 128, 9, 5, 3
#: Longest mark in bytes, with its space. A mark stands behind so many different words at least: a twentieth of the toxic texts, between these.
MARK, LEAST = 41, (3, 15)
FOLD, THRESHOLD = 3, 0.7

_OTHER = re.compile(rb"[\x00-@\[-`{-\x7f]+")


def plain(text: str) -> bytes:
    """Lower-cased words, each behind one space."""
    return _OTHER.sub(b" ", b" " + text.encode().lower())


def _powers(base: int, n: int = 1 << 18) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def coded(data: bytes) -> bytes:
    """Each byte, then a hash byte of its word's beginning up to it; words start at spaces. Twice as long as data."""
    b, n = np.frombuffer(data, np.uint8), len(data)
    if n > len(_UP):
        return b"".join(coded(data[k : k + len(_UP)]) for k in range(0, n, len(_UP)))
    if not n:
        return b""
    total = np.cumsum(b * _UP[:n])
    starts = np.flatnonzero(b == 32)
    if not len(starts) or starts[0]:
        starts = np.append(0, starts)
    first = np.repeat(starts, np.diff(np.append(starts, n)))
    h = (total - np.where(first > 0, total[first - 1], np.uint64(0))) * _DOWN[first]
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    out = np.empty(2 * n, np.uint8)
    out[::2], out[1::2] = b, (h >> np.uint64(56)).astype(np.uint8)
    return out.tobytes()


def cuts(data: bytes, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Windows that end before spaces, at most size bytes long; a longer word is cut anywhere."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            space = data.rfind(b" ", at + 1, end)
            end = space if space > at else end
        else:
            end = len(data)
        yield at, end
        at = end


def beginnings(texts: list[str]) -> Counter:
    """Beginnings of words (with the space, from 4 bytes) by the number of different words before them."""
    seen, counts = set(), Counter()
    for text in texts:
        before = b""
        for word in plain(text).split():
            word = b" " + word
            for n in range(4, min(len(word), MARK) + 1):
                key = hash((before, word[:n]))
                if key not in seen:
                    seen.add(key)
                    counts[word[:n]] += 1
            before = word
    return counts


def marks(toxic: list[str], other: list[str]) -> list[bytes]:
    """What marks toxic text, the most frequent last (nearest to the window)."""
    own, rest = beginnings(toxic), beginnings(other)
    least = min(max(len(toxic) // 20, LEAST[0]), LEAST[1])
    chosen: list[bytes] = []
    after: dict[bytes, list[bytes]] = {}
    for g in own:
        after.setdefault(g[:-1], []).append(g)
    rare = lambda g: own[g] / len(toxic) > ODDS * (rest[g] + 0.5) / len(other)
    for g in sorted((g for g, n in own.items() if n >= least and rare(g)), key=lambda g: (len(g), g)):
        if any(g.startswith(c) or c.startswith(g) for c in chosen):
            continue
        while longer := [h for h in after.get(g, ()) if own[h] >= 0.9 * own[g]]:
            g = longer[0]
        chosen.append(g)
    return sorted(chosen, key=lambda g: (own[g], g))


@dataclass
class Model:
    """Both dictionaries, and the calibration of the three distances."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def distances(self) -> Distances:
        return Distances(self.toxic, self.ordinary)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + x @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Distances:
    """Compressors of a worker."""

    def __init__(self, *dictionaries: bytes):
        self.own = []
        for d in dictionaries:
            parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(d), source_size=2 * WINDOW, min_match=MATCH, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            made = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(compression_params=parameters)
            self.own.append(zstandard.ZstdCompressor(dict_data=made, compression_params=parameters).compress)

    def __call__(self, text: str) -> tuple[float, float, float]:
        """Mean, largest and mean positive distance over the windows of a whole text."""
        toxic, ordinary = self.own
        n, total, most, positive = 0, 0, 0, 0
        data = plain(text)
        code = coded(data)
        for a, b in cuts(data):
            w = code[2 * a : 2 * b]
            d = len(ordinary(w)) - len(toxic(w))
            n, total, most, positive = n + 1, total + d, max(most, d), positive + max(0, d - SLACK)
        return (total / n, float(most), positive / n) if n else (0.0, 0.0, 0.0)


def calibrated(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 50) -> tuple[float, ...]:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), x / scale])
    beta = np.zeros(z.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return (float(beta[0]), *(beta[1:] / scale).tolist())


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on labelled rows that aren't held out: at most `sample` of each class come to the driver."""
    told = labels.where(~held_out(F.col(id_col), FOLD)).groupBy(id_col).agg(F.max(label_col).alias("label")).where("label in (0, 1)")
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= LONGEST)
    narrow = known.select("id").join(told, known["id"] == told[id_col]).select("id", "label").distinct()
    counts = {r[0]: r[1] for r in told.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        share = 1 - 1e-9 if counts.get(1) else 1e-9
        return Model(b"\0" * 8, b"\0" * 8, (math.log(share / (1 - share)), 0.0, 0.0, 0.0))
    # ids are chosen on narrow rows; then only the chosen texts, at most 2 * sample, leave the scan
    chosen = [r for c in (0, 1) for r in narrow.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, narrow.schema))
    texts = known.join(wanted, "id").select("label", "text", F.xxhash64("id").alias("order")).collect()
    texts.sort(key=lambda r: (r["order"], r["text"]))
    classes = [[r["text"] for r in texts if r["label"] == c] for c in (0, 1)]
    other, toxic = (list(dict.fromkeys(c)) for c in classes)
    if not other or not toxic:
        share = counts[1] / (counts[0] + counts[1])
        return Model(b"\0" * 8, b"\0" * 8, (math.log(share / (1 - share)), 0.0, 0.0, 0.0))
    mark = coded(b"".join(marks(toxic, other)))
    every = max(1, sum(map(len, other)) // (8 * ORDINARY))
    pieces = [data[a:b] for data in map(plain, other) for a, b in cuts(data, 256)][::every]
    ordinary = b"".join(map(coded, pieces))[: 2 * ORDINARY]
    model = Model(mark + ordinary, b"\0" * len(mark) + ordinary)
    found = model.distances()
    x = np.array([found(t) for t in other + toxic])
    y = np.array([0.0] * len(other) + [1.0] * len(toxic))
    w = np.where(y == 1, counts[1] / len(toxic), counts[0] / len(other))
    model.weights = calibrated(x, y, w * len(w) / w.sum())
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs's columns, then score double and predicted int; columns of these two names in docs are replaced."""
    names, schema = docs.columns, docs.schema.simpleString().removeprefix("struct<").removesuffix(">")
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    place = [c.lower() for c in names].index(text_col.lower())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model.distances()
        # the text is in the row: sent beside it, it would take its place twice in Spark and in the worker
        pairs = (pa.RecordBatch.from_arrays([p.column("row"), p.column("row").field(place)], names=["row", "text"]) for p in parts)
        for part in (b for p in pairs for b in text_blocks(p, "text")):
            x = np.array([found(t) for t in batches(part.column("text"))]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(model.score(x))], names=["row", "score"])

    out = wide.mapInArrow(run, f"row struct<{schema}>, score double")
    kept = [F.col(f"row.`{c}`") for c in names if c not in ("score", "predicted")]
    return out.select(*kept, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
