"""Language-model scoring from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to powers of two; a key of level l is put in the filter once for each level
from 1 to l, and its count is read back by asking for level 1, 2, ... until one is missing. Scoring interpolates pair and word
probabilities from such counts; the base score uses exact word counts.

The filter is in segments, and keys meet it where they are counted: each chunk of texts sends its different keys, with their
training counts, to their segments once; a segment's task adds the counts up, builds the segment with room for all keys and
reads the levels of all it was asked for back from it; the levels return to the chunk, where its texts are scored. So neither
the filter nor a table of words is ever held or sent whole, what is shuffled is bounded by the texts, and the plan is the same
at every size.

A text's tokens are its words, lower-cased in A-Z and cut at 0x20 and 0x09-0x0D, then one end. Null and empty texts have
the end only. Without training rows N and V are 0 and all counts too. Repeated rows count and are scored each; an empty table
gives an empty result; long texts are hashed in blocks of texts, one text at a time where it is longer than a block. Other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import held_out, stored, text_blocks

FOLD = 5
#: Pair weight, words of 64 bits a key, bits a key in a word.
WEIGHT, WORDS, PROBES = 0.6, 0.16, 5
LEVELS = 40
#: Bytes of text hashed at once (hashing holds some 50 bytes for each), of a chunk, and of training text a segment.
BLOCK, CHUNK, SEGMENT = 1 << 20, 10 << 20, 6 << 20

_rng = np.random.default_rng(20_24)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP, _FIRST, _SECOND, START, END = (int(x) | 1 for x in _rng.integers(0, 1 << 64, 5, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token of all texts in order, number of tokens of each text)."""
    texts = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    space = _SPACE[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = space[:-1]
    fresh[offsets[:-1]] = True
    inner = ~space
    starts = np.flatnonzero(inner & fresh[:-1])
    owner = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(owner, minlength=len(texts))
    out = np.empty(len(starts) + len(texts), np.uint64)
    ends = np.cumsum(words + 1) - 1
    out[ends] = END
    if len(starts):
        own = np.flatnonzero(inner)
        first = np.repeat(starts, np.diff(np.append(np.searchsorted(own, starts), len(own))))
        place = own - first
        powers = np.full(int(place.max()) + 1, _STEP, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        hashed = np.add.reduceat(_BYTE[_LOWER[data[own]]] * powers[place], np.searchsorted(own, starts))
        out[np.arange(len(starts)) + owner] = mix(hashed)
    return out, words + 1


def pairs(found: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the token before each token, START before a text's first; the hash of both)."""
    before = np.empty_like(found)
    before[1:] = found[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return before, mix(before * np.uint64(_FIRST) + found * np.uint64(_SECOND))


def chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Blocks of texts, as many together as hold CHUNK bytes."""
    held, size = [], 0
    for block in (b for p in parts for b in text_blocks(p, "text", BLOCK)):
        held.append(block)
        size += pc.sum(pc.binary_length(block.column("text"))).as_py() or 0
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def chunk_keys(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of all texts, number of each text's tokens, hashes of the pairs they end, then START for each text)."""
    found, sizes = (np.concatenate(x) for x in zip(*map(tokens, columns), strict=True))
    return found, sizes, np.append(pairs(found, sizes)[1], np.full(len(sizes), START, np.uint64))


def different(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys by segment and then by size, the first of each segment and the end, where each h is among them)."""
    kinds, inverse = np.unique(h.view(np.int64), return_inverse=True)
    segment = np.mod(kinds, segments)
    order = np.argsort(segment, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return kinds[order], np.searchsorted(segment[order], np.arange(segments + 1)), place[inverse]


def packed(n: np.ndarray) -> bytes:
    """Whole numbers byte by byte of their value: where all are small, what is above is zeros, which a shuffle's compression takes out."""
    return n.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


def packed_keys(keys: np.ndarray, segments: int) -> bytes:
    """A segment's keys in their order: the first, then how many segments further each is than the one before."""
    steps = keys.view(np.uint64).copy()
    steps[1:] = np.diff(steps) // np.uint64(segments)
    return packed(steps)


def unpacked_keys(data: bytes, segments: int) -> np.ndarray:
    steps = unpacked(data)
    steps[1:] *= np.uint64(segments)
    return np.cumsum(steps, dtype=np.uint64)


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, one more for each doubling."""
    return np.minimum(np.frexp(np.maximum(counts, 1).astype(np.float64))[1], LEVELS)


def count_of(levels: np.ndarray) -> np.ndarray:
    """A count from its level: 0, 1, else the level's middle on the logarithmic scale."""
    return np.where(levels <= 1, levels, np.exp2(levels - 0.5))


def _bits(h: np.ndarray, level: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bits in it) of a key at a level, in a segment of so many words."""
    g = mix(h + np.uint64(0x9E3779B97F4A7C15) * level.astype(np.uint64))
    word = (g >> np.uint64(32)) * words.astype(np.uint64) >> np.uint64(32)
    mask = np.zeros(len(g), np.uint64)
    for k in range(PROBES):
        mask |= np.uint64(1) << (g >> np.uint64(6 * k) & np.uint64(63))
    return word.astype(np.int64), mask


def build_segment(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The filter words of a segment's keys; repeated keys add up."""
    keys, inverse = np.unique(h, return_inverse=True)
    levels = level_of(np.bincount(inverse, weights=n).astype(np.int64))
    words = np.zeros(int(levels.sum() * WORDS) + 1, np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = keys[levels >= level]
        at, mask = _bits(own, np.full(len(own), level), np.full(len(own), len(words)))
        np.bitwise_or.at(words, at, mask)
    return words


def levels_in(h: np.ndarray, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Levels of keys by repeated probes; starts and sizes are each key's segment in words."""
    out = np.zeros(len(h), np.int64)
    left = np.flatnonzero(sizes > 0)
    for level in range(1, LEVELS + 1):
        if not len(left):
            break
        at, mask = _bits(h[left], np.full(len(left), level), sizes[left])
        left = left[words[starts[left] + at] & mask == mask]
        out[left] = level
    return out


def probability(pair: np.ndarray, before: np.ndarray, word: np.ndarray, n: int, v: int) -> np.ndarray:
    """Interpolated probability from levels of a pair, of the word before and of the word."""
    single = (count_of(word) + 0.5) / (n + 0.5 * (v + 1))
    double = np.minimum(count_of(pair) / np.maximum(count_of(before), 1), 1.0)
    return WEIGHT * double + (1 - WEIGHT) * np.minimum(single, 1.0)


def asked(numbered: DataFrame, segments: int) -> DataFrame:
    """(segment, chunk, of_words, keys, counts): the different words, and pairs, of each chunk with their training counts. A chunk is named by its first row."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in chunks(parts):
            found, sizes, double = chunk_keys([b.column("text") for b in blocks])
            learned = ~np.concatenate([b.column("held_out").to_numpy(zero_copy_only=False) for b in blocks])
            of_token = np.repeat(learned, sizes)
            for of_words, h, own in ((True, found, of_token), (False, double, np.append(of_token, learned))):
                keys, bounds, place = different(h, segments)
                n = np.bincount(place[own], minlength=len(keys))
                full = np.flatnonzero(np.diff(bounds))
                cuts = [slice(bounds[s], bounds[s + 1]) for s in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), blocks[0].column("row")[0].as_py())), pa.array([of_words] * len(full)), pa.array([packed_keys(keys[x], segments) for x in cuts], pa.binary()), pa.array([packed(n[x]) for x in cuts], pa.binary())],
                    names=["segment", "chunk", "of_words", "keys", "counts"],
                )

    return numbered.mapInArrow(run, "segment int, chunk long, of_words boolean, keys binary, counts binary")


def answered(questions: DataFrame, segments: int) -> DataFrame:
    """(segment, chunk, of_words, levels, counts) for each question: levels by the segment of the filter that all questions' counts build, exact counts of words; and a row without chunk: the segment's training tokens, and how many different ones."""
    def answer(group: pa.Table) -> pa.Table:
        keys = [unpacked_keys(x, segments) for x in group["keys"].to_pylist()]
        ends = np.cumsum([len(x) for x in keys])[:-1]
        of_words = group["of_words"].to_numpy()
        n = np.concatenate([unpacked(x) for x in group["counts"].to_pylist()]).astype(np.int64)
        kinds, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        word_n = n * np.repeat(of_words, [len(x) for x in keys])
        sums, exact = (np.bincount(inverse, weights=x).astype(np.int64) for x in (n, word_n))
        words = build_segment(kinds[sums > 0], sums[sums > 0])
        zero = np.zeros(len(kinds), np.int64)
        levels = levels_in(kinds, words, zero, zero + len(words)).astype(np.uint8)
        counts = [packed(x) if w else None for x, w in zip(np.split(exact[inverse], ends), of_words, strict=True)]
        return pa.table(
            {
                "segment": pa.array([group["segment"][0].as_py()] * (len(keys) + 1), pa.int32()), "chunk": pa.array([*group["chunk"].to_pylist(), None], pa.int64()), "of_words": pa.array([*of_words.tolist(), None], pa.bool_()),
                "levels": pa.array([*(x.tobytes() for x in np.split(levels[inverse], ends)), None], pa.binary()), "counts": pa.array([*counts, None], pa.binary()),
                "total": pa.array([None] * len(keys) + [int(exact.sum())], pa.int64()), "kinds": pa.array([None] * len(keys) + [int((exact > 0).sum())], pa.int64()),
            }
        )

    return questions.groupBy("segment").applyInArrow(answer, "segment int, chunk long, of_words boolean, levels binary, counts binary, total long, kinds long")


def sent_back(numbered: DataFrame) -> DataFrame:
    """(chunk, part, texts): the rows of each chunk, compressed, for the answers to meet them."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in chunks(parts):
            chunk = blocks[0].column("row")[0].as_py()
            for k, block in enumerate(blocks):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(block)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([k], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "part", "texts"])

    return numbered.mapInArrow(run, "chunk long, part int, texts binary")


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = FOLD, broadcast_bytes: int = 0, frequent: int = 0) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row. Nothing is broadcast any more: broadcast_bytes and frequent are taken, but change nothing."""
    own = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held_out(F.col(id_col), fold).alias("held_out"), F.col(text_col).alias("text"))
    # read twice, and the chunks must be the same both times
    numbered = stored(own, "numbered")
    segments = int(numbered.where(~F.col("held_out")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // SEGMENT) + 1
    answers = stored(answered(asked(numbered, segments), segments), "answers")
    total, kinds = answers.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    unit = float(np.log10(total + 0.5 * (kinds + 1)))

    def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
        blocks = [pa.ipc.open_stream(x).read_all().combine_chunks() for x in texts.sort_by("part")["texts"].to_pylist()]
        held = pa.concat_tables(blocks)
        found, sizes, double = chunk_keys([b["text"].chunk(0) for b in blocks])
        levels, counts = {}, np.zeros(0)
        for of_words, h in ((True, found), (False, double)):
            keys, _, place = different(h, segments)
            got = answers.filter(pc.equal(answers["of_words"], of_words)).sort_by("segment")
            levels[of_words] = np.frombuffer(b"".join(got["levels"].to_pylist()), np.uint8).astype(np.int64)
            if len(levels[of_words]) != len(keys):
                raise ValueError("the rows of a chunk changed between two readings of one table")
            levels[of_words] = levels[of_words][place]
            if of_words:
                counts = np.concatenate([unpacked(x) for x in got["counts"].to_pylist()]).astype(np.int64)[place]
        begin = np.cumsum(sizes) - sizes
        # the word before is the text's own, one place on; START for a text's first
        single, ahead = levels[True], np.empty_like(levels[True])
        ahead[1:] = single[:-1]
        ahead[begin] = levels[False][len(found) :]
        p = probability(levels[False][: len(found)], ahead, single, total, kinds)
        return pa.table(
            {
                "id": held["id"], "held_out": held["held_out"], "n_tokens": pa.array(sizes.astype(np.int64)), "n_known": pa.array(np.add.reduceat((counts > 0).astype(np.int64), begin)), "train_tokens": pa.array(np.full(len(sizes), total, np.int64)),
                "base_score": pa.array(np.add.reduceat(np.log10(counts + 0.5), begin) - sizes * unit), "score": pa.array(np.add.reduceat(np.log10(p), begin)),
            }
        )

    kind = own.schema["id"].dataType.simpleString()
    return (
        sent_back(numbered).groupBy("chunk").cogroup(answers.where("chunk is not null").select("chunk", "segment", "of_words", "levels", "counts").groupBy("chunk"))
        .applyInArrow(scored, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
