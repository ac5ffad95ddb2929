"""SimHash near-duplicates with a pigeonring filter.

A fingerprint is a ring of segments. If two fingerprints differ in at most k bits over m segments, some segment starts a
chain in which every prefix of j segments differs in at most j*k/m bits. The first segments of the chain are the key of an
equality join: one side holds the key as it is, the other tries every key within the budgets. Candidates then need a whole
chain within its budgets before the full Hamming distance is taken.

Equal fingerprints are one row throughout. A key that very many fingerprints share is not paired out: whatever looks up
such a key is instead linked through the points within half the distance of it (two fingerprints at most two bits apart
share a point at most one bit from each), which is linear in the group and loses no link.

Null texts count as empty; a text without words has fingerprint zero; fewer words than a shingle make one shingle. Repeated rows
have one fingerprint and one group; an empty table gives an empty result; very long texts are hashed in parts. Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import batches, components, dropped, stored, text_blocks

SEED, SEGMENTS, CHAIN = 42, 4, 2
#: Fingerprints under one key beyond which it is linked through midpoints.
CROWD = 64


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words (repeats included), words lower-cased in A-Z and cut at space and 0x09-0x0D."""
    found = text.encode().lower().split()  # on bytes: exactly A-Z, and exactly these separators
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[words - 1 :].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(ends)].tolist(), ends, strict=True)], dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """64 booleans, lowest bit first: set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 18):
        part = np.ascontiguousarray(hashes[k : k + (1 << 18)])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * total > len(hashes)


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of each row; fp holds the unsigned fingerprint's bits."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b for p in parts for b in text_blocks(p, text_col)):
            bits = [majority_bits(shingle_hashes(t, words)) for t in batches(part.column(text_col))]
            fp = np.packbits(np.array(bits, dtype=np.uint8).reshape(-1, 64), axis=1, bitorder="little").view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(fp, pa.int64())], names=["id", "fp"])

    own = df.select(id_col, text_col)
    return own.mapInArrow(run, f"id {own.schema[id_col].dataType.simpleString()}, fp long")


def chain_masks(k: int, segments: int, chain: int) -> list[int]:
    """Differences, as bits over the chain's segments (lowest first), within the budget j*k/segments after each segment j."""
    width = 64 // segments
    masks = [(0, 0)]
    for j in range(1, chain + 1):
        grown = []
        for mask, n in masks:
            parts = [(0, 0)]
            for _ in range(j * k // segments - n):
                parts = sorted({*parts, *((p | 1 << b, bin(p | 1 << b).count("1")) for p, _ in parts for b in range(width))})
            grown += [(mask | p << width * (j - 1), n + c) for p, c in parts if n + c <= j * k // segments]
        masks = grown
    return [m for m, _ in masks]


def _segment(fp: Column, i: int, segments: int) -> Column:
    width = 64 // segments
    return F.shiftrightunsigned(fp, width * (i % segments)).bitwiseAND((1 << width) - 1)


def _key(fp: Column, start: int, segments: int, chain: int) -> Column:
    """The chain's segments as one number of at most 60 bits, with its start above them."""
    width = 64 // segments
    out = F.lit(start).cast("long") * F.lit(1 << width * chain)
    for j in range(chain):
        out = out + _segment(fp, start + j, segments) * F.lit(1 << width * j)
    return out


def _ring_passes(diff: Column, k: int, segments: int) -> Column:
    """Some segment starts a chain round the ring all of whose prefixes keep their budgets."""
    d = [F.bit_count(_segment(diff, i, segments)) for i in range(segments)]
    passes = F.lit(False)
    for i in range(segments):
        total, good = F.lit(0), F.lit(True)
        for j in range(segments):
            total = total + d[(i + j) % segments]
            good = good & (total * segments <= (j + 1) * k)
        passes = passes | good
    return passes


def links(distinct: DataFrame, k: int = 2, segments: int = SEGMENTS, chain: int = CHAIN, crowd: int = CROWD) -> DataFrame:
    """Links (a, b), as fingerprints, that connect exactly the different fingerprints at most k bits apart (k at most 2).

    distinct: one row per fingerprint, column fp.
    """
    if not 0 <= k <= 2 or segments <= k or chain >= segments or 64 % segments:
        raise ValueError("links needs k of 0 to 2, more segments than k, and a chain shorter than the ring")
    starts = range(segments)
    index = distinct.select("fp", F.explode(F.array(*[_key(F.col("fp"), i, segments, chain) for i in starts])).alias("key"))
    probe = distinct.select("fp", F.explode(F.array(*[_key(F.col("fp"), i, segments, chain) for i in starts])).alias("own"))
    probe = probe.select("fp", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in chain_masks(k, segments, chain)]), lambda m: F.col("own").bitwiseXOR(m))).alias("key"))
    sizes = index.groupBy("key").agg(F.count("*").alias("size"))
    crowded = stored(sizes.where(F.col("size") > crowd).select("key"), "crowded")
    light = index.join(crowded, "key", "left_anti").withColumnRenamed("fp", "b")
    diff = F.col("fp").bitwiseXOR(F.col("b"))
    paired = (
        probe.join(light, "key")
        .where(F.col("fp") != F.col("b"))
        .where(_ring_passes(diff, k, segments))
        .where(F.bit_count(diff) <= k)
        .select(F.greatest("fp", "b").alias("a"), F.least("fp", "b").alias("b"))
        .distinct()
    )
    near = probe.join(crowded, "key", "left_semi").select("fp").distinct()
    points = near.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64 if b == 63 else 0))) for b in range(64)])).alias("point"))
    if k < 2:
        # one bit apart: the two ends themselves are the only common points; with k of 0 different fingerprints have no links
        points = points.where(F.lit(k == 1))
    hubs = points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n"))
    if k == 1:
        hubs = hubs.join(near.select(F.col("fp").alias("point")), "point", "left_semi").withColumn("b", F.col("point"))
    starred = points.join(hubs.where("n > 1"), "point").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct()
    return paired.union(starred)


def near_groups(df: DataFrame, words: int = 3, k: int = 2, id_col: str = "doc_id", text_col: str = "text", segments: int = SEGMENTS, chain: int = CHAIN, crowd: int = CROWD) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links of at most k differing bits."""
    fps = stored(fingerprints(df, words, id_col, text_col), "fingerprints")
    kinds = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "kinds")
    joined = components(stored(links(kinds.select("fp"), k, segments, chain, crowd), "links"), "near")
    grouped = kinds.join(joined, kinds.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(grouped.join(smallest, "component").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Tables and minima a table of the stars; one text in so many counts shingles, and so many counts are kept, for the order of
#: shingles; length of the chains of the ring filter. All change the work only, never the result.
STARS, MINIMA = 8, 3
EVERY, COMMON = 16, 500_000
RING = 4
#: Ids sent to every worker at most when texts are looked up.
SENT = 200_000


def common_shingles(own: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of shingles that several texts of a sample hold; own has the column text."""
    sample = own.where(F.pmod(F.xxhash64("text"), F.lit(EVERY)) == 0).groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b for p in parts for b in text_blocks(p, "text")):
            for t in batches(part.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, words)).view(np.int64))], names=["key"])

    counts = sample.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "key").limit(COMMON).toPandas()
    hashes = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["n"].to_numpy(np.int64)[order]


def rarest(hashes: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many shingles, rarest first, that two sets of at least this similarity share one of them; hashes are ascending."""
    if not len(hashes):
        return hashes
    length = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1
    if not len(common):
        return hashes[:length]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return hashes[np.lexsort((hashes, np.where(common[at] == hashes, counts[at], 0)))[:length]]


def candidates(rows: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of rows under one key whose sets can have the similarity, unless one component holds both.

    Rows are sorted by key and n. With the first shingle that two sets share at places pa and pb of theirs, they share at most
    1 + the fewer of those after it; the smaller set must have enough of its own left, so only such rows are looked up.
    """
    key, n, at = (rows.column(c).to_numpy() for c in ("key", "n", "at"))
    c = rows.column("c").combine_chunks().dictionary_encode().indices.to_numpy()
    left, share = n - at, similarity / (1 + similarity)
    active = np.flatnonzero(left >= 2 * share * n - 1e-9)
    for d in range(1, len(key)):
        active = active[active < len(key) - d]
        active = active[(key[active] == key[active + d]) & (n[active] >= similarity * n[active + d] - 1e-9)]
        if not len(active):
            break
        other = active + d
        good = (c[active] != c[other]) & (np.minimum(left[active], left[other]) >= share * (n[active] + n[other]) - 1e-9)
        if good.any():
            yield active[good], other[good]


def parity_bits(hashes: np.ndarray) -> bytes:
    """A set's wide fingerprint: at least two bits a shingle, each the parity of how many shingles fall on it; a power of two of 64-bit segments.

    Two sets differ in at least as many shingles as their fingerprints differ in bits. Half of the bits folded onto the other
    half by xor are the fingerprint of half the width.
    """
    bits = 64
    while bits < 2 * len(hashes):
        bits *= 2
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def ring_passes(a: bytes, b: bytes, most: float, chain: int = RING) -> bool:
    """Two wide fingerprints can belong to sets that differ in at most `most` shingles.

    The fingerprints are rings of segments. By the pigeonring principle some segment starts a chain in which every prefix of j
    segments differs in at most j * most / segments bits; chains of `chain` segments are asked for before all bits are counted.
    """
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    d = np.bitwise_count(x ^ y).astype(np.int64)
    m = len(d)
    starts, total = np.arange(m), np.zeros(m, np.int64)
    for j in range(1, min(chain, m) + 1):
        total = total[: len(starts)] + d[(starts + j - 1) % m]
        good = total * m <= j * most + 1e-9
        starts, total = starts[good], total[good]
        if not len(starts):
            return False
    return bool(d.sum() <= most + 1e-9)


def near_duplicates(df: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every row: texts whose sets of word shingles have at least this Jaccard similarity are linked.

    No link between components is lost. Groups of near copies are first collapsed by stars: texts that meet in a table of
    minima are linked to the smallest id there, where the exact similarity holds. Then a join that is complete looks for links
    between what is still apart: of each text the rarest shingles are keys, so many that similar sets must share one, with
    filters by size and place. A candidate's wide fingerprints must pass the pigeonring filter and the count of all bits, which
    no similar pair fails; what is left is held against the exact sets.

    Texts of equal words are one throughout. A null text counts as empty; texts without words are linked to each other only.
    Rows of one id count as one document: what any of its rows is linked to; a null id is never linked and gets itself, null.
    An empty table gives an empty result. Very long texts are read in blocks; only their hashes are held.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    common, counts = common_shingles(own, words)
    mixers = np.random.default_rng(5).integers(0, 1 << 63, STARS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for part in (b for p in parts for b in text_blocks(p, "text")):
            keys, sizes, stars, heads, wide = [], [], [], [], []
            for t in batches(part.column("text")):
                hashes = np.unique(shingle_hashes(t, words))
                keys.append(xxhash.xxh128_digest(b" ".join(t.encode().lower().split())))
                sizes.append(len(hashes))
                minima = [(hashes * m).min() for m in mixers] if len(hashes) else []
                stars.append([xxhash.xxh64_intdigest(np.array(minima[i : i + MINIMA]).tobytes(), i) - (1 << 63) for i in range(0, len(minima), MINIMA)])
                heads.append(rarest(hashes, similarity, common, counts).view(np.int64))
                wide.append(parity_bits(hashes))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(stars, longs), pa.array(heads, longs), pa.array(wide, pa.binary())], names=["id", "words_key", "n", "stars", "head", "wide"])

    def shingled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b for p in parts for b in text_blocks(p, "text")):
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in batches(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "held"])

    def filtered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = (1 - similarity) / (1 + similarity)
        for part in parts:
            na, nb = (np.asarray(part.column(c), dtype=np.int64) for c in ("na", "nb"))
            some = np.flatnonzero((np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9) & (np.minimum(na, nb) > 0))
            wa, wb = part.column("wa"), part.column("wb")
            good = [i for i in some.tolist() if ring_passes(wa[i].as_py(), wb[i].as_py(), (na[i] + nb[i]) * share)]
            yield part.select(["a", "b"]).take(pa.array(good, pa.int64()))

    def looked_up(rows: DataFrame, pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Those of rows whose id is in a pair, and the table of these ids."""
        involved = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids")
        return rows.join(F.broadcast(involved) if involved.count() <= SENT else involved, "id", "left_semi"), involved

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) whose exact sets have the similarity."""
        met = stored(pairs, f"{name}-met")
        rows, ids = looked_up(fps.select("id", "n", "wide"), met, name)
        rows = stored(rows, f"{name}-wide")
        sides = met.join(rows.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa")), "a").join(rows.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb")), "b")
        passed = stored(sides.mapInArrow(filtered, f"a {kind}, b {kind}").distinct(), f"{name}-passed")
        for t in (met, rows, ids):
            dropped(t)
        rows, ids = looked_up(own, passed, name)
        sets = stored(rows.mapInArrow(shingled, f"id {kind}, held array<long>"), f"{name}-sets")
        both = passed.join(sets.select(F.col("id").alias("a"), F.col("held").alias("ha")), "a").join(sets.select(F.col("id").alias("b"), F.col("held").alias("hb")), "b")
        shared = F.size(F.array_intersect("ha", "hb"))
        linked = stored(both.where(shared >= similarity * (F.size("ha") + F.size("hb") - shared) - 1e-9).select("a", "b").distinct(), f"{name}-linked")
        for t in (passed, ids, sets):
            dropped(t)
        return linked

    def meetings(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and n; the rows of a batch's last key wait for the next batch."""

        def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            key = rows.column("key").to_numpy()
            many = np.zeros(len(key), bool)
            many[1:] = key[1:] == key[:-1]
            many[:-1] |= many[1:]
            rows = rows.filter(pa.array(many)).combine_chunks()
            k = rows.column("k")
            for a, b in candidates(rows, similarity):
                yield from pa.Table.from_arrays([k.take(pa.array(a)), k.take(pa.array(b))], names=["x", "y"]).to_batches()

        held = []
        for part in parts:
            if not part.num_rows:
                continue
            key = part.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if held and held[-1].column("key")[-1].as_py() == key[-1]:
                held.append(part)
                continue
            # the batch starts with the waiting key or a new one: all keys but its last are whole now
            if last:
                held.append(part.slice(0, last))
            if held:
                yield from found(held)
            held = [part.slice(last)]
        if held:
            yield from found(held)

    fps = stored(own.mapInArrow(run, f"id {kind}, words_key binary, n int, stars array<long>, head array<long>, wide binary"), "heads")
    kinds = stored(fps.groupBy("words_key").agg(F.min("id").alias("k")).where("k is not null"), "kinds")
    leaders = kinds.select(F.col("k").alias("id")).distinct()
    met = fps.select("id", "stars").join(leaders.hint("merge"), "id", "left_semi").select(F.col("id").alias("k"), F.explode("stars").alias("key")).distinct()
    centres = met.groupBy("key").agg(F.min("k").alias("b"), F.count("*").alias("size")).where("size > 1")
    stars = similar(met.join(centres, "key").where("k <> b").select(F.col("k").alias("a"), "b").distinct(), "stars")
    grouped = stored(leaders.join(components(stars, "stars"), F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("c")), "grouped")
    # merge joins at every size: a plan that turns from a broadcast to a shuffle somewhere can't be judged on small data
    apart = fps.select("id", "n", "head").join(grouped.hint("merge"), "id").select(F.col("id").alias("k"), "c", "n", F.posexplode("head").alias("at", "key"))
    pairs = apart.repartition("key").sortWithinPartitions("key", "n").mapInArrow(meetings, f"x {kind}, y {kind}")
    rest = similar(pairs.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "rest")
    leads = stored(fps.select("id", "words_key").join(kinds, "words_key").select("id", "k").distinct(), "leads")
    several = leads.groupBy("id").agg(F.min("k").alias("b"), F.count("*").alias("size")).where("size > 1")
    own_links = leads.join(several.select("id", "b"), "id").where("k <> b").select(F.col("k").alias("a"), "b")
    joined = stored(components(stars.union(rest).union(own_links), "groups"), "joined")
    named = leads.where("id is not null").join(joined, F.col("k") == F.col("node"), "left").groupBy("id").agg(F.min(F.coalesce("component", "k")).alias("component_id"))
    # a null id leads nothing and has no row here
    out = stored(named.union(own.where("id is null").select("id", F.col("id").alias("component_id")).distinct()), "near")
    for t in (fps, kinds, grouped, stars, rest, leads, joined):
        dropped(t)
    return out
