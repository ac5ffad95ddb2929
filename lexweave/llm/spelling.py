"""Spelling variants: words one inserted, deleted or replaced letter apart, grouped under their commonest form.

A word's letters get prefix sums of a polynomial hash; leaving out a letter is then the prefix hash before it plus the suffix hash after
it, so NumPy makes the keys of all deletions of a batch of words at once, as integers. Two words are near exactly if one is a deletion
of the other, or if both leave the same rest at the same place. Rows (key, word number, place) are dealt by the key's upper
bits and sorted; only what shares a key with another word goes on, meets its strings, and is verified on them.

Nothing is done pair by pair: the words that leave one rest at one place are all near each other, so their number and their two
commonest tell each word what it needs, and likewise a word and its deletions. Such a group has at most one word a letter of the
alphabet and place. Forms are followed to their roots by doubling.

Words are runs of A-Z, a-z and the letters U+00C0 to U+00FF (signs between them included), A-Z lower-cased. Null and empty texts
have none; an empty table has no words; a null id is written as an empty one where the id counts. Repeated rows count each. Equal
counts are settled by code-point order. Words of any length are whole: a key row is small however long its word is. Columns other than
id and text are not looked at. Counts of a task are sent on whenever MOST words have met in it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import LOWER, UPPER, batches, dropped, stored, text_blocks
from lexweave.llm.resampling import crc32_sql

WORD = re.compile("[A-Za-zÀ-ÿ]+")
MOST = 200_000
#: An odd multiplier and its inverse modulo 2**64, and the multiplier that mixes keys.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)


def misspelt(word: str, state: int, one_in: int) -> str:
    """The word, without one letter if the CRC that `state` has begun comes to a multiple of one_in."""
    h = zlib.crc32(word.encode(), state)
    if h % one_in:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def word_counts(df: DataFrame, shortest: int = 6, least: int = 5, one_in: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of words of `shortest` letters at least that occur `least` times at least.

    With one_in, a word of a document loses a letter if one_in divides the CRC of "id:word" (errors to be found again).
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for part in (b for p in parts for b in text_blocks(p, "text")):
            for name, text in zip(part.column("id").to_pylist(), batches(part.column("text")), strict=True):
                words = Counter(WORD.findall(text.encode().lower().decode()))
                if one_in:
                    state = zlib.crc32(f"{name}:".encode())
                    for word, n in words.items():
                        counts[misspelt(word, state, one_in)] += n
                else:
                    counts.update(words)
            if len(counts) >= MOST:
                yield from sent(counts)
                counts.clear()
        yield from sent(counts)

    def sent(counts: Counter[str]) -> Iterator[pa.RecordBatch]:
        kept = ((w, n) for w, n in counts.items() if len(w) >= shortest)
        while some := list(islice(kept, 10_000)):
            words, n = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n, pa.int64())], names=["word", "n"])

    own = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, place, key) of each word, place -1, and of each of its deletions, place the letter left out."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(letters)) - (ends - sizes)[owner]
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(sizes.max(initial=1)), BASE))])
    with np.errstate(over="ignore"):
        # all sums wrap round modulo 2**64; a word's prefix sums are those of the whole less what came before it
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers[place])])
        before = upto[ends - sizes]
        whole = upto[ends] - before
        prefix = upto[:-1] - before[owner]
        suffix = (whole[owner] - (upto[1:] - before[owner])) * INVERSE
        keys = np.concatenate([whole, prefix + suffix])
        keys = (keys ^ (keys >> np.uint64(30))) * MIX
        keys ^= keys >> np.uint64(31)
    return np.concatenate([np.arange(len(words)), owner]), np.concatenate([np.full(len(words), -1), place]), keys.view(np.int64)


def _keyed(words: DataFrame) -> DataFrame:
    """(key, row, place) of all words and deletions."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b for p in parts for b in text_blocks(p, "word", 1 << 18)):
            index, place, keys = deletion_keys(part.column("word").to_pylist())
            rows = part.column("row").to_numpy()[index]
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (keys, rows, place)], names=["key", "row", "place"])

    return words.select("row", "word").mapInArrow(run, "key long, row long, place long")


def _by_key(df: DataFrame) -> DataFrame:
    """Dealt by the upper 16 bits of the key, each part sorted by key."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, F.shiftrightunsigned("key", 48)).sortWithinPartitions("key")


def _runs(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches cut so that no key's rows are parted, each with the places where a key begins."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        if not part.num_rows:
            continue
        keys = part.column("key").to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        same = held and held[0].column("key")[0].as_py() == keys[0]
        if last == 0 and (same or not held):
            held.append(part)
            continue
        whole = [*held, part.slice(0, last)]
        held = [part.slice(last)]
        yield _begins(pa.Table.from_batches(whole).combine_chunks().to_batches()[0])
    if held:
        yield _begins(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _begins(part: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    keys = part.column("key").to_numpy()
    return part, np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])


def _shared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key another word has too."""
    for part, begins in _runs(parts):
        rows = part.column("row").to_numpy()
        several = np.minimum.reduceat(rows, begins) != np.maximum.reduceat(rows, begins)
        yield part.filter(pa.array(np.repeat(several, np.diff([*begins, len(rows)]))))


def judged(members: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(row, near, n, word) from the (row, place, n, word) that share a key: how many near words, and the commonest of them."""
    wholes: dict[str, tuple[int, int, str]] = {}
    shorter: dict[str, dict[int, tuple[int, int, str]]] = defaultdict(dict)
    same: dict[tuple[str, int], list[tuple[int, int, str]]] = defaultdict(list)
    for row, place, n, word in members:
        if place < 0:
            wholes[word] = row, n, word
        else:
            rest = word[:place] + word[place + 1 :]
            shorter[rest][row] = row, n, word
            same[rest, place].append((row, n, word))
    best = lambda x: (-x[1], x[2])
    out = []
    for rest, longer in shorter.items():
        if rest in wholes:
            row, n, word = wholes[rest]
            top = min(longer.values(), key=best)
            out.append((row, len(longer), top[1], top[2]))
            out += [(other, 1, n, word) for other in longer]
    for group in same.values():
        if len(group) > 1:
            first, second = sorted(group, key=best)[:2]
            for member in group:
                top = second if member is first else first
                out.append((member[0], len(group) - 1, top[1], top[2]))
    return out


def _verified(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.int64()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    for part, begins in _runs(parts):
        members = list(zip(*(part.column(c).to_pylist() for c in ("row", "place", "n", "word")), strict=True))
        found = [x for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(members)], strict=True) for x in judged(members[a:b])]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*found, strict=True)) or [()] * 4, schema, strict=True)], schema=schema)


def near_words(words: DataFrame) -> DataFrame:
    """(row, n_near, best struct<n, word>) of the words (row, word, n) that have near words."""
    keyed = _by_key(_keyed(words)).mapInArrow(_shared, "key long, row long, place long")
    met = _by_key(keyed.join(words.hint("merge"), "row").select("key", "row", "place", "n", "word"))
    found = met.mapInArrow(_verified, "row long, near long, best_n long, best string")
    # the largest n, then the smallest word: a minimum that is kept for each word before the shuffle
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("row").agg(F.sum("near").alias("n_near"), top.alias("best"))


def rooted(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """(word, root) from (word, form): each form's own form is taken, twice as far each round, until nothing moves.

    A form occurs more often than its word, so that there are no circles.
    """
    up = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(up.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(up)
        up = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return up
    raise RuntimeError(f"rooted: still moving after {rounds} rounds")


def variants(counts: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n): form is the commonest near word, if it occurs `times` as often."""
    words = stored(counts.select(F.monotonically_increasing_id().alias("row"), "word", "n"), "words")
    near = near_words(words)
    n = -F.col("best.n")
    holds = n >= times * F.col("n")
    joined = words.join(near.hint("merge"), "row", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(holds, F.col("best.word")).alias("form"), F.when(holds, n).alias("form_n")
    )
    found = stored(joined, "variants")
    dropped(words)
    roots = rooted(found.where("form is not null"))
    return found.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same by DuckDB over documents, in the columns of the query.
SQL = f"""
WITH RECURSIVE split AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
held AS (SELECT doc_id, run, count(*) AS times, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS marked FROM split GROUP BY doc_id, run),
coded AS (SELECT run, times, {crc32_sql('marked')} AS h FROM held),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, times FROM coded),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
counted AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
best AS (SELECT word, other, n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 5 * w.n THEN other END AS form, CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n FROM words w LEFT JOIN counted USING (word) LEFT JOIN best b USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)
"""
