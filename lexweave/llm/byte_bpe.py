"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut where the splitting pattern always has a boundary (before a space beside a visible character, before a stop
after a letter, around single line ends), so the pieces encode separately to the same ids. The ids of a piece are kept in a bounded table per Python worker,
because running text repeats its pieces; the library encodes each new piece once. A text in which a space stands between
two white-space characters is given to the library whole, as are pieces too long to repeat.

Nulls count as empty texts and give no ids. Very long texts are handled whole; memory follows the longest text only.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lexweave.llm.common import batches, text_blocks

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces kept per worker. When they are as many, those met since the last time stay, if they leave half of the room.
KEPT = 400_000
#: Bytes of text encoded at once: different pieces are looked up once a block, and what is made on the way takes some 50 times a block.
BLOCK = 1 << 20
#: A piece of more bytes than this is not kept; a multiple of eight.
LONG = 24
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Places beside spaces where the splitting pattern always has a boundary: before a stop or comma after a letter, and around single line ends between letters.
_STOPS = (r"([A-Za-z\x{df}-\x{f6}\x{f8}-\x{ff}])([.,])", "\\1\0\\2")
_LINES = (r"([A-Za-z\x{df}-\x{f6}\x{f8}-\x{ff}.,])\n([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])", "\\1\0\n\0\\2")
#: Latin letters, perhaps behind a space, which the splitting pattern keeps together.
_WORD = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")
_KIND: dict[tuple, Coder] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: printable Latin-1 for itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = [""] * 256, 0x100
    for b in range(256):
        if b in own:
            table[b] = chr(b)
        else:
            table[b], spare = chr(spare), spare + 1
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: base64 and number per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def tokenizer_of_ranks(path: str, pattern: str):
    """A tokenizers.Tokenizer that gives the ids of a rank file: every split of a token into two tokens is a merge, in the order of the ranks."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    name = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [(name[token[:i]], name[token[i:]]) for token in sorted(ranks, key=ranks.get) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    out = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


class Pieces:
    """The ids of pieces of at most LONG bytes, in arrays: the pieces of a block are looked up at once, and no Python object is held for a piece."""

    def __init__(self, kind: np.dtype, most: int):
        self.most, self.kind = most, kind
        self.slots = np.full(1 << (2 * most).bit_length(), -1, np.int32)
        self.keys = np.zeros((most, LONG // 8), np.uint64)
        self.at, self.size, self.met = np.zeros(most, np.int64), np.zeros(most, np.int64), np.zeros(most, bool)
        self.ids, self.n = np.zeros(0, kind), 0

    @staticmethod
    def keys_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The bytes of each piece, none of them zero, as a row of LONG bytes that ends in zeros."""
        place, data = np.arange(LONG), np.append(data, np.zeros(LONG, np.uint8))
        out = np.empty((len(starts), LONG), np.uint8)
        for k in range(0, len(starts), 1 << 14):
            some = data[starts[k : k + (1 << 14), None] + place]
            some[place >= sizes[k : k + (1 << 14), None]] = 0
            out[k : k + (1 << 14)] = some
        return out.view(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = np.zeros(len(keys), np.uint64)
        for column in keys.T:
            h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where it isn't kept."""
        out, todo, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slot(keys)
        while len(todo):
            k = self.slots[slot]
            todo, slot, k = todo[k >= 0], slot[k >= 0], k[k >= 0]
            same = (self.keys[k] == keys[todo]).all(axis=1)
            out[todo[same]] = k[same]
            todo, slot = todo[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        self.met[out[out >= 0]] = True
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keep different pieces that find() doesn't know, as many as there is room for."""
        if self.n + len(keys) > self.most:
            stay = np.flatnonzero(self.met[: self.n])
            own = (self.keys[stay], self.ids[spread(self.at[stay], self.size[stay])], self.size[stay])
            self.slots[:], self.met[:] = -1, False
            self.ids, self.n = np.zeros(0, self.kind), 0
            if len(stay) <= self.most // 2:
                self.add(*own)
            room = self.most - self.n
            keys, sizes = keys[:room], sizes[:room]
        number = np.arange(self.n, self.n + len(keys))
        self.keys[number], self.size[number], self.at[number] = keys, sizes, len(self.ids) + np.cumsum(sizes) - sizes
        self.ids, self.n = np.append(self.ids, ids[: sizes.sum()]), self.n + len(keys)
        slot = self._slot(keys)
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]
            left = self.slots[slot] != number
            number, slot = number[left], (slot[left] + 1) & (len(self.slots) - 1)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Coder:
    """Encodes texts to arrays of ids, and decodes them."""

    def __init__(self, tokenizer, special: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer.encode_special_tokens = not special
        self.tokenizer, self.special = tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()] if special else []
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocab.values(), default=0) < 1 << 16 else "<u4")
        back = {c: b for b, c in enumerate(byte_characters())}
        self.tokens = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.tokens[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.pieces = Pieces(self.kind, KEPT)
        # the same model, not a copy; its texts come in the vocabulary's characters, which hold no line end
        self.words = Tokenizer(tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        self.characters = [(chr(b), c) for b, c in enumerate(byte_characters()) if b != 10 and c != chr(b)]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole_words(self, words: list[str]) -> list[bytes]:
        """The ids of words, as bytes. Many words are encoded as one text, cut at line ends; the lengths of the tokens tell where each word ends."""
        out: list[bytes] = []
        for k in range(0, len(words), 1000):
            data = ("\n".join(words[k : k + 1000]) + "\n").encode()
            text = data.decode("latin-1")
            for own, shown in self.characters:
                text = text.replace(own, shown)
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)
            stops = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
            ends = (np.searchsorted(np.cumsum(self.lengths[ids]), stops - np.arange(len(stops))) + 1) * self.kind.itemsize
            data, ends = ids.tobytes(), ends.tolist()
            out += [data[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each of some different pieces start and how many they are."""
        width = np.int64 if pa.types.is_large_string(pieces.type) else np.int32
        offsets = np.frombuffer(pieces.buffers()[1] or b"", width)[pieces.offset :][: len(pieces) + 1].astype(np.int64)
        sizes = np.diff(offsets)
        short = np.flatnonzero(sizes <= LONG)
        keys = Pieces.keys_of(np.frombuffer(pieces.buffers()[2] or b"", np.uint8), offsets[:-1][short], sizes[short])
        number = self.pieces.find(keys)
        known = number >= 0
        at, n = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        at[short[known]], n[short[known]] = self.pieces.at[number[known]], self.pieces.size[number[known]]
        missing = np.concatenate([short[~known], np.flatnonzero(sizes > LONG)])
        texts = pieces.take(pa.array(missing)).to_pylist()
        word = [_WORD.fullmatch(t) is not None for t in texts]
        encoded = self._whole_words([t for t, w in zip(texts, word, strict=True) if w])
        encoded += [x.tobytes() for x in self._library([t for t, w in zip(texts, word, strict=True) if not w])]
        order = np.argsort(~np.array(word, dtype=bool), kind="stable")
        fresh = np.frombuffer(b"".join(encoded), self.kind)
        size = np.fromiter(map(len, encoded), np.int64, len(encoded)) // self.kind.itemsize
        start = np.cumsum(size) - size
        at[missing[order]], n[missing[order]] = len(self.pieces.ids) + start, size
        ids = np.append(self.pieces.ids, fresh)
        kept = order < len(short) - known.sum()  # the short ones come first among the missing
        self.pieces.add(keys[~known][order[kept]], fresh[spread(start[kept], size[kept])], size[kept])
        return ids, at, n

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an Arrow column. Arrow cuts the texts and finds the different pieces; ids are gathered for all texts at once."""
        texts = pc.fill_null(column, "")
        whole = pc.match_substring_regex(texts, f"{_SPACE} {_SPACE}")
        for own in ["\0", *self.special]:
            whole = pc.or_(whole, pc.match_substring(texts, own))
        whole = np.asarray(whole, dtype=bool)
        cut = pc.replace_substring(texts.filter(pa.array(~whole)), " ", "\0 ")
        for pattern, by in (_STOPS, _LINES):
            cut = pc.replace_substring_regex(cut, pattern, by)
        cut = pc.split_pattern(cut, "\0")
        first = np.asarray(cut.offsets[:-1], dtype=np.int64) - (cut.offsets[0].as_py() if len(cut) else 0)
        found = cut.flatten().dictionary_encode()
        codes = np.asarray(found.indices, dtype=np.int64)
        data, at, size = self._of(found.dictionary)
        n = size[codes]
        ends = np.cumsum(n)
        ids = data[spread(at[codes], n)]
        out = iter(np.split(ids, (ends - n)[first[1:]]) if len(first) else [])
        other = iter(self._library(texts.filter(pa.array(whole)).to_pylist()))
        return [next(other) if w else next(out) for w in whole.tolist()]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """(start, end) of each token in the UTF-8 bytes of its text."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return np.stack([ends - n, ends], axis=1)

    def character_offsets(self, ids: np.ndarray) -> np.ndarray:
        """(start, end) of each token in the characters of its text; of a character split over tokens each holds the whole."""
        data = np.frombuffer(self.decode_bytes(ids), np.uint8)
        number = np.concatenate([np.cumsum((data & 0xC0) != 0x80), [0]])  # up to each byte
        spans = self.offsets(ids)
        return np.stack([number[spans[:, 0]] - 1, number[spans[:, 1] - 1]], axis=1) if len(spans) else spans

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for: the byte table reversed."""
        get = self.tokens.__getitem__
        return b"".join(b"".join(map(get, ids[k : k + 65536].tolist())) for k in range(0, len(ids), 65536))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text token by token: a character split over tokens comes with its last byte, broken bytes as U+FFFD."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield decoder.decode(self.tokens[i])
        yield decoder.decode(b"", True)


def coder(path: str, pattern: str = "", special: bool = False) -> Coder:
    """The coder of a tokenizer file, made once per Python worker: a rank file with its pattern, or a JSON file. special: strings of special tokens in a text become these."""
    if (path, pattern, special) not in _KIND:
        from tokenizers import Tokenizer

        _KIND[path, pattern, special] = Coder(tokenizer_of_ranks(path, pattern) if pattern else Tokenizer.from_file(path), special)
    return _KIND[path, pattern, special]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(id, ids array<int>, and with offsets, starts and ends array<int> in UTF-8 bytes, char_starts and char_ends in characters) of each row's text.

    Null texts count as empty, with no ids. Repeated rows are encoded each; an empty table gives an empty result; other columns
    are not looked at.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for part in (b for p in parts for b in text_blocks(p, text_col, BLOCK)):
            found = c.encode(part.column(text_col))
            columns = [part.column(id_col), pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))]
            if offsets:
                spans = [c.offsets(x).astype(np.int32) for x in found]
                chars = [c.character_offsets(x).astype(np.int32) for x in found]
                columns += [pa.array([s[:, k] for s in own], pa.list_(pa.int32())) for own in (spans, chars) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", *["starts", "ends", "char_starts", "char_ends"][: 4 * offsets]])

    own = df.select(id_col, text_col)
    kind = own.schema[id_col].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, ids array<int>" + ", starts array<int>, ends array<int>, char_starts array<int>, char_ends array<int>" * offsets)


def decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, decoded binary) of rows (id, ids array<int>); null ids give no bytes."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for part in parts:
            rows = [np.asarray(x.values if x.is_valid else [], dtype=c.kind) for x in part.column("ids")]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([c.decode_bytes(x) for x in rows], pa.binary())], names=["id", "decoded"])

    own = df.select("id", "ids")
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, decoded binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass and return digests: (id, n_tokens, ids_sha256, decoded_sha256, lossless)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for part in (b for p in parts for b in text_blocks(p, text_col, BLOCK)):
            found = c.encode(part.column(text_col))
            back = [c.decode_bytes(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(id_col),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4")).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    pa.array([x == t.encode() for x, t in zip(back, batches(part.column(text_col)), strict=True)]),
                ],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"],
            )

    own = df.select(id_col, text_col)
    return own.mapInArrow(run, f"id {own.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")


def vocabulary_size(path: str) -> int:
    """Ids of a JSON tokenizer file."""
    with open(path) as f:
        return len(json.load(f)["model"]["vocab"])
