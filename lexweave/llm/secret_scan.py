"""Secret scans: an Aho-Corasick keyword prefilter, regular expressions anchored at its hits, and checksums that tokens carry.

One pass of the automaton over a text, A-Z lower-cased, gives the places of all keywords; only there a kind's expression is tried,
by a match that must begin at that place. Places within the kind's last match are passed over, so the matches are those of a
leftmost search over the whole text. Runs of hexadecimal digits have no keyword: a run of 32 holds every 32nd character of the
text once, so only these are looked at, and a run is followed to both ends from the first that is such a digit.

Besides what is found by form alone (assign, access, hex), kinds whose tokens carry a checksum count only where it is right: CRC-32 in
base 62 (github, npm), double SHA-256 in base 58 (xprv), bech32 (age, nsec). Their spans are added and take none away.

Null and empty texts hold no secrets; repeated rows are scanned each; an empty table gives an empty one. Texts are scanned whole, however
long; a text's spans are as many as it holds. Places count code points. Nothing is shuffled. Columns other than id and text are not
looked at, whatever they are called; `redact` carries them along.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import batches, text_blocks

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
#: The generator of the bech32 checksum, a number for each of the five bits that leave.
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
LEAST_HEX = 32


def crc_ends_it(token: str) -> bool:
    """After the prefix and its underscore, the last six characters are the CRC-32 of those before them, in base 62."""
    body = token[token.index("_") + 1 :]
    value = 0
    for ch in body[-6:]:
        value = value * 62 + BASE62.index(ch)
    return value == zlib.crc32(body[:-6].encode())


def base58_checks(token: str) -> bool:
    """82 bytes in base 58, of which the last four begin the double SHA-256 of the others."""
    value = 0
    for ch in token:
        value = value * 58 + BASE58.index(ch)
    if value >> 8 * 82:
        return False
    data = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def bech32_checks(token: str) -> bool:
    """The remainder of prefix and data, five bits at a time, is one."""
    prefix, _, data = token.lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    rest = 1
    for v in values:
        top, rest = rest >> 25, (rest & 0x1FFFFFF) << 5 ^ v
        for k, g in enumerate(GENERATOR):
            if top >> k & 1:
                rest ^= g
    return rest == 1


def _long_value(m: re.Match) -> bool:
    return len(m.group(2)) >= 8


def _long_enough(m: re.Match) -> bool:
    return len(m.group()) >= 16


def _by(check: Callable[[str], bool]) -> Callable[[re.Match], bool]:
    return lambda m: check(m.group())


#: kind: (keywords in lower case, expression that begins with one of them, what a match must pass); spans that start together stand in this order, hex after access.
KINDS: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), _long_value),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), _long_enough),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), _by(crc_ends_it)),
    "npm": (("npm_",), re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), _by(crc_ends_it)),
    "xprv": (("xprv",), re.compile(rf"xprv[{BASE58}]{{107}}(?![{BASE58}])"), _by(base58_checks)),
    "age": (("age-secret-key-1",), re.compile(rf"AGE-SECRET-KEY-1[{BECH32.upper()}]{{58}}(?![0-9A-Z])"), _by(bech32_checks)),
    "nsec": (("nsec1",), re.compile(rf"nsec1[{BECH32}]{{58}}(?![0-9a-z])"), _by(bech32_checks)),
}
BASE = ("assign", "access", "hex")
ORDER = {k: n for n, k in enumerate([*BASE, *(k for k in KINDS if k not in BASE)])}
HEX, HEX_RUN = re.compile("[0-9a-f]"), re.compile("[0-9a-f]+")
HEX_DIGITS = frozenset("0123456789abcdef")


def automaton():
    """All keywords; a hit gives its length and kind."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, (words, _, _) in KINDS.items():
        for w in words:
            out.add_word(w, (len(w), kind))
    out.make_automaton()
    return out


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Whole runs of 32 hexadecimal digits in lower case or more."""
    done = 0
    for hit in HEX.finditer(text[LEAST_HEX - 1 :: LEAST_HEX]):
        start = at = LEAST_HEX - 1 + LEAST_HEX * hit.start()
        if at < done:
            continue
        # no further back than the character before a run would have been looked at
        while start and text[start - 1] in HEX_DIGITS:
            start -= 1
        done = HEX_RUN.match(text, at).end()
        if done - start >= LEAST_HEX:
            yield start, done


def spans(text: str, found) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in a text, by start, then by kind in the order of ORDER."""
    out = [("hex", a, b) for a, b in hex_runs(text)]
    free = dict.fromkeys(KINDS, 0)
    for end, (n, kind) in found.iter(text.encode().lower().decode()):
        start = end + 1 - n
        if start >= free[kind]:
            _, pattern, passes = KINDS[kind]
            m = pattern.match(text, start)
            if m:
                free[kind] = m.end()
                if passes(m):
                    out.append((kind, start, m.end()))
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of each document: its secrets by place."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for part in (b for p in parts for b in text_blocks(p, "text")):
            rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t, found)] for t in batches(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, kind)], names=["id", "spans"])

    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, spans {SPANS}")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each secret in the text replaced by its kind in brackets; spans that overlap are one, named for the first."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for part in (b for p in parts for b in text_blocks(p, "text")):
            texts = [t if t is None else redacted(t, spans(t, found)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    # df's own columns travel in a struct, so that no name of theirs can meet one of these
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text_col).alias("text"))
    out = own.mapInArrow(run, own.schema)
    return out.select(*[(F.col("text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in df.columns])


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each group of overlapping spans replaced."""
    out, at = [], 0
    for kind, start, end in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def written(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
