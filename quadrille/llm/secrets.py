"""Secrets: detectors over the text and over every layer that decoding uncovers.

A worklist holds layers of text. Each layer is scanned, then every encoding seen in it opens further layers:
URL and Unicode escapes rewrite the whole layer in place (so that a name before "%3D" still meets its value; an escape
that makes the start of a further one is followed at its place), base64 and hex runs open layers of their own, decompressed
first where they hold gzip, zlib, bzip2 or xz data, all members of it. A layer that was
seen before for the same span of the source is not opened again, so the work ends at a fixpoint. Spans found in a layer are mapped back through
all layers to the source text: to the rewritten characters, or to the whole encoded run.

The worklist is a stack, and what a run holds is read in blocks of BLOCK bytes, each a layer that begins with the end of the one
before: however much a run inflates to, all of it is scanned and little of it is held. Blocks are parted where no match
and no encoded run can go on; only one that goes on for LONG bytes is cut, with OVERLAP bytes in both parts.

Rows: null and empty texts have no spans (counts 0, digest of the empty string). Every row of the input gives
one row, repeated ones too. Offsets count code points, ends are exclusive; spans are ordered by start, then kind
(assign, access, hex), then end.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import common
from quadrille.llm.spans import Rewritten, join_spans

KINDS = ("assign", "access", "hex")
Span = tuple[str, int, int]
#: Bytes of a layer in a run, the most that a block may grow to where it cannot be parted, and what parts then share.
BLOCK, LONG, OVERLAP = 2 << 20, 32 << 20, 1 << 16
#: Bytes of the layers in a run up to which they are kept, for runs that stand more than once.
KEPT = 1 << 16

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token"))
_ASSIGN = re.compile(rf"({_EITHER}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those that fail its condition dropped, by start and kind."""
    found: list[Span] = []
    low = text.lower() if text.isascii() else text.encode().lower().decode()
    if any(name in low for name in _NAMES):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return order(found)


_ORDER = {k: n for n, k in enumerate(KINDS)}


def order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (x[1], _ORDER[x[0]], x[2]))


_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|apos|amp|lt|gt|equals|colon|lowbar|period|sol|plus|num);")
# Named character references.
_NAMED = {"quot": '"', "apos": "'", "amp": "&", "lt": "<", "gt": ">", "equals": "=", "colon": ":", "lowbar": "_", "period": ".", "sol": "/", "plus": "+", "num": "#"}
_HEX_PAIRS = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{2}){12,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:[0-9A-F]{2}){12,}(?![0-9A-Za-z])")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
_WRAPPED = re.compile(r"(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]{1,76}={0,2}")


#: What may follow a decoded "%", "&" or "\\" to make it one again: followed at once, however often.
_AGAIN = {"%": re.compile(r"(?:25)+"), "&": re.compile(r"(?:amp;|#0{0,4}38;|#[xX]0{0,4}26;)+"), "\\": re.compile(r"(?:u005[cC]|x5[cC]|u\{0{0,4}5[cC]\}|U0000005[cC])+")}


def _followed(text: str, found: Iterator[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """The edits found; where one ends in a character that opens escapes, those of the same character after it are taken in."""
    until = 0
    for start, end, new in found:
        if start < until:
            continue
        if (again := _AGAIN.get(new[-1:])) and (m := again.match(text, end)):
            end = until = m.end()
        yield start, end, new


def url_edits(text: str) -> Iterator[tuple[int, int, str]]:
    def found():
        for m in _URL.finditer(text):
            try:
                new = unquote_to_bytes(m[0]).decode()
            except UnicodeDecodeError:
                continue
            yield from _spread(m.start(), m[0], new)

    return _followed(text, found())


def _spread(start: int, old: str, new: str) -> Iterator[tuple[int, int, str]]:
    """One edit for each character where every character takes three bytes or a fixed share of old, else one for all."""
    share, rest = divmod(len(old), len(new))
    if rest or len(set(new)) and any(ord(c) > 127 for c in new):
        yield start, start + len(old), new
    else:
        for k, c in enumerate(new):
            yield start + k * share, start + (k + 1) * share, c


def unicode_edits(text: str) -> Iterator[tuple[int, int, str]]:
    return _followed(text, _unicode_edits(text))


def _unicode_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _UNICODE.finditer(text):
        s = m[0]
        if s[0] == "&":
            if s[1] == "#":
                n = int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])
                new = chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else None
            else:
                new = _NAMED[s[1:-1]]
        elif s[1] == "x":
            new = bytes.fromhex(s.replace("\\x", "")).decode("latin-1")
        elif s.startswith("\\u{") or s[1] == "U":
            n = int(s[3:-1] if s[2] == "{" else s[2:], 16)
            new = chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else None
        else:
            try:
                new = bytes.fromhex(s.replace("\\u", "")).decode("utf-16-be")
            except UnicodeDecodeError:
                new = None
        if new:
            yield from _spread(m.start(), s, new)


def _opener(head: bytes) -> Callable | None:
    """What makes a decompressor for data that begins so."""
    if head[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(47)
    if len(head) > 5 and head[0] == 0x78 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\0":
        return lambda: lzma.LZMADecompressor(memlimit=256 << 20)
    return None


def _stretched(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The chunks, the first one of at least 8 bytes if there are so many."""
    head = b""
    for c in chunks:
        head += c
        if len(head) >= 8:
            yield head
            yield from chunks
            return
    if head:
        yield head


def _member(make: Callable, first: bytes, chunks: Iterator[bytes], rest: list[bytes]) -> Iterator[bytes]:
    """What one member holds, in blocks; rest gets the data after it. Data that breaks off or is damaged gives what came before."""
    work, chunk = make(), first
    try:
        while True:
            if isinstance(work, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                block, more = work.decompress(chunk, BLOCK), lambda: None if work.needs_input else b""
            else:
                block, more = work.decompress(chunk, BLOCK), lambda: work.unconsumed_tail or None
            if block:
                yield block
            if work.eof:
                rest.append(work.unused_data)
                return
            if (chunk := more()) is None and (chunk := next(chunks, None)) is None:
                return
    except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
        return


def _plain_chunks(chunks: Iterator[bytes], heads: frozenset[bytes]) -> Iterator[bytes]:
    """The chunks decompressed, all members and as often as they are compressed; data that is not compressed as it is.

    heads: how the layers of compression above begin: one that begins like them holds itself and is not opened again."""
    chunks = _stretched(chunks)
    while (first := next(chunks, None)) is not None:
        make = _opener(first) if first[:64] not in heads else None
        rest: list[bytes] = []
        inner = _member(make, first, chunks, rest) if make else iter(())
        if (block := next(inner, None)) is None and not rest:
            yield first
            yield from chunks
            return
        if block is not None:
            yield from _plain_chunks(_chain(block, inner), heads | {first[:64]})
        if not rest:
            yield from chunks  # damaged or broken off: what is left is read as it is
            return
        chunks = _stretched(_chain(rest[0], chunks)) if rest[0] else _stretched(chunks)


def _chain(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


#: Bytes that neither a match nor an encoded run can hold, after which a block may end.
_PART = re.compile(rb"[^A-Za-z0-9+/_.=\"':%&\\#;{}\x20\r\n-]")
_SPACES = re.compile(rb"\x20{65,}")


def texts_in(data: bytes) -> Iterator[str]:
    """Blocks of the text in data: bytes that are not UTF-8 stand for the characters of their number, so all ASCII stays.

    Long runs of spaces are shortened; where there are zero bytes (UTF-16, say), the text without them follows."""
    held = b""
    chunks = (data[k : k + BLOCK] for k in range(0, len(data), BLOCK))
    for c in _plain_chunks(chunks, frozenset()):
        held = _SPACES.sub(b" " * 64, held + c)
        while len(held) >= BLOCK:
            cut = max((m.end() for m in _PART.finditer(held, max(0, len(held) - OVERLAP))), default=0)
            if not cut and len(held) < LONG:
                break
            yield from _read(held[: cut or LONG])
            held = held[cut or LONG - OVERLAP :]
            if cut:
                break
    if held:
        yield from _read(held)


def _read(block: bytes) -> Iterator[str]:
    try:
        text = block.decode()
    except UnicodeDecodeError:
        text = block.decode("latin-1")
    yield text
    if "\0" in text:
        yield text.replace("\0", "")


def _decoded(run: str) -> bytes:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def runs(text: str) -> Iterator[tuple[int, int, Callable[[], bytes]]]:
    """Encoded runs and how to decode them."""
    for m in _BASE64.finditer(text):
        yield m.start(), m.end(), lambda m=m: _decoded(m[0])
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            yield m.start(), m.end(), lambda m=m: _decoded(m[0].replace("\n", "").replace("\r", ""))
    for m in _HEX_PAIRS.finditer(text):
        yield m.start(), m.end(), lambda m=m: bytes.fromhex(m[0])


def layers(text: str) -> Iterator[tuple[str, list]]:
    """All layers below text, each with the steps that lead from it to the source: a Rewritten, or a fixed span.

    A layer is opened once for each span of the source that it stands for, so a repeated run is found at every place.
    """
    seen = {(_digest(text), None)}
    kept: dict[bytes, list[str]] = {}

    def held(decode: Callable[[], bytes]) -> Iterator[str]:
        data = decode()
        if len(data) > KEPT:
            return texts_in(data)
        key = hashlib.blake2b(data, digest_size=16).digest()
        if key in kept:
            return iter(kept[key])
        first, small = [], 0
        blocks = texts_in(data)
        for t in blocks:
            first.append(t)
            small += len(t)
            if small > KEPT:
                return (t for part in (first, blocks) for t in part)
        kept[key] = first
        return iter(first)

    def below(now: str, way: list) -> Iterator[tuple[str, list]]:
        for mark, edits in (("%", url_edits), ("\\&", unicode_edits)):
            if any(c in now for c in mark):
                layer = Rewritten(now, edits(now))
                if layer.changed():
                    yield layer.text, [layer, *way]
        for start, end, decode in runs(now):
            for new in held(decode):
                yield new, [(start, end), *way]

    stack = [below(text, [])]
    while stack:
        found = next(stack[-1], None)
        if found is None:
            stack.pop()
            continue
        key = _digest(found[0]), _fixed(found[1])
        if key not in seen:
            seen.add(key)
            yield found
            stack.append(below(*found))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=16).digest()


def _fixed(way: list) -> tuple[int, int] | None:
    """The span of the source that all of a layer stands for, None where its parts map to places of their own."""
    at = None
    for step in way:
        if isinstance(step, tuple):
            at = step
        elif at is not None:
            at = step.source(*at)
    return at


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Secrets that appear only in decoded layers, as spans of the source text."""
    known, found = set(base), set()
    scans: dict[str, list[Span]] = {}
    for now, way in layers(text):
        if len(now) > KEPT:
            here = base_spans(now)
        elif (here := scans.get(now)) is None:
            here = scans[now] = base_spans(now)
        if here and way and isinstance(way[0], tuple):
            # all spans of a kind in what a run holds map to the same place
            here = list({span[0]: span for span in here}.values())
        for kind, start, end in here:
            touched = False
            for step in way:
                if isinstance(step, tuple):
                    (start, end), touched = step, True
                else:
                    touched = touched or step.touches(start, end)
                    start, end = step.source(start, end)
            if touched and (kind, start, end) not in known:
                found.add((kind, start, end))
    return list(found)


def find_secrets(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the plain text, and those that decoding adds."""
    base = base_spans(text)
    return base, order(hidden_spans(text, base))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, and n_hidden (spans that decoding adds)."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_hidden"]

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, extra = find_secrets(text)
                said = join_spans(base)
                kinds = [x[0] for x in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(said.encode()).hexdigest(), join_spans(order(base + extra)) if extra else said, len(extra)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds_of = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True))], names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_hidden long"
    return common.map_rows(common.texts_of(docs), ["doc_id", "text"], schema, run)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable] = {"op10_secrets": op10_secrets}
SQL: dict[str, str] = {}
