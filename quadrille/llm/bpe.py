"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The ranks of a byte-level vocabulary define the merges. Each match of the split pattern is encoded
separately: its bytes are read as Latin-1, an Aho-Corasick automaton finds the longest token at every
position in one pass, and the encoder walks from longest matches, falling back to shorter prefixes, or to
the previous token, when two adjacent tokens would have been merged differently. Whether two tokens may
stand side by side is memoised. The result is that of the merge procedure, in time linear in the text.

Rows: null and empty texts give no tokens (n_tokens 0, digests of the empty string). Repeated rows are encoded
each on their own. Very long texts are split and hashed in blocks, so memory stays bounded.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType

from quadrille.llm import common

#: Entries of the cache of encoded pieces and of the memo of token pairs, in one worker.
CACHE = 200_000
#: Characters above which a text is split piece by piece instead of all at once.
LONG_TEXT = 1_000_000

_codecs: dict[tuple[str, str], "Codec"] = {}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The merge procedure itself: quadratic, used for short byte strings only."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def sent(docs: DataFrame, path: str) -> Broadcast:
    """The vocabulary file (a megabyte), read on the driver and sent to the executors."""
    common.ship(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(_file(path))


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.vocab: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.vocab[i] = token
        self.lengths = [len(token) for token in self.vocab]
        self.names = [str(i) for i in range(len(self.vocab))]
        self.automaton = ahocorasick.Automaton()
        #: The longest token that is a shorter prefix of each token, -1 where there is none.
        self.shorter = [-1] * len(self.vocab)
        reached = set()
        for token, i in ranks.items():
            if len(token) > 1 and merge(token, ranks) != [i]:
                continue  # no merges lead to it: only a whole piece can be this token
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
            reached.add(i)
        self.automaton.make_automaton()
        for i in reached:
            token = self.vocab[i]
            for n in range(len(token) - 1, 0, -1):
                j = ranks.get(token[:n])
                if j is not None and j in reached:
                    self.shorter[i] = j
                    break
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, tuple[tuple[int, ...], str]] = {}

    @classmethod
    def load(cls, path: str, pattern: str, data: bytes | None = None) -> "Codec":
        """The codec of a vocabulary file, made once in a process; data: the file's bytes, where the path may lead nowhere."""
        if (path, pattern) not in _codecs:
            lines = (data or _file(path)).splitlines()
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
            _codecs[path, pattern] = cls(ranks, pattern)
            gc.freeze()  # the tables live as long as the worker
        return _codecs[path, pattern]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' bytes give just these two tokens."""
        if len(self.pairs) >= CACHE:
            self.pairs.clear()
        ok = self.pairs[left << 32 | right] = merge(self.vocab[left] + self.vocab[right], self.ranks) == [left, right]
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        longest = [-1] * (size + 1)
        for end, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length] = token  # ends only grow, so the last one is the longest
        dead: set[int] = set()  # positions from which no valid rest exists after what stands before
        lengths, shorter, known = self.lengths, self.shorter, self.pairs.get
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < size:
            while token >= 0:
                end = at + lengths[token]
                if end not in dead:
                    if last < 0 or (ok := known(last << 32 | token)) or ok is None and self.fits(last, token):
                        break
                token = shorter[token]
            if token < 0:
                if last < 0:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else -1
            else:
                out.append(token)
                last, at = token, end
                token = longest[at]
        return out

    def piece(self, text: str) -> tuple[tuple[int, ...], str, bytes]:
        """The ids of a piece, as text, and the bytes that they decode to."""
        found = self.cache.get(text)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            ids = tuple(self.encode_piece(text.encode()))
            found = ids, " ".join([self.names[i] for i in ids]), self.decode(ids)
            if len(text) < 64:
                self.cache[text] = found
        return found

    def pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) < LONG_TEXT:
            if text:
                yield self.pattern.findall(text)
            return
        matches = self.pattern.finditer(text)
        while block := [m[0] for m in islice(matches, 100_000)]:
            yield block

    def encode(self, text: str) -> list[int]:
        return [i for block in self.pieces(text) for p in block for i in self.piece(p)[0]]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.vocab[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the ids and of the bytes decoded from them, block by block."""
        n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
        get, piece = self.cache.get, self.piece
        for block in self.pieces(text):
            found = list(map(get, block))
            if None in found:
                found = [f or piece(p) for f, p in zip(found, block, strict=True)]
            if not found:
                continue
            ids, said, decoded = zip(*found, strict=True)
            if n:
                ids_hash.update(b" ")
            ids_hash.update(" ".join(said).encode())
            bytes_hash.update(b"".join(decoded))
            n += sum(map(len, ids))
        return n, ids_hash.hexdigest(), bytes_hash.hexdigest()


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """docs with an array of token ids added; `ids` names the new column and replaces one of that name."""
    file = sent(docs, path)
    keep = [c for c in docs.columns if c.lower() != ids.lower()]
    schema = docs.select(*[f"`{c}`" for c in keep]).schema.add(ids, ArrayType(IntegerType()))

    def run(batches):
        codec = Codec.load(path, pattern, file.value)
        for b in batches:
            found = [codec.encode(t or "") for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32()))], names=[*b.schema.names, ids])

    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)


def decode_documents(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """docs with the text decoded from an array of token ids added (bytes that are not UTF-8 become U+FFFD)."""
    file = sent(docs, path)
    keep = [c for c in docs.columns if c.lower() != text.lower()]
    schema = docs.select(*[f"`{c}`" for c in keep]).schema.add(text, "string")

    def run(batches):
        codec = Codec.load(path, pattern, file.value)
        for b in batches:
            found = [codec.decode(x or []).decode(errors="replace") for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, text])

    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)


def tokenised(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of docs but text, n_tokens, token_ids, and round_trip: whether the ids decode to the bytes of the text.

    Columns of docs with one of these names, in any case, give way to the new ones."""
    file = sent(docs, path)
    keep = [c for c in docs.columns if c.lower() not in ("text", "n_tokens", "token_ids", "round_trip")]
    schema = docs.select(*[f"`{c}`" for c in keep]).schema.add("n_tokens", "long").add("token_ids", ArrayType(IntegerType())).add("round_trip", "boolean")

    def run(batches):
        codec = Codec.load(path, pattern, file.value)
        for b in batches:
            size, parts = 0, []
            for k, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                ids = codec.encode(text or "")
                parts.append((k, len(ids), ids, codec.decode(ids) == (text or "").encode()))
                size += len(ids)
                if size > 1_000_000 or k == b.num_rows - 1:
                    at, n, lists, same = zip(*parts, strict=True)
                    columns = [c.slice(at[0], len(at)) for c in b.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array(same)], names=[*keep, "n_tokens", "token_ids", "round_trip"])
                    size, parts = 0, []

    return docs.select(*[f"`{c}`" for c in keep], "text").mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row of docs."""
    file = sent(docs, path)

    def run(batches):
        codec = Codec.load(path, pattern, file.value)
        for b in batches:
            rows = [codec.digest(t) for t in b.column(1).to_pylist()]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.map_rows(common.texts_of(docs), ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", run)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(common.table(spark, sf_dir, "documents"), *public_vocabulary())


QUERIES: dict[str, Callable] = {"op9_byte_bpe": op9_byte_bpe}
SQL: dict[str, str] = {}
