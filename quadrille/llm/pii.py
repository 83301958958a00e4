"""Personal data: detectors over the text as it is and over a deobfuscated copy that keeps offsets.

A chain of transducers rewrites the text: look-alike characters (full-width forms, Cyrillic and Greek letters,
other digits, invisible characters), spelled digits, and the disguises of "@" and ".". Each rewrite records
where it came from, so identifiers found in the rewritten text are mapped back to the source characters.
Spans that hold nothing rewritten are left to the detectors of the plain text. Runs of spelled digits are rewritten where the
detectors could take the result (four parts, a plus, or thirteen digits), however few of the digits are spelled; the text is read
with and without this step.

Rows: null and empty texts have no spans (counts 0, digest of the empty string). Every row of the input gives
one row, repeated ones too. Offsets count code points, ends are exclusive; spans are ordered by kind
(email, ip, card, phone), then start, then end.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import common
from quadrille.llm.spans import Rewritten, join_spans

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_CARD_LIKE = re.compile(r"[0-9](?:[ -]?[0-9]){12}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches of the e-mail pattern, found from the "@" outwards in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield "email", start, done
        at = text.find("@", max(done, at + 1))


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            yield "ip", m.start(), m.end()


def cards(text: str) -> Iterator[Span]:
    if not _CARD_LIKE.search(text):
        return
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    if "+" not in text:
        return
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    found = [*emails(text), *ips(text)]
    found += cards(text)
    found += phones(text)
    return found


# Letters of other scripts that look like Latin ones, and what they look like.
_LOOKS = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХЗаеѕіјорсухԁһԛԝкмтпгьɑɡıΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοριυνκτχ•·․。｡‐‑‒–—−﹣‚‘’",
        "ABESIJKMHOPCTYX3aesijopcyxdhqwkmtnrbagiABEZHIKMNOPTYXaopiuvktx.....-------,''",
        strict=True,
    )
)
# Characters that show nothing.
_INVISIBLE = frozenset("­͏؜ᅟᅠ឴឵᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿︎️")
#: Blocks that can hold look-alikes; Latin letters with marks are outside.
_SUSPECT = re.compile("[­²³·¹ıɑɡ͏Ͱ-ԯ؜٠-٩۰-۹०-९০-৯๐-๙ᅟᅠ឴឵᠎ -⁯⁰-₟⃐-⓿❶-➓　-〿︀-﹯＀-￯\U0001d400-\U0001d7ff\U0001f100-\U0001f1ff]")
_plain_memo: dict[str, str] = {}


def plain(char: str) -> str:
    """What a suspect character stands for; itself if nothing."""
    new = _plain_memo.get(char)
    if new is None:
        if char in _INVISIBLE:
            new = ""
        elif char in _LOOKS:
            new = _LOOKS[char]
        else:
            digit = unicodedata.digit(char, None)
            new = str(digit) if digit is not None else unicodedata.normalize("NFKC", char)
            if not (new.isascii() and len(new) == 1 and (new.isprintable() or new == " ")):
                new = char
        _plain_memo[char] = new
    return new


def homoglyph_edits(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _SUSPECT.finditer(text):
        if (new := plain(m[0])) != m[0]:
            yield m.start(), m.end(), new


# Digits spelled in English, German, French and Spanish.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


def _alternatives(words: list[str]) -> str:
    """A pattern of all the words that tries each first letter once."""
    if words == [""]:
        return ""
    heads = sorted({w[0] for w in words if w})
    branches = [re.escape(c) + _alternatives([w[1:] for w in words if w[:1] == c]) for c in heads]
    whole = branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"
    return f"(?:{whole})?" if "" in words else whole


_WORD = _alternatives(list(_DIGITS))
_DOT_WORD = r"dot|point|punkt|punto"
_GAP = r"[\s,.()-]{1,4}"
#: Both for lower-case text: a spelled digit, and one beside something else that numbers are made of.
_SPELLED = re.compile(rf"(?<=\W){_WORD}(?!\w)")
_BESIDE = re.compile(rf"\b(?:{_WORD}{_GAP}(?:{_WORD}|[0-9]|{_DOT_WORD}|\+)(?!\w)|(?:{_DOT_WORD}|plus){_GAP}{_WORD}(?!\w))|[0-9]{_GAP}{_WORD}(?!\w)|\+\s?{_WORD}(?!\w)")
_ITEM = rf"(?:(?:{_WORD}|{_DOT_WORD}|plus)(?!\w)|[0-9]+|[+.()])"
_RUN = re.compile(rf"(?i)(?<!\w){_ITEM}(?:[ \t]{{0,2}}[,-]?(?:\r?\n)?[ \t]{{0,2}}{_ITEM})+")
_RUN_PART = re.compile(rf"(?i)({_WORD})(?!\w)|({_DOT_WORD})(?!\w)|(plus)(?!\w)|[0-9]+|[\s,]+|.", re.DOTALL)


def _may_identify(parts: list[re.Match]) -> bool:
    """Whether a run with a spelled digit has what a card, an address or a phone number needs."""
    if not any(p[1] for p in parts):
        return False
    digits = sum(1 if p[1] else len(p[0]) * p[0].isdigit() for p in parts)
    dots = sum(bool(p[2]) or p[0] == "." for p in parts)
    return digits >= 13 or digits >= 4 and dots >= 3 or digits >= 9 and any(p[3] or p[0] == "+" for p in parts)


def has_spelled(text: str) -> bool:
    low = "\n" + text.lower()
    return bool(_SPELLED.search(low) and _BESIDE.search(low))


def digit_edits(text: str) -> Iterator[tuple[int, int, str]]:
    """Within runs that may hold an identifier: spelled digits become digits, the space between items goes."""
    if not has_spelled(text):
        return
    for run in _RUN.finditer(text):
        parts = list(_RUN_PART.finditer(text, run.start(), run.end()))
        if not _may_identify(parts):
            continue
        for k, p in enumerate(parts):
            if p[1]:
                yield p.start(), p.end(), _DIGITS[p[1].lower()]
            elif p[2]:
                yield p.start(), p.end(), "."
            elif p[3]:
                yield p.start(), p.end(), "+"
            elif (p[0][0] == "," or p[0].isspace() or p[0][0].isspace()) and 0 < k < len(parts) - 1:
                yield p.start(), p.end(), ""


_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT = rf"\s*(?:{_OPEN}\s*(?:at|@|arroba)\s*{_CLOSE}|&#0*64;|&#x0*40;|&commat;|%40)\s*"
_DOT = rf"\s*(?:{_OPEN}\s*(?:{_DOT_WORD}|\.)\s*{_CLOSE}|&#0*46;|&#x0*2e;|&period;|%2e)\s*"
# Top-level names that make a bare "at ... dot ..." an address; those that are common words are left out.
_TOP = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|tv|example|test|invalid|local|de|fr|es|uk|us|eu|ch|nl|pt|pl|ru|cn|jp|br|mx|ca|au|se|dk|fi|cz|ie|nz|kr"
_PART = "[A-Za-z0-9-]{1,63}"
_BETWEEN = r"[ \t_]+"
#: A bare "dot" stands anywhere, its other words only before what ends in a top-level name.
_BARE_DOT = rf"(?<=[A-Za-z0-9]){_BETWEEN}(?:dot{_BETWEEN}(?=[A-Za-z0-9])|(?:point|punkt|punto){_BETWEEN}(?=(?:{_PART}{_BETWEEN}(?:{_DOT_WORD}){_BETWEEN}){{0,4}}(?:{_TOP})(?!\w)))"
# Words before "at" that speak of a place on the web rather than of a mailbox.
_PLACE = "us|me|him|her|them|it|is|are|was|were|be|here|there|look|looking|visit|found|find|available|online|site|website|page|read|see|more|info|hosted|live|out|up|and|or|only|shop|order|join|code|blog"
#: A bare "at" before a name with a disguised last dot, or, unless after such a word, with plain dots.
_BARE_AT = rf"(?<=[A-Za-z0-9]){_BETWEEN}(?:at|arroba){_BETWEEN}(?={_PART}(?:(?:{_BARE_DOT}|{_DOT}|\.){_PART}){{0,4}}(?:{_BARE_DOT}|{_DOT})(?:{_TOP})(?!\w))"
_PLAIN_AT = rf"(?<=[A-Za-z0-9]){_BETWEEN}(?:at|arroba){_BETWEEN}(?={_PART}(?:\.{_PART}){{0,4}}\.(?:{_TOP})(?![\w-]|\.\w|/))"
_AFTER_PLACE = re.compile(rf"(?i)(?<![\w.%+-])(?:{_PLACE})\Z")
#: Spaces left round a true "@" or before a top-level part.
_WIDE_AT = r"(?<=[A-Za-z0-9])[ \t]+@[ \t]+(?=[A-Za-z0-9])"
_MARKS = re.compile(rf"(?i)(?P<at>{_AT}|{_BARE_AT}|{_WIDE_AT})|(?P<maybe>{_PLAIN_AT})|(?P<dot>{_DOT}|{_BARE_DOT})")
_MARK_ONCE = re.compile(rf"(?i)(?:{_OPEN}\s*(?:at|@|arroba|{_DOT_WORD}|\.)\s*{_CLOSE})|&#|&commat|&period|%40|%2e|[ \t_]dot[ \t_]|[ \t]@[ \t]|[ \t_](?:at|arroba)[ \t_]+{_PART}(?:\.|[ \t_]+(?:{_DOT_WORD})[ \t_])")


def mark_edits(text: str) -> Iterator[tuple[int, int, str]]:
    if not _MARK_ONCE.search(text):
        return
    for m in _MARKS.finditer(text):
        if m.lastgroup != "maybe":
            yield m.start(), m.end(), "@" if m.lastgroup == "at" else "."
        elif not _AFTER_PLACE.search(text, max(0, m.start() - 12), m.start()):
            yield m.start(), m.end(), "@"


TRANSDUCERS = (homoglyph_edits, digit_edits, mark_edits)


def _chain(text: str, transducers: tuple) -> list[Rewritten]:
    layers: list[Rewritten] = []
    for edits in transducers:
        if edits is homoglyph_edits and text.isascii():
            continue
        layer = Rewritten(text, edits(text), edits)
        if layer.changed():
            layers.append(layer)
            text = layer.text
    return layers


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that appear only after rewriting, as spans of the source text: those inside a base span of their kind are left out."""
    chains = [_chain(text, TRANSDUCERS)]
    if any(layer.by is digit_edits for layer in chains[0]):
        chains.append(_chain(text, (homoglyph_edits, mark_edits)))
    known = {kind: ([s for k, s, _ in base if k == kind], [e for k, _, e in base if k == kind]) for kind in KINDS}
    found: set[Span] = set()
    for layers in chains:
        for kind, start, end in base_spans(layers[-1].text) if layers else ():
            touched = False
            for layer in reversed(layers):
                touched = touched or layer.touches(start, end)
                start, end = layer.source(start, end)
            if touched:
                starts, ends = known[kind]
                at = bisect_right(starts, start) - 1  # base spans of a kind do not overlap
                if at < 0 or ends[at] < end:
                    found.add((kind, start, end))
    return list(found)


_ORDER = {k: n for n, k in enumerate(KINDS)}


def order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (_ORDER[x[0]], x[1], x[2]))


def find_pii(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the plain text, and those that deobfuscation adds."""
    base = order(base_spans(text))
    return base, order(hidden_spans(text, base))


def redact(text: str) -> str:
    """text with every span replaced by its kind in angle brackets; overlapping spans are joined."""
    base, extra = find_pii(text)
    parts, at = [], 0
    for kind, start, end in sorted([*base, *extra], key=lambda x: (x[1], -x[2])):
        if start >= at:
            parts += (text[at:start], f"<{kind}>")
        at = max(at, end)
    return "".join([*parts, text[at:]])


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, and n_hidden (spans that deobfuscation adds)."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_hidden"]

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, extra = find_pii(text)
                said = join_spans(base)
                kinds = [x[0] for x in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(said.encode()).hexdigest(), join_spans(order(base + extra)) if extra else said, len(extra)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds_of = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True))], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_hidden long"
    return common.map_rows(common.texts_of(docs), ["doc_id", "text"], schema, run)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data in `text` replaced; all other columns and null texts stay."""
    common.ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index("text")
            new = pa.array([None if t is None else redact(t) for t in b.column(k).to_pylist()], pa.string())
            yield b.set_column(k, "text", new)

    return docs.mapInArrow(run, docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable] = {"op2_pii": op2_pii}
SQL: dict[str, str] = {}
