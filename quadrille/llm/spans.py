"""Offset-preserving rewriting: a rewritten text that can map any of its spans back to the text it came from."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable


class Rewritten:
    """text after replacing (start, end, replacement) edits, given in order and without overlap; by says what made them."""

    __slots__ = ("_out_end", "_out_start", "_src_end", "_src_start", "by", "text")

    def __init__(self, text: str, edits: Iterable[tuple[int, int, str]], by: object = None):
        self.by = by
        parts: list[str] = []
        self._out_start: list[int] = []
        self._out_end: list[int] = []
        self._src_start: list[int] = []
        self._src_end: list[int] = []
        at = out = 0
        for start, end, new in edits:
            parts += (text[at:start], new)
            out += start - at
            self._out_start.append(out)
            out += len(new)
            self._out_end.append(out)
            self._src_start.append(start)
            self._src_end.append(end)
            at = end
        parts.append(text[at:])
        self.text = "".join(parts)

    def changed(self) -> bool:
        return bool(self._out_start)

    def touches(self, start: int, end: int) -> bool:
        """Whether the span of the rewritten text holds anything rewritten (a deletion inside counts)."""
        k = bisect_right(self._out_start, end - 1) - 1
        if k >= 0 and self._out_start[k] == self._out_end[k] and self._out_start[k] <= start:
            while k >= 0 and self._out_start[k] == self._out_end[k] == start:
                k -= 1  # deletions just before the span
        return k >= 0 and (self._out_end[k] > start or self._out_start[k] > start)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The smallest span of the source text that makes this span of the rewritten one."""
        k = bisect_right(self._out_start, start) - 1
        while k >= 0 and self._out_end[k] <= start and k + 1 < len(self._out_start) and self._out_start[k + 1] <= start:
            k += 1
        if k < 0:
            s = start
        elif start < self._out_end[k]:
            s = self._src_start[k]
        else:
            s = self._src_end[k] + start - self._out_end[k]
        k = bisect_right(self._out_start, end - 1) - 1
        while k >= 0 and self._out_end[k] == self._out_start[k] == end:
            k -= 1
        if k < 0:
            e = end
        elif end - 1 < self._out_end[k]:
            e = self._src_end[k]
        else:
            e = self._src_end[k] + end - self._out_end[k]
        return s, max(s, e)


def join_spans(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)
