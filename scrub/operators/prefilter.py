"""Which patterns may match in which lines of a text: one pass of an Aho-Corasick automaton over all patterns' hints.

The automaton runs over bytes in which case and digits don't count, so few letters are left and a hint is plain text. What it finds is
a superset: the pattern's expression decides. Bytes and places stay those of the text, so what stands before and after a hint is looked at in the text itself.
"""

from __future__ import annotations

import bisect
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import LINE_LIMIT, LINES
from .formats import Pattern

_END_BYTES = re.compile(rb"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e]|\xc2\x85|\xe2\x80[\xa8\xa9]")

#: Upper-case letters as lower-case ones, in UTF-8 of Latin letters too, and digits as 0. It joins other bytes as well, alike in hints and texts.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 48 if 49 <= b <= 57 else b + 32 if 0x80 <= b <= 0x9F else b for b in range(256))
#: Letters that match ASCII ones where case doesn't count, and the digits of all scripts.
_ODD = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"} | {c: str(unicodedata.digit(chr(c))) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"}
_ODD_CHARACTER = re.compile("[" + "".join(map(chr, _ODD)) + "]")
# Most texts have none of them, which their bytes tell sooner: the four letters as they are, digits by the first bytes of their scripts.
_ODD_LETTERS = [chr(c).encode() for c, to in _ODD.items() if to.isalpha()]
_NO_DIGIT_LEAD = bytes(set(range(256)) - {chr(c).encode()[0] for c, to in _ODD.items() if to.isdigit()})


def _has_odd(text: str, data: bytes) -> bool:
    return any(x in data for x in _ODD_LETTERS) or (len(data.translate(None, _NO_DIGIT_LEAD)) > 0 and bool(_ODD_CHARACTER.search(text)))


#: Number, hints, characters that can't stand before a hint, what follows one.
Spec = tuple[int, tuple[str, ...], str, str]


def spec_of(patterns: list[Pattern]) -> tuple[Spec, ...]:
    return tuple((no, p.hints, "" if p.inside else p.not_before, p.then) for no, p in enumerate(patterns))


def _class_bytes(characters: str) -> frozenset[int]:
    """ASCII bytes of a class; one that isn't ASCII is left to the expression."""
    return frozenset(b for b in range(128) if re.match(f"[{characters}]", chr(b), re.ASCII)) if characters else frozenset()


class Prefilter:
    """The automaton of some patterns' hints."""

    def __init__(self, specs: tuple[Spec, ...]):
        import ahocorasick

        self.always = [no for no, hints, *_ in specs if not hints]
        entries: dict[str, list[tuple]] = {}
        for no, hints, not_before, then in specs:
            first = _class_bytes(not_before)
            after = re.compile(then.replace(r"\s", r"[\s\x80-\xff]").encode("latin-1"), re.IGNORECASE) if then else None
            for hint in hints:
                folded = hint.encode().translate(_FOLD).decode("latin-1")
                entries.setdefault(folded, []).append((no, len(folded), first, after))
        self.automaton = ahocorasick.Automaton()
        for folded, found in entries.items():
            self.automaton.add_word(folded, found)
        if entries:
            self.automaton.make_automaton()

    def hits(self, text: str) -> tuple[bytes, list[tuple[int, int]]]:
        """The text's bytes and (place, pattern) of hints that may be part of a match."""
        data = text.encode()
        if len(data) > len(text) and _has_odd(text, data):
            data = text.translate(_ODD).encode()
        out = []
        if len(self.automaton):
            for end, found in self.automaton.iter(data.translate(_FOLD).decode("latin-1")):
                for no, size, first, after in found:
                    at = end + 1 - size
                    if (at and data[at - 1] in first) or (after and not after.match(data, end + 1)):
                        continue
                    out.append((at, no))
        return data, out

    def lines(self, text: str, cut: bool) -> Iterator[tuple[int, str, list[int]]]:
        """(line from 1, its text, patterns to try in ascending order) of lines that some pattern may match in."""
        data, hits = self.hits(text)
        if not hits and not self.always:
            return
        ends = [m.end() for m in _END_BYTES.finditer(data)]
        tries: dict[int, set[int]] = {}
        for at, no in hits:
            tries.setdefault(bisect.bisect_right(ends, at), set()).add(no)
        lines = LINES.split(text)
        if self.always:
            for i in range(len(lines) - (lines[-1] == "")):
                tries.setdefault(i, set()).update(self.always)
        for i in sorted(tries):
            yield i + 1, lines[i][:LINE_LIMIT] if cut else lines[i], sorted(tries[i])

    def tries(self, text: str) -> list[int]:
        """Patterns that may match somewhere in the text, in ascending order."""
        return sorted({no for _, no in self.hits(text)[1]}.union(self.always))


@lru_cache(8)
def _prefilter(specs: tuple[Spec, ...]) -> Prefilter:
    """One for each worker and set of patterns."""
    return Prefilter(specs)


LINE_ROWS = "array<struct<line:int,text:string,tries:array<int>>>"


def _offsets(sizes: list[int]) -> pa.Array:
    total, out = 0, [0]
    for n in sizes:
        total += n
        out.append(total)
    return pa.array(out, pa.int32())


def lines_to_try(patterns: list[Pattern], cut: bool = True) -> Callable[[Column], Column]:
    """Of a text an array of (line, text, tries): its lines in which some pattern may match, and the numbers of these patterns.

    Long lines are cut if ``cut``. Null gives an empty array. One pass over the text, whatever the number of patterns.
    """
    specs = spec_of(patterns)

    @F.arrow_udf(LINE_ROWS)
    def run(texts: pa.Array) -> pa.Array:
        known = _prefilter(specs)
        sizes, numbers, lines, counts, tries = [], [], [], [], []
        for text in texts.to_pylist():
            before = len(numbers)
            for number, line, found in known.lines(text, cut) if text else ():
                numbers.append(number)
                lines.append(line)
                counts.append(len(found))
                tries.extend(found)
            sizes.append(len(numbers) - before)
        inner = pa.ListArray.from_arrays(_offsets(counts), pa.array(tries, pa.int32()))
        rows = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.array(lines, pa.string()), inner], ["line", "text", "tries"])
        return pa.ListArray.from_arrays(_offsets(sizes), rows)

    return run


def patterns_to_try(patterns: list[Pattern]) -> Callable[[Column], Column]:
    """Of a text an array of the numbers of patterns that may match in it. Null gives an empty array."""
    specs = spec_of(patterns)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        known = _prefilter(specs)
        return pa.array([known.tries(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.int32()))

    return run


