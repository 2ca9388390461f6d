"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

The last piece of a prefix's encoding decides the rest: what stands before it is the encoding of the
shorter prefix. And pieces side by side are an encoding if each two neighbours are one, since a merge across
a border depends on the two pieces at that border alone. So count[i] = count[j] + 1, where text[j:i] is the one piece
that may follow the last piece of the prefix j. Which piece may follow which is asked of the library once for
each pair of pieces; texts themselves are never encoded.

Pieces have blanks at their beginning only. So texts fall into units, each a run of blanks and what follows up to the next blank,
whose counts add up; each worker remembers those of the units that it has seen, up to a bound.

The index of a text keeps the difference to the prefix before for each code point, and for each block of BLOCK code points the
count before it and the lowest count in it. With it the tokens of any prefix, the longest prefix within a budget, and the tokens between
two places of cutting are read off, not encoded again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import releasing
from .tokens import slices

#: Code points of a block of an index.
BLOCK = 1_024
#: Units and pairs of pieces that a worker remembers before it starts anew; longer units are counted each time.
REMEMBERED_UNITS, REMEMBERED_PAIRS, LONGEST = 300_000, 600_000, 48
BLANK = "▁"
#: Units of texts: a run of blanks with what follows up to the next blank.
COARSE = f"[ {BLANK}]*[^ {BLANK}]+|[ {BLANK}]+"


def fine_units(characters: set[str]) -> str:
    """Units that end where letters, digits and other characters meet, too; they repeat far more.

    Numbers that are no digits (superscripts, fractions) count as other characters; those that no piece has may count as any.
    """
    numbers = re.escape("".join(sorted(c for c in characters if re.match(r"[^\W\d_]", c) and not c.isalpha())))
    return rf"[ {BLANK}]*(?:[^\W\d_{numbers}]+|\d|(?:[^\w {BLANK}]|[_{numbers}])+)|[ {BLANK}]+"


INDEX = "id long, n_bytes long, n_chars long, n_tokens long, steps binary, width int, starts array<long>, lows array<long>"


class Prefixes:
    """Counts of prefixes under one sentencepiece model of byte-pair merges with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        unknown = self.model.unk_id()
        #: A character of no piece: nothing merges with it, so what follows it is encoded as if it stood alone.
        self.wall = next(c for c in map(chr, range(1, 0xE000)) if c != " " and self.model.piece_to_id(c) == unknown)
        self.lead = len(self.model.encode(self.wall))
        ids = [i for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        names = [self.model.id_to_piece(i) for i in ids]
        # A border of units must lie in no piece.
        whole = (r for r in map(re.compile, (fine_units(set("".join(names))), COARSE)) if all(r.fullmatch(n) and len(r.findall(n)) == 1 for n in names))
        #: Finds the units of a text.
        self.unit = next(whole, None)
        if self.unit is None:
            raise ValueError("a piece has a blank after another character: texts can't be taken unit by unit")
        alone = self.model.encode([self.wall + n for n in names])
        #: Pieces that an encoding can hold, with their ids.
        self.ids = {n: i for n, i, found in zip(names, ids, alone, strict=True) if found[self.lead :] == [i]}
        self.longest = max(map(len, self.ids))
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.units: dict[str, bytes | None] = {}

    def may_follow(self, a: str, b: str) -> bool:
        """Whether the library leaves the pieces a and b side by side."""
        if self.n_pairs >= REMEMBERED_PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        known = self.pairs.setdefault(a, {})[b] = self.model.encode(self.wall + a + b)[self.lead :] == [self.ids[a], self.ids[b]]
        return known

    def extend(self, unit: str, count: list[int], last: list[str]) -> None:
        """Carry the table of a prefix on to the whole unit: count[i] are the tokens of unit[:i], last[i] is the last of them ("" where anything may follow)."""
        ids, longest, pairs = self.ids, self.longest, self.pairs
        for i in range(len(count), len(unit) + 1):
            for j in range(max(0, i - longest), i):
                piece = unit[j:i]
                if piece in ids:
                    before = last[j]
                    if before:
                        follows = pairs.get(before, _NONE).get(piece)
                        if not (self.may_follow(before, piece) if follows is None else follows):
                            continue
                    count.append(count[j] + 1)
                    last.append(piece)
                    break
            else:  # a character of no piece: its bytes, and anything may follow
                count.append(count[i - 1] + len(unit[i - 1].encode()))
                last.append("")

    def learn(self, units: set[str]) -> None:
        """Remember the differences of the units' counts, a byte each, or none if one takes more. In order, so that what two units begin with is counted once."""
        count, last, previous = [0], [""], ""
        for unit in sorted(units):
            spelled = unit.replace(" ", BLANK)
            shared = next((i for i, (a, b) in enumerate(zip(spelled, previous, strict=False)) if a != b), min(len(spelled), len(previous)))
            del count[shared + 1 :], last[shared + 1 :]
            self.extend(spelled, count, last)
            previous = spelled
            try:
                self.units[unit] = array("b", map(sub, count[1:], count)).tobytes()
            except OverflowError:
                self.units[unit] = None

    def steps(self, unit: str) -> list[int]:
        """Differences of one unit's counts, one for each code point."""
        count, last = [0], [""]
        self.extend(unit.replace(" ", BLANK), count, last)
        return list(map(sub, count[1:], count))

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Differences between the counts of each text's prefixes, one for each code point. The library puts a blank before a text."""
        split = [self.unit.findall(t) for t in texts]
        if len(self.units) >= REMEMBERED_UNITS:
            self.units.clear()
        new = set().union(*(u[1:] for u in split)).difference(self.units)
        self.learn(new)
        known = self.units.__getitem__
        for units in split:
            if not units:
                yield np.zeros(0, np.int8)
                continue
            blank, *begin = self.steps(" " + units[0])
            begin[0] += blank
            try:
                yield np.frombuffer(b"".join([array("b", begin).tobytes(), *map(known, units[1:])]), np.int8)
            except (OverflowError, TypeError):  # a difference of more than a byte
                yield np.concatenate([np.array(x, np.int64) for x in (begin, *map(self.steps, units[1:]))])
        for unit in new:
            if len(unit) > LONGEST:
                del self.units[unit]


_NONE: dict[str, bool] = {}


@lru_cache(1)
def prefixes(path: str) -> Prefixes:
    """One for each Python worker, which Spark keeps for many tasks."""
    return Prefixes(path)


def pack_steps(steps: np.ndarray) -> tuple[bytes, int]:
    """Differences in the fewest of 1, 2 or 8 bytes that hold them all, and that number."""
    most = int(np.abs(steps.astype(np.int64)).max(initial=0))
    width = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 8
    return steps.astype(f"<i{width}").tobytes(), width


def blocks_of(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts before each block, and lowest counts in each."""
    counts = np.cumsum(steps, dtype=np.int64)
    at = np.arange(0, len(counts), BLOCK)
    return np.concatenate([[0], counts])[at], np.minimum.reduceat(counts, at) if len(at) else at


def tokens_at(steps: bytes, width: int, starts: list[int], chars: int) -> int:
    """Tokens of the prefix of ``chars`` code points: reads one block at most. Beyond the end: those of the whole text."""
    chars = max(0, min(chars, len(steps) // width))
    if not chars:
        return 0
    block = (chars - 1) // BLOCK
    part = np.frombuffer(steps, f"<i{width}", chars - block * BLOCK, block * BLOCK * width)
    return int(starts[block]) + int(part.sum(dtype=np.int64))


def longest_within(steps: bytes, width: int, starts: list[int], lows: list[int], budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens. Skips blocks whose counts are all above it.

    One more code point may take tokens away, so the last such prefix is looked for, not the first that is too long.
    """
    fits = np.flatnonzero(np.asarray(lows) <= budget)
    if not len(fits):
        return 0
    block = int(fits[-1])
    n = min(BLOCK, len(steps) // width - block * BLOCK)
    counts = int(starts[block]) + np.cumsum(np.frombuffer(steps, f"<i{width}", n, block * BLOCK * width), dtype=np.int64)
    return block * BLOCK + int(np.flatnonzero(counts <= budget)[-1]) + 1


def prefix_index(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of each row's text: (id, n_bytes, n_chars, n_tokens, steps, width, starts, lows). No shuffle.

    Null and empty texts have no tokens and empty indexes; null and repeated ids are kept, a row each; other columns are left alone.
    """

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = prefixes(model)
        for batch in slices(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            columns: list[list] = [[] for _ in range(6)]
            for steps in known.of(texts.to_pylist()):
                starts, lows = blocks_of(steps)
                for column, value in zip(columns, (len(steps), int(steps.sum()), *pack_steps(steps), starts, lows), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pc.binary_length(texts).cast(pa.int64()), *arrays], ["id", "n_bytes", "n_chars", "n_tokens", "steps", "width", "starts", "lows"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, INDEX)


@F.pandas_udf(LongType())
def _tokens_at(steps: pd.Series, width: pd.Series, starts: pd.Series, chars: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(n) else tokens_at(s, w, b, int(n)) for s, w, b, n in zip(steps, width, starts, chars, strict=True)], dtype="Int64")


@F.pandas_udf(LongType())
def _longest_within(steps: pd.Series, width: pd.Series, starts: pd.Series, lows: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(n) else longest_within(s, w, b, low, int(n)) for s, w, b, low, n in zip(steps, width, starts, lows, budget, strict=True)], dtype="Int64")


def prefix_tokens(chars: Column) -> Column:
    """Of rows of an index: tokens of the prefix of so many code points (of the whole text if it is shorter; null for null)."""
    return _tokens_at(F.col("steps"), F.col("width"), F.col("starts"), chars.cast("long"))


def prefix_within(budget: Column) -> Column:
    """Of rows of an index: code points of the longest prefix of at most so many tokens (null for null)."""
    return _longest_within(F.col("steps"), F.col("width"), F.col("starts"), F.col("lows"), budget.cast("long"))


def token_budget(docs: DataFrame, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, kept_chars): each text's size, and where to cut those of more than ``limit`` tokens."""
    index = prefix_index(docs, model, id_col, text_col)
    return index.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), prefix_within(F.lit(limit)).alias("kept_chars"))
