"""Encode whole texts with a public word tokenizer, column batch by column batch.

The tokenizer drops white space and never lets a token cross it, so a text's ids are those of its
pieces between ASCII white space, in order. Encoding a piece is costly and pieces repeat, so each
Python worker keeps the ids of the pieces that it has seen, up to a bound; a batch looks up its
distinct pieces only and gathers the rest with numpy.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Appended to each document.
END_ID = 1
#: Text bytes that are worked on at once; bounds a worker's memory. One longer text is worked on alone.
SLICE_BYTES = 6 << 20
#: Pieces that a worker remembers before it starts anew.
REMEMBERED = 700_000
#: Longer pieces are encoded each time.
LONGEST = 48


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, others for the code points from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) if b in keep else chr(256 + rest.index(b)) for b in range(256)}


class Pieces:
    """Ids of pieces of text, remembered. ``get`` returns the place of a piece's ids in ``ids``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {b"": 0}
        self.lens = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.int32)
        self.n, self.used = 1, 0

    def encode(self, piece: bytes) -> list[int]:
        if piece.isalpha():  # ASCII letters: one word, itself in the byte alphabet
            return [t.id for t in self.model.tokenize(piece.lower().decode())]
        text = piece.decode()
        if piece[-1:] in (b".", b",") and text[:-1].isalpha() and text[:-1].lower().isalpha():  # a word, then one mark that is a token of its own
            return self.of(piece[:-1]) + self.of(piece[-1:])
        if text.isalpha() and max(text) < "ƀ":  # letters of Latin-1 and Latin Extended-A: composed already
            low = text if text == text.lower() else text.lower()
            if len(low) == len(text):
                return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, low.encode())))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def of(self, piece: bytes) -> list[int]:
        k = self.get(piece)
        return self.ids[self.starts[k] : self.starts[k] + self.lens[k]].tolist()

    def get(self, piece: bytes) -> int:
        k = self.place.get(piece)
        if k is None:
            ids = self.encode(piece)
            k, self.n = self.n, self.n + 1
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            if k >= len(self.lens):
                self.lens = np.concatenate([self.lens, np.zeros_like(self.lens)])
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts[k], self.lens[k] = self.used, len(ids)
            self.used += len(ids)
            self.place[piece] = k
        return k


def vocabulary_of(path: str) -> int:
    """Ids that a tokenizer can give are below this."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


@lru_cache(1)
def pieces(path: str) -> Pieces:
    """One for each Python worker, which Spark keeps for many tasks."""
    return Pieces(path)


def _lowered(raw: pa.Array) -> pa.Array:
    """A-Z in lower case, so that fewer pieces differ.

    Left alone where that could change ids: a special token's text has case, and some letters
    have a composed form in lower case only, so that a combining mark (UTF-8 0xCC, 0xCD) must come first.
    """
    data = raw.cast(pa.binary())
    odd = any(pc.any(pc.match_substring(data, x)).as_py() for x in (b"<|", b"\xcc", b"\xcd"))
    return raw if odd else pc.ascii_lower(raw)


def _concat_ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for lens[i] numbers each, one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def encode_slice(texts: pa.Array, known: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, each closed by END_ID, and the n + 1 places where texts begin."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if known.n > REMEMBERED:
        known.clear()
    words = pc.ascii_split_whitespace(_lowered(texts))
    per_text = np.diff(words.offsets.to_numpy().astype(np.int64))
    coded = words.flatten().dictionary_encode()
    places = np.zeros(len(coded.dictionary), np.int64)
    long: dict[int, list[int]] = {}
    for i, w in enumerate(coded.dictionary.cast(pa.binary()).to_pylist()):
        if len(w) <= LONGEST:
            places[i] = known.get(w)
        else:
            long[i] = known.tokenizer.encode(w.decode(), add_special_tokens=False).ids
    starts, lens, pool = known.starts[places], known.lens[places].astype(np.int64), known.ids[: known.used]
    if long:
        extra = np.concatenate([np.asarray(v, np.int32) for v in long.values()]) if any(long.values()) else np.zeros(0, np.int32)
        at = len(pool)
        for i, v in long.items():
            starts[i], lens[i], at = at, len(v), at + len(v)
        pool = np.concatenate([pool, extra])
    index = coded.indices.to_numpy().astype(np.int64)
    word_lens = lens[index]
    word_ends = np.concatenate([[0], np.cumsum(word_lens)])
    text_ends = word_ends[np.cumsum(per_text)] if len(per_text) else np.zeros(0, np.int64)
    ids = pool[_concat_ranges(starts[index], word_lens)]
    offsets = np.concatenate([[0], text_ends + np.arange(1, len(per_text) + 1)]).astype(np.int64)
    out = np.empty(len(ids) + len(per_text), np.uint32)
    closed = np.zeros(len(out), bool)
    closed[offsets[1:] - 1] = True
    out[closed] = END_ID
    out[~closed] = ids
    return out, offsets


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about SLICE_BYTES of text, one row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
