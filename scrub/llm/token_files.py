"""Token files: ids in the fewest bits that hold the vocabulary, readable from any place.

Layout of a file, all integers little-endian::

    b"IDB1"
    blocks       each of BLOCK ids (the last may be shorter) packed in `bits` bits an id
    index        n_docs doc_ids (int64, a null id: the lowest), then n_docs + 1 places of first ids (int64)
    block table  n_blocks + 1 byte offsets of blocks (int64)
    footer       bits, n_docs, n_ids, n_blocks (4 x int64), then b"IDB1"

64 ids fill exactly `bits` 64-bit words, so that numpy packs and unpacks all groups of 64 at once,
one shift for each of the 64 places. A reader that wants ids a .. b fetches only the blocks that
hold them.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, id_chunks, materialize, scratch_path
from .tokens import crc32_of, encode_slice, pieces, slices

MAGIC = b"IDB1"
#: Ids in a block; a multiple of 64.
BLOCK = 1 << 14


def bits_for(vocabulary: int) -> int:
    """Bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids, each below 2**bits, in ``bits`` bits each; zeros fill the last group of 64."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id does not fit the bits")
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    lanes = padded.reshape(groups, 64).T
    words = np.zeros((bits, groups), np.uint64)
    for i in range(64):
        w, s = divmod(i * bits, 64)
        words[w] |= lanes[i] << np.uint64(s)
        if s + bits > 64:
            words[w + 1] |= lanes[i] >> np.uint64(64 - s)
    return np.ascontiguousarray(words.T).astype("<u8", copy=False).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed data, as uint32."""
    words = np.ascontiguousarray(np.frombuffer(data, "<u8").reshape(-1, bits).T)
    out = np.empty((64, words.shape[1]), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        w, s = divmod(i * bits, 64)
        x = words[w] >> np.uint64(s)
        if s + bits > 64:
            x = x | (words[w + 1] << np.uint64(64 - s))
        out[i] = x & mask
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs, ...) or of a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


class TokenFileWriter:
    """Writes one file; holds one block of ids and the index of documents in memory."""

    def __init__(self, path: str, bits: int):
        system, name = _open(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        self.out, self.bits = system.open_output_stream(name), bits
        self.out.write(MAGIC)
        self.at, self.offsets, self.rest = len(MAGIC), [len(MAGIC)], np.zeros(0, np.uint32)
        self.doc_ids: list[int] = []
        self.starts, self.n = [0], 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lens: np.ndarray) -> None:
        """Documents whose ids lie one after the other in ``ids``."""
        self.doc_ids += [NULL_ID if x is None else x for x in doc_ids]
        self.starts += (self.n + np.cumsum(lens)).tolist()
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        for a in range(0, whole, BLOCK):
            self._block(ids[a : a + BLOCK])
        self.rest = ids[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        for numbers in (self.doc_ids, self.starts, self.offsets):
            self.out.write(np.asarray(numbers, "<i8").tobytes())
        self.out.write(struct.pack("<4q", self.bits, len(self.doc_ids), self.n, len(self.offsets) - 1) + MAGIC)
        self.out.close()


class TokenFile:
    """Reads one file; ``ids(a, b)`` fetches the blocks of that range only."""

    def __init__(self, path: str):
        system, name = _open(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        foot = self.file.read_at(36, size - 36)
        if foot[32:] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.bits, docs, self.n_ids, blocks = struct.unpack("<4q", foot[:32])
        table = 8 * (docs + docs + 1 + blocks + 1)
        numbers = np.frombuffer(self.file.read_at(table, size - 36 - table), "<i8")
        self.doc_ids, self.starts, self.offsets = numbers[:docs], numbers[docs : 2 * docs + 1], numbers[2 * docs + 1 :]

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK, (b - 1) // BLOCK + 1
        data = self.file.read_at(int(self.offsets[last] - self.offsets[first]), int(self.offsets[first]))
        return unpack(data, self.bits, min(self.n_ids, last * BLOCK) - first * BLOCK)[a - first * BLOCK : b - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of each document, reading about ``at_once`` ids at a time."""
        k, docs = 0, len(self.doc_ids)
        while k < docs:
            end = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + at_once, "right")) - 1)
            part = self.ids(int(self.starts[k]), int(self.starts[end]))
            for i in range(k, end):
                a, b = self.starts[i] - self.starts[k], self.starts[i + 1] - self.starts[k]
                yield (None if self.doc_ids[i] == NULL_ID else int(self.doc_ids[i])), int(self.starts[i]), part[a:b]
            k = end


def write_token_files(docs: DataFrame, out: str, tokenizer: str, vocabulary: int, rows_per_file: int = 8_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts and write them below ``out`` in ascending id order; returns the table of files.

    Columns of the result: chunk and part (files are in their order), path, n_docs, n_ids, base (ids in all files
    before). Null texts count as empty: the end id alone. Null ids come first; rows with one id are in the order
    of their texts' hashes, and of their packed ids. Texts of any length are written block by block. Other
    columns are ignored. An empty table gives no file.

    Texts are encoded where they are read; what is shuffled is the encoded ids, to chunks cut by id, or by hash
    within an id of many rows, one task for each. A task may run again after an executor is lost: each attempt writes a file of its own name, and the
    table, which is written once, names the files that count.
    """
    bits = bits_for(vocabulary)
    chunks = id_chunks(docs, rows_per_file, id_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(tokenizer)
        for batch in slices(batches, "text"):
            ids, at = encode_slice(batch.column("text"), known)
            packed = ids.astype("<u2" if bits <= 16 else "<u4")
            width = packed.itemsize
            payload = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer((at * width).astype(np.int64)), pa.py_buffer(packed)])
            hashes = batch.column("hash")
            chunk = pa.array(chunks.of(batch.column("doc_id"), hashes.to_numpy()))
            yield pa.RecordBatch.from_arrays([chunk, batch.column("doc_id"), hashes, payload.cast(pa.binary())], ["chunk", "doc_id", "hash", "ids"])

    encoded = docs.mapInArrow(encode, "chunk int, doc_id long, hash long, ids binary")
    dealt = encoded.repartitionById(len(chunks), "chunk").sortWithinPartitions("chunk", "doc_id", "hash", "ids")
    form = "<u2" if bits <= 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, writer, path, done = None, 0, None, "", []

        def close() -> None:
            writer.close()
            done.append((now, part, path, len(writer.doc_ids), writer.n))

        for batch in batches:
            chunk = batch.column("chunk").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if now != chunk[a] or len(writer.doc_ids) >= 4 * rows_per_file:
                    if writer:
                        close()
                    now, part = int(chunk[a]), part + 1 if now == chunk[a] else 0
                    path = f"{out}/{now:08d}-{uuid.uuid4().hex}.idb"
                    writer = TokenFileWriter(path, bits)
                rows = batch.slice(a, b - a)
                data = [np.frombuffer(x.as_buffer(), form) for x in rows.column("ids")]
                writer.add(rows.column("doc_id").to_pylist(), np.concatenate(data).astype(np.uint32), np.array([len(x) for x in data], np.int64))
        if writer:
            close()
        yield pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in done], t) for i, (n, t) in enumerate((("chunk", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())))})

    files = materialize(dealt.mapInArrow(write, "chunk int, part int, path string, n_docs long, n_ids long"), "token-files")
    # One row a file: some thousands at most, so that one task may order them.
    before = W.orderBy("chunk", "part").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the files, as many tasks as files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows = [(doc, base + start, len(ids), crc32_of(ids)) for doc, start, ids in TokenFile(path).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("path", "base").repartition(max(1, files.count()), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame, tokenizer: str, vocabulary: int, out: str | None = None) -> DataFrame:
    """Write the token files and read each document's digest back from them."""
    return read_token_files(write_token_files(docs, out or scratch_path(docs.sparkSession, "tokens"), tokenizer, vocabulary))
