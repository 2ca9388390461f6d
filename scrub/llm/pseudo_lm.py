"""Language-model scores of documents by masked pseudo-likelihood.

A small network predicts each word from the words on both sides of it, never from itself; a document's
score is the sum of the log-probabilities of all its words given their neighbours. Words are hashed
to a fixed number of codes. The output layer has two steps, a class and a member of the class, so that a
prediction costs the square root of the codes. The network is written in numpy.

Training is spread over the corpus: each partition trains from the same start on its own documents,
in each round on another part of their words as masked ones, so that every word is a target once, and
the parameters are averaged, weighted by words. What moves is parameters, a fixed size for each partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import slices

CLASSES, MEMBERS = 64, 128
CODES = CLASSES * MEMBERS
PAD = CODES
HIDDEN = 24
#: Places of the context, seen from the word.
WINDOW = (-2, -1, 1, 2)
#: Rounds of training; in each, one of ROUNDS words is masked, another one each time: all of them after the last.
ROUNDS = 2
BATCH = 8_192
RATE = 0.2
#: Parameter sets averaged in one task.
FAN_IN = 32

Params = dict[str, np.ndarray]
SHAPES = {"embed": (CODES + 1, HIDDEN), "place": (len(WINDOW), HIDDEN), "hidden": (HIDDEN,), "class": (HIDDEN, CLASSES), "class0": (CLASSES,), "member": (CLASSES, HIDDEN, MEMBERS), "member0": (CLASSES, MEMBERS)}


def encode_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts, one after the other, and the number of words of each.

    Words are lower-cased (A-Z) runs of what isn't ASCII white space; their code is crc32 modulo CODES.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    offsets = words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    table = np.array([zlib.crc32(w) % CODES if w else -1 for w in coded.dictionary.cast(pa.binary()).to_pylist()] or [0], np.int16)
    codes = table[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int16)
    real = codes >= 0  # white space at the ends gives empty words
    ends = np.concatenate([[0], np.cumsum(real)])[offsets]
    return codes[real], np.diff(ends)


def encoded(docs: DataFrame) -> DataFrame:
    """(doc_id, codes): each document's codes as 16-bit integers. Texts are read and split this once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            codes, counts = encode_words(batch.column("text"))
            at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(codes))])], ["doc_id", "codes"])

    return docs.mapInArrow(run, "doc_id long, codes binary")


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a batch with two PADs before, between and after documents, and the number of words of each."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    counts = np.diff(at)
    flat = np.frombuffer(column.buffers()[2] or b"", np.int16)[at[0] : at[-1]]
    out = np.full(len(flat) + 2 * (len(counts) + 1), PAD, np.int32)
    out[np.arange(len(flat)) + 2 * (np.repeat(np.arange(len(counts)), counts) + 1)] = flat
    return out, counts


def start(counts: np.ndarray, seed: int = 3) -> Params:
    """Parameters before training: predictions are the codes' frequencies."""
    rng = np.random.default_rng(seed)
    p = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    p["embed"][:] = rng.normal(0, 0.3, SHAPES["embed"])
    p["place"][:] = 1.0
    p["class"][:] = rng.normal(0, 0.1, SHAPES["class"])
    p["member"][:] = rng.normal(0, 0.1, SHAPES["member"])
    table = counts.reshape(CLASSES, MEMBERS) + 0.5
    p["class0"][:] = np.log(table.sum(1) / table.sum())
    p["member0"][:] = np.log(table / table.sum(1, keepdims=True))
    return p


def _log_chosen(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each row at its chosen place. Overwrites z."""
    z -= z.max(1, keepdims=True)
    out = z[np.arange(len(z)), chosen]
    return out - np.log(np.exp(z, out=z).sum(1))


def _errors(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Softmax of each row, less 1 at its chosen place. Overwrites z."""
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    z[np.arange(len(z)), chosen] -= 1
    return z


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order that brings words of one class together, and (class, begin, end) of each class that occurs."""
    order = np.argsort(cls.astype(np.int16), kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _hidden(p: Params, codes: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each place of the context its codes and their vectors; and the hidden layer."""
    context = [codes[at + d] for d in WINDOW]
    vectors = [p["embed"][c] for c in context]
    h = vectors[0] * p["place"][0]
    for v, place in zip(vectors[1:], p["place"][1:], strict=True):
        h += v * place
    h += p["hidden"]
    return context, vectors, np.tanh(h, out=h)


def log_probabilities(p: Params, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of the codes at the places ``at``, each from its neighbours."""
    out = np.empty(len(at), np.float32)
    for a in range(0, len(at), 4 * BATCH):
        part = at[a : a + 4 * BATCH]
        h = _hidden(p, codes, part)[2]
        cls, member = np.divmod(codes[part], MEMBERS)
        order, runs = _by_class(cls)
        h, cls, member = h[order], cls[order], member[order]
        log = _log_chosen(h @ p["class"] + p["class0"], cls)
        for c, i, j in runs:
            log[i:j] += _log_chosen(h[i:j] @ p["member"][c] + p["member0"][c], member[i:j])
        out[a + order] = log
    return out


class Trainer:
    """Adagrad on minibatches."""

    def __init__(self, p: Params):
        self.p = {k: v.copy() for k, v in p.items()}
        self.squares = {k: np.full(v.shape, 1e-2, np.float32) for k, v in p.items()}
        self.words = 0

    def _update(self, name: str, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        self.squares[name][rows] += grad * grad
        self.p[name][rows] -= RATE * grad / np.sqrt(self.squares[name][rows])

    def step(self, codes: np.ndarray, at: np.ndarray) -> None:
        p, n = self.p, len(at)
        order, runs = _by_class(codes[at] // MEMBERS)
        at = at[order]
        context, vectors, h = _hidden(p, codes, at)
        cls, member = np.divmod(codes[at], MEMBERS)
        dz = _errors(h @ p["class"] + p["class0"], cls)
        dh = dz @ p["class"].T
        for c, i, j in runs:
            dm = _errors(h[i:j] @ p["member"][c] + p["member0"][c], member[i:j])
            dh[i:j] += dm @ p["member"][c].T
            self._update("member", h[i:j].T @ dm / n * CLASSES, c)
            self._update("member0", dm.sum(0) / n * CLASSES, c)
        self._update("class", h.T @ dz / n)
        self._update("class0", dz.sum(0) / n)
        da = dh * (1 - h * h)
        self._update("hidden", da.sum(0) / n)
        flat = np.concatenate(context)
        columns = np.ascontiguousarray(da.T)  # a sum by code for each column: faster than for whole rows
        grads = np.stack([np.bincount(flat, (column * place[:, None]).ravel(), CODES + 1) for column, place in zip(columns, p["place"].T, strict=True)], 1)
        rows = np.flatnonzero(np.bincount(flat, minlength=CODES + 1))
        self._update("place", np.stack([np.einsum("nk,nk->k", da, v) for v in vectors]) / n)
        self._update("embed", (grads[rows] / n * CLASSES).astype(np.float32), rows)
        self.words += n

    def learn(self, codes: np.ndarray, turn: int, rounds: int = ROUNDS) -> None:
        at = np.flatnonzero(codes != PAD)
        at = at[(np.arange(len(at)) + at // 97) % rounds == turn]
        at = np.random.default_rng(len(codes)).permutation(at)
        for a in range(0, len(at), BATCH):
            self.step(codes, at[a : a + BATCH])


def flatten(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def restore(flat: np.ndarray) -> Params:
    out, at = {}, 0
    for k, s in SHAPES.items():
        size = int(np.prod(s))
        out[k], at = flat[at : at + size].reshape(s).astype(np.float32), at + size
    return out


def code_counts(docs: DataFrame) -> np.ndarray:
    """How often each code occurs in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES + 1, np.int64)
        for batch in batches:
            total += np.bincount(padded(batch.column("codes"))[0], minlength=CODES + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CODES, dtype=np.int32)), pa.array(total[:CODES])], ["code", "n"])

    out = np.zeros(CODES, np.int64)
    for code, n in docs.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n")).collect():  # CODES rows
        out[code] = n
    return out


def _averaged(models: DataFrame) -> Params | None:
    """Average of the rows (group, words, params), FAN_IN at a time, until one is left."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        words, total = 0, None
        for w, data in zip(table.column("words").to_pylist(), table.column("params"), strict=True):
            part = np.frombuffer(data.as_py(), np.float32).astype(np.float64) * w
            words, total = words + w, part if total is None else total + part
        params = (total / max(1, words)).astype(np.float32).tobytes()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "words": pa.array([words], pa.int64()), "params": pa.array([params], pa.binary())})

    while True:
        models = materialize(models, "models")
        n, words = models.agg(F.max("part"), F.sum("words")).first()
        if not words:
            return None
        if n == 0:
            return restore(np.frombuffer(models.first()["params"], np.float32))
        models = models.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(merge, "part long, words long, params binary")


def train(docs: DataFrame, rounds: int = ROUNDS) -> Params:
    """Train on all words of all encoded documents; every partition takes part in every round."""
    p = start(code_counts(docs))
    for turn in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(p)  # 1.6 MB, whatever the corpus

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(shared.value)
            for batch in slices(batches, "codes"):
                trainer.learn(padded(batch.column("codes"))[0], turn, rounds)
            yield pa.RecordBatch.from_arrays([pa.array([trainer.words], pa.int64()), pa.array([flatten(trainer.p).tobytes()], pa.binary())], ["words", "params"])

        models = docs.mapInArrow(run, "words long, params binary").select(F.spark_partition_id().cast("long").alias("part"), "words", "params")
        p = _averaged(models) or p
    return p


def score(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_words, pll (sum of log-probabilities), mean_log_prob of each encoded document. No shuffle.

    Null, empty and blank texts have no words: pll 0, mean null. Repeated rows each come back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "codes"):
            codes, counts = padded(batch.column("codes"))
            logs = np.concatenate([[0.0], np.cumsum(log_probabilities(shared.value, codes, np.flatnonzero(codes != PAD)), dtype=np.float64)])
            ends = np.concatenate([[0], np.cumsum(counts)])
            pll = logs[ends[1:]] - logs[ends[:-1]]
            mean = pa.array(np.divide(pll, np.maximum(counts, 1)), mask=counts == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(pll), mean], ["doc_id", "n_words", "pll", "mean_log_prob"])

    return docs.mapInArrow(run, "doc_id long, n_words long, pll double, mean_log_prob double")


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all documents, score all documents. An empty table gives no rows."""
    docs = materialize(encoded(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), "codes")
    return score(docs, train(docs, rounds))
